"""Vectors as packed rows, and the blocked meeting of queries and data that both searches use."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def packed(table: DataFrame, column: str = "embedding", floor_scale: float | None = None, drop_zero: bool = False) -> tuple[DataFrame, int]:
    """(vec_id, vec, norm2) of the usable vectors, vec their doubles in bytes, and their dimension.

    Null vectors, vectors holding null or non-finite components and null ids take no part;
    of several lengths the most frequent one (the least of equals) is the table's. An id met
    more than once gives one row, with the least of its packed vectors."""
    usable = table.where(F.col(column).isNotNull() & F.col("vec_id").isNotNull())
    odd = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = usable.where(~odd & (F.size(column) > 0))
    sizes = usable.groupBy(F.size(column).alias("d")).count().collect()  # a row a length
    dim = min(sizes, key=lambda r: (-r["count"], r["d"]))["d"] if sizes else 0
    usable = usable.where(F.size(column) == dim)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            x = rb.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rb.num_rows, dim)
            if floor_scale is not None:
                x = np.floor(floor_scale * x)
            norm2 = (x * x).sum(1)
            ok = norm2 > 0 if drop_zero else np.ones(len(x), bool)
            vec = pa.array([v.tobytes() for v in x[ok]], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(rb.column(0).to_numpy()[ok]), vec, pa.array(norm2[ok])], names=["vec_id", "vec", "norm2"])

    rows = usable.select(F.col("vec_id").cast("long"), column).mapInArrow(pack, "vec_id long, vec binary, norm2 double")
    # before any distance is counted: copies of one id would fill the places of bounds
    return rows.groupBy("vec_id").agg(F.min(F.struct("vec", "norm2")).alias("r")).select("vec_id", "r.vec", "r.norm2"), dim


def matrix(column, dim: int) -> np.ndarray:
    values = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), dim)


def meet(data: DataFrame, queries: DataFrame, solve: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """data: grp, slices, vec_id, ...; queries: grp, slices, query_id, .... The queries of a group meet its
    data slice by slice, a slice in one task; slices cut a group's data by a hash of vec_id, so none is hot."""
    data = data.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.col("slices")).cast("int")).drop("slices")
    queries = queries.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")

    def run(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return solve(d, q)

    return data.groupBy("grp", "slice").cogroup(queries.groupBy("grp", "slice")).applyInPandas(run, schema)


def best_rows(found: DataFrame, k: int, descending: bool, by: str = "query_id") -> DataFrame:
    """found with ``rank``: the k best of every ``by``, ties to the smaller vec_id."""
    best = F.col("score").desc() if descending else F.col("score").asc()
    w = Window.partitionBy(by).orderBy(best, F.col("vec_id").asc())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ranked(found: DataFrame, k: int, descending: bool) -> DataFrame:
    """query_id, rank, vec_id, score of the k best a query."""
    return best_rows(found, k, descending).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
