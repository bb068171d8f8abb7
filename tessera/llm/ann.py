"""Approximate nearest neighbours from randomly rotated one-bit codes.

Every vector is taken relative to the nearest of ``centroids`` centroids (k-means on a
bounded sample), padded to ``code_bits`` dimensions, rotated by a seeded random orthogonal
matrix and kept as its signs: a packed code plus three scalars - the length of the
difference, the code's inner product with the direction it stands for, and with the
centroid. A query's inner products with a slice's codes come from one product with the
unpacked signs; dividing by the second scalar gives an unbiased estimate of the distance,
and the same scalar gives its error bound.

Codes alone meet the queries, slice by slice. A row stays a candidate while its lower bound
is under what ``k`` rows are known to keep: the query's distances to the sample, the slice's
k-th upper bound, then, over all slices, the query's. Only the vectors of what is left are
fetched and reranked on their original components.

The index is fitted on at most ``sample`` rows (chosen by a hash) and holds every row; bounds
are ``width`` standard errors wide, so a neighbour can be missed. Unusable and zero vectors
take no part; an id met twice counts once, with its least vector; equal distances go to the
smaller id; a table without usable vectors gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, sample_share
from tessera.llm.vectors import matrix, meet, packed, ranked


def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """dim x bits with orthonormal rows: padding by zeros, then a random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    return (q * np.sign(np.diag(r)))[:dim]


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        d = (centers * centers).sum(1)[None] - 2 * x @ centers.T
        own = d.argmin(1)
        count = np.bincount(own, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centers)
    return centers


def encode(x: np.ndarray, centers: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """cell, packed signs, length of the difference, code with direction, code with centroid."""
    bits = rot.shape[1]
    cell = ((centers * centers).sum(1)[None] - 2 * x @ centers.T).argmin(1)
    diff = x - centers[cell]
    length = np.sqrt((diff * diff).sum(1))
    turned = diff @ rot
    sign = turned >= 0
    code = np.where(sign, 1.0, -1.0) / np.sqrt(bits)
    with_direction = np.where(length > 0, (code * turned).sum(1) / np.where(length > 0, length, 1), 1.0)
    with_centroid = (code * (centers @ rot)[cell]).sum(1)
    return cell, np.packbits(sign, axis=1), length, with_direction, with_centroid


def estimate(
    asked: np.ndarray, cell: np.ndarray, signs: np.ndarray, length: np.ndarray, with_direction: np.ndarray, with_centroid: np.ndarray, centers: np.ndarray,
    rot: np.ndarray, width: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of queries x rows, estimated, and lower bounds of them; as far below them as upper ones are above."""
    bits = rot.shape[1]
    turned = (asked @ rot).astype(np.float32)
    code = (np.unpackbits(signs, axis=1, count=bits).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(bits))
    length, with_direction = length.astype(np.float32), with_direction.astype(np.float32)
    along = turned @ code.T - with_centroid.astype(np.float32)
    away2 = np.maximum(((asked[:, None] - centers[None]) ** 2).sum(2), 0).astype(np.float32)[:, cell]
    middle = length**2 + away2 - 2 * (length / with_direction) * along
    loose = length * np.sqrt(np.maximum(1 - with_direction**2, 0)) / with_direction * np.float32(width / np.sqrt(bits - 1))
    return middle, middle - 2 * np.sqrt(away2) * loose - 1e-5 * (1 + length**2 + away2)


def search(
    table: DataFrame, *, every: int = 100, k: int = 10, centroids: int = 64, code_bits: int = 256, sample: int = 10_000, width: float = 2.2,
    group_queries: int = 4096, slice_rows: int = 65_536, least_slices: int = 24, seed: int = 5,
) -> DataFrame:
    """Queries: rows whose vec_id is divisible by ``every``; candidates: all rows but the query's own."""
    spark = table.sparkSession
    rows, dim = packed(table, drop_zero=True)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not dim:
        return empty
    with Scratch(spark) as work:
        rows = work.keep(rows.drop("norm2"), "vectors")
        total = rows.count()
        if not total:
            return empty
        taken = sample_share(rows, sample, "vec_id").orderBy("__order", "vec_id").limit(sample).select("vec").collect()
        chosen = np.array([np.frombuffer(r["vec"], np.float64) for r in (taken or rows.limit(1).collect())])
        centers = kmeans(chosen[np.lexsort(chosen.T)], centroids, seed=seed)
        bits = max(code_bits, -(-dim // 8) * 8)
        # of fixed size: centroids, a rotation, and at most ``sample`` vectors
        shared = spark.sparkContext.broadcast((centers, rotation(dim, bits, seed), chosen))
        codes = work.keep(rows.mapInArrow(_indexer(shared, dim), CODES), "codes")
        asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("asked"))
        asked = work.keep(asked.mapInArrow(_limiter(shared, dim, k), "query_id long, asked binary, most double"), "asked")
        groups = max(1, -(-asked.count() // group_queries))
        slices = max(least_slices, -(-total // slice_rows))
        queries = asked.select(F.pmod(F.xxhash64(F.lit(9), "query_id"), F.lit(groups)).cast("int").alias("grp"), F.lit(slices).alias("slices"), "query_id", "asked", "most")
        dealt = codes.withColumn("slices", F.lit(slices)).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        met = work.keep(meet(dealt, queries, _estimator(shared, dim, k, width), "query_id long, vec_id long, low double, high double"), "met")
        # over all slices the k-th least upper bound of a query is one that k rows keep; bounds may fail, so the
        # k least estimates stay whatever they say
        by = lambda *order: F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "vec_id"))
        edge = met.withColumn("r", by("high")).where(F.col("r") <= k).groupBy("query_id").agg(F.max("high").alias("edge"))
        least = met.withColumn("r", by(F.col("low") + F.col("high")))
        kept = least.join(edge, "query_id").where((F.col("low") <= F.col("edge")) | (F.col("r") <= k)).select("query_id", "vec_id")
        # only now do vectors travel: those of the rows kept, to the queries that kept them
        pairs = kept.join(rows, "vec_id").join(asked.select("query_id", "asked"), "query_id").select("query_id", "vec_id", "vec", "asked")

        def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rb in batches:
                score = np.sqrt(((matrix(rb.column("vec"), dim) - matrix(rb.column("asked"), dim)) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([rb.column("query_id"), rb.column("vec_id"), pa.array(score)], names=["query_id", "vec_id", "score"])

        return work.release(ranked(pairs.mapInArrow(rerank, "query_id long, vec_id long, score double"), k, False))


CODES = "vec_id long, cell int, code binary, length float, with_direction float, with_centroid float"


def _indexer(shared, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, rot, _ = shared.value
        for rb in batches:
            if rb.num_rows:
                cell, signs, *scalars = encode(matrix(rb.column("vec"), dim), centers, rot)
                code = pa.array([s.tobytes() for s in signs], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [rb.column("vec_id"), pa.array(cell.astype(np.int32)), code, *[pa.array(s.astype(np.float32)) for s in scalars]],
                    names=["vec_id", "cell", "code", "length", "with_direction", "with_centroid"],
                )

    return run


def _limiter(shared, dim: int, k: int):
    """Adds ``most``: the (k + 1)-th least squared distance to the sample, which holds the query itself at most once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = shared.value[2]
        own = (chosen * chosen).sum(1)
        for rb in batches:
            y = matrix(rb.column("asked"), dim)
            most = np.full(len(y), np.inf)
            for a in range(0, len(y) if len(chosen) > k else 0, 512):
                part = y[a : a + 512]
                d2 = (part * part).sum(1)[:, None] + own[None] - 2 * part @ chosen.T
                most[a : a + 512] = np.maximum(np.partition(d2, k, axis=1)[:, k], 0) * (1 + 1e-9) + 1e-9
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(most)], names=["query_id", "asked", "most"])

    return run


def _estimator(shared, dim: int, k: int, width: float):
    def solve(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        names, found, lows, highs = [], [], [], []
        if len(d) and len(q):
            centers, rot, _ = shared.value
            ids = d["vec_id"].to_numpy()
            signs = np.frombuffer(b"".join(d["code"]), np.uint8).reshape(len(d), -1)
            own = [d[c].to_numpy() for c in ("cell", "length", "with_direction", "with_centroid")]
            asked, y, most = q["query_id"].to_numpy(), matrix(q["asked"], dim), q["most"].to_numpy()
            for a in range(0, len(y), 32):
                middle, low = estimate(y[a : a + 32], own[0], signs, *own[1:], centers, rot, width)
                high = 2 * middle - low
                itself = asked[a : a + 32, None] == ids[None]
                middle[itself] = low[itself] = high[itself] = np.inf
                edge = most[a : a + 32]
                if len(ids) >= k:
                    edge = np.minimum(edge, np.partition(high, k - 1, axis=1)[:, k - 1])
                near = low <= edge[:, None]
                for short in np.nonzero(near.sum(1) < k)[0]:  # never fewer than k rows, as far as there are any
                    near[short, np.argpartition(middle[short], k)[:k] if len(ids) > k else slice(None)] = True
                at, row = np.nonzero(near & np.isfinite(low))
                names.append(asked[a + at])
                found.append(ids[row])
                lows.append(low[at, row])
                highs.append(high[at, row])
        gather = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pd.DataFrame({"query_id": gather(names, np.int64), "vec_id": gather(found, np.int64), "low": gather(lows, float), "high": gather(highs, float)})

    return solve
