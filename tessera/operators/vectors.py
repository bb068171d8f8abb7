"""Vector index tables: documents, upserts, synchronisation, nearest neighbours by comparison or by a stored index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.runtime import Scratch


def index_documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, id, document, metadata) of nodes and edges."""
    pair = lambda *kv: F.create_map(*[x for k, v in kv for x in (F.lit(k), v)])
    a = nodes.select("graph_id", "id", F.col("name").alias("document"), pair(("type", F.lit("node")), ("node_type", F.col("type")), ("name", F.col("name"))).alias("metadata"))
    b = edges.select("graph_id", "id", F.concat_ws(" ", "source", "relation", "target").alias("document"), pair(("type", F.lit("edge")), ("relation", F.col("relation")), ("source", F.col("source")), ("target", F.col("target"))).alias("metadata"))
    return a.unionByName(b)


def embed(rows: DataFrame, embedder: Callable[[list[str]], list[list[float]]], text: str = "document") -> DataFrame:
    """Adds an embedding column by a user's batch function."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(embedder(s.fillna("").tolist()))

    return rows.withColumn("embedding", run(text))


def add(index: DataFrame, new: DataFrame) -> DataFrame:
    """New ids only; rows without a vector are refused."""
    return index.unionByName(new.where("embedding is not null").join(index.select("id"), "id", "left_anti"))


def upsert(index: DataFrame, new: DataFrame) -> DataFrame:
    return index.join(new.select("id").distinct(), "id", "left_anti").unionByName(new)


def delete(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("id").distinct(), "id", "left_anti")


def content_mark() -> Column:
    """A digest of a row's document and metadata (SHA-256 of their JSON): rows are compared by 32 bytes, not whole."""
    return F.unhex(F.sha2(F.to_json(F.struct("document", F.array_sort(F.map_entries("metadata")).alias("metadata"))), 256))


def sync_plan(documents: DataFrame, index: DataFrame) -> DataFrame:
    """(graph_id, id, action): insert, update (document or metadata changed), delete or keep."""
    text = lambda m: F.to_json(F.array_sort(F.map_entries(m)))
    a = documents.select("graph_id", "id", F.struct("document", text("metadata").alias("m")).alias("__new"))
    b = index.select("graph_id", "id", F.struct("document", text("metadata").alias("m")).alias("__old"))
    action = F.when(F.col("__new").isNull(), "delete").when(F.col("__old").isNull(), "insert").when(F.col("__new") == F.col("__old"), "keep").otherwise("update")
    return a.join(b, ["graph_id", "id"], "full_outer").select("graph_id", "id", action.alias("action"))


def ids(index: DataFrame) -> DataFrame:
    """All ids of an index, each once."""
    return index.select("id").distinct()


def top_k(index: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", block: int = 4096, slices: int = 64, metadata: list[str] | None = None, skip_own: bool = False) -> DataFrame:
    """index: id, embedding; queries: query_id, embedding. (query_id, id, distance, rank), ties by id, and the
    ``metadata`` columns of the index. Vectors that are null or hold a null or NaN are not found, and find
    nothing; zero vectors have a cosine of 0 with all others. With ``skip_own`` a query does not find the row of its own id.

    Queries are dealt into blocks of about ``block``; every index slice meets every block in one
    task as a matrix product, and only its own k best go on to the ranking."""
    queries = _whole(queries)
    blocks = max(1, -(-queries.count() // block))
    q = queries.select("query_id", F.col("embedding").alias("v")).withColumn("b", F.pmod(F.hash("query_id"), F.lit(blocks)))
    q = q.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    d = _whole(index).select("id", F.col("embedding").alias("v")).withColumn("s", F.pmod(F.hash("id"), F.lit(slices)))
    d = d.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    id_type, query_type = index.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    places = k + skip_own

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            x, y = (np.array(p["v"].tolist(), float) for p in (left, right))
            ids = left["id"].to_numpy()
            if metric == "cosine":
                y, x = (v / np.where(size := np.linalg.norm(v, axis=1, keepdims=True), size, 1) for v in (y, x))
                dist = 1 - y @ x.T
            else:
                dist = np.sqrt(np.maximum((y * y).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * y @ x.T, 0))
            dist = np.round(dist, 9)
            for name, row in zip(right["query_id"].tolist(), dist, strict=True):
                n = min(places, len(row))
                near = np.flatnonzero(row <= np.partition(row, n - 1)[n - 1])
                out += [(name, ids[i], float(row[i])) for i in near[np.lexsort([ids[near], row[near]])][:places]]
        return pd.DataFrame(out, columns=["query_id", "id", "distance"])

    found = d.groupBy("b", "s").cogroup(q.groupBy("b", "s")).applyInPandas(solve, f"query_id {query_type}, id {id_type}, distance double")
    if skip_own:
        found = found.where("query_id <> id")
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    hits = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return hits.join(index.select("id", *metadata), "id").select("query_id", "id", "distance", "rank", *metadata) if metadata else hits


def _whole(df: DataFrame) -> DataFrame:
    return df.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))


class StoredIndex:
    """An index in a folder, a directory a cell: rows near the same center. Searches read the cells they need.

    Centers are found on a sample of at most ``sample`` rows; every row is stored with its cell, and every cell's
    greatest distance from its center (its radius) is known. A query first looks into its ``probes`` nearest
    cells. With ``exact`` it then looks into all other cells that can still hold a nearer row than its k-th
    by the triangle inequality: the result is that of top_k. Without, it is approximate. Distances are
    euclidean or, between unit vectors, cosine; vectors that are null, or hold a null or NaN, take no part."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.metric = spark.read.parquet(f"{path}/metric").first()["metric"]
        found = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # a row a cell
        self.centers = _matrix([r["center"] for r in found])
        self.radius = np.array([r["radius"] for r in found], float)

    @staticmethod
    def build(index: DataFrame, path: str, cells: int = 64, metric: str = "cosine", sample: int = 10_000, rounds: int = 10) -> StoredIndex:
        """index: id, embedding; as many cells as there are different vectors in the sample at most."""
        spark, id_type = index.sparkSession, index.schema["id"].dataType.simpleString()
        rows = _whole(index).select("id", F.col("embedding").cast("array<double>").alias("embedding"))
        taken = rows.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(sample).select("embedding").collect()
        x = _scaled(_matrix([r["embedding"] for r in taken]), metric)
        centers = np.unique(x, axis=0)
        centers = centers[np.random.default_rng(1).permutation(len(centers))[:cells]]
        for _ in range(rounds if len(x) else 0):
            own = _apart(x, centers).argmin(1)
            centers = np.array([x[own == i].mean(0) if (own == i).any() else centers[i] for i in range(len(centers))])

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    apart = _apart(_scaled(np.array(pdf["embedding"].tolist(), float), metric), centers)
                    yield pdf.assign(cell=apart.argmin(1).astype(np.int32), away=apart.min(1))

        placed = rows.mapInPandas(place, f"id {id_type}, embedding array<double>, cell int, away double")
        if not len(centers):
            placed = spark.createDataFrame([], f"id {id_type}, embedding array<double>, cell int, away double")
        n = max(1, len(centers))
        placed.repartition(n, "cell").write.partitionBy("cell").mode("overwrite").parquet(f"{path}/rows")
        schema = f"id {id_type}, embedding array<double>, away double, cell int"
        radius = {r["cell"]: r["radius"] for r in spark.read.schema(schema).parquet(f"{path}/rows").groupBy("cell").agg(F.max("away").alias("radius")).collect()}
        made = [(i, c.tolist(), float(radius.get(i, -1.0))) for i, c in enumerate(centers)]
        spark.createDataFrame(made, "cell int, center array<double>, radius double").write.mode("overwrite").parquet(f"{path}/cells")
        spark.createDataFrame([(metric, id_type)], "metric string, id string").write.mode("overwrite").parquet(f"{path}/metric")
        return StoredIndex(spark, path)

    def rows(self) -> DataFrame:
        kind = self.spark.read.parquet(f"{self.path}/metric").first()["id"]
        return self.spark.read.schema(f"id {kind}, embedding array<double>, away double, cell int").parquet(f"{self.path}/rows")

    def _visit(self, asked: DataFrame, k: int, part_rows: int) -> DataFrame:
        """asked: query_id, v, cell. Each query's k nearest rows of each of its cells; a cell is dealt into parts."""
        wanted = [r["cell"] for r in asked.select("cell").distinct().collect()]  # cells at most
        data = self.rows().where(F.col("cell").isin(wanted))
        parts = data.groupBy("cell").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
        data = data.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        dealt = asked.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        metric = self.metric
        query_type, id_type = (df.schema[c].dataType.simpleString() for df, c in ((asked, "query_id"), (data, "id")))

        def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(left) and len(right):
                x, ids = _scaled(np.array(left["embedding"].tolist(), float), metric), left["id"].to_numpy()
                y, names = _scaled(np.array(right["v"].tolist(), float), metric), right["query_id"].to_numpy()
                for at in range(0, len(y), 512):
                    some = y[at : at + 512]
                    dist = 1 - some @ x.T if metric == "cosine" else np.sqrt(np.maximum((some * some).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * some @ x.T, 0))
                    dist = np.round(dist, 9)
                    edge = np.partition(dist, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
                    q, i = np.nonzero(dist <= edge[:, None])
                    found.append(pd.DataFrame({"query_id": names[at + q], "id": ids[i], "distance": dist[q, i]}))
            return pd.concat(found) if found else pd.DataFrame({"query_id": [], "id": [], "distance": []})

        grouped = data.select("cell", "part", "id", "embedding").groupBy("cell", "part").cogroup(dealt.select("cell", "part", "query_id", "v").groupBy("cell", "part"))
        return grouped.applyInPandas(solve, f"query_id {query_type}, id {id_type}, distance double")

    def search(self, queries: DataFrame, k: int, probes: int = 4, exact: bool = True, part_rows: int = 65_536) -> DataFrame:
        """queries: query_id, embedding. (query_id, id, distance, rank), ties by id."""
        centers, radius, metric = self.centers, self.radius, self.metric
        asked = _whole(queries).select("query_id", F.col("embedding").cast("array<double>").alias("v"))
        query_type = asked.schema["query_id"].dataType.simpleString()

        def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """A query's first cells; where ``edge`` is given, those others that may hold rows so near."""
            for pdf in batches:
                if not len(pdf):
                    continue
                y = _scaled(_matrix(pdf["v"].tolist()), metric)
                apart = np.where(radius[None] >= 0, _apart(y, centers), np.inf)
                first = np.argsort(apart, axis=1, kind="stable")[:, :probes]
                near = np.zeros(apart.shape, bool)
                np.put_along_axis(near, first, True, axis=1)
                near &= np.isfinite(apart)
                if "edge" in pdf.columns:
                    edge = pdf["edge"].to_numpy(float)
                    edge = np.sqrt(2 * edge) if metric == "cosine" else edge
                    near = ~near & (apart - radius[None] <= edge[:, None] + 1e-4)
                q, c = np.nonzero(near)
                yield pd.DataFrame({"query_id": pdf["query_id"].to_numpy()[q], "v": pdf["v"].to_numpy()[q], "cell": c.astype(np.int32)})

        kind = f"query_id {query_type}, v array<double>, cell int"
        w = Window.partitionBy("query_id").orderBy("distance", "id")
        best = lambda rows: rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        if not len(centers):
            return self.rows().select(F.lit(None).cast(query_type).alias("query_id"), "id", F.lit(0.0).alias("distance"), F.lit(0).alias("rank"))
        with Scratch(self.spark) as work:
            found = work.keep(best(self._visit(work.keep(asked.mapInPandas(cells, kind), "asked"), k, part_rows)), "first")
            if exact:
                edge = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("edge"))
                more = asked.join(edge, "query_id", "left").withColumn("edge", F.coalesce("edge", F.lit(float("inf"))))
                more = work.keep(more.select("query_id", "v", "edge").mapInPandas(cells, kind), "more")
                found = best(found.drop("rank").unionByName(self._visit(more, k, part_rows)))
            return work.release(found)


def _matrix(rows: list) -> np.ndarray:
    return np.array(rows, float) if len(rows) else np.zeros((0, 1))


def _scaled(x: np.ndarray, metric: str) -> np.ndarray:
    """Unit vectors for the cosine; zero ones stay."""
    size = np.linalg.norm(x, axis=1, keepdims=True) if x.size else np.ones((len(x), 1))
    return x / np.where(size > 0, size, 1) if metric == "cosine" else x


def _apart(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Euclidean distances; of zero vectors among unit ones too."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (centers * centers).sum(1)[None] - 2 * x @ centers.T, 0))


def chunk_context(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits: query_id, id, rank; chunks: id, text. The chunks' texts a query, by rank, with blank lines between."""
    rows = hits.join(chunks, "id")
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n").alias("context"))
