"""Exact top-k inner products by a Voronoi join of queries and data.

1. *Distinct vectors.* Of equal vectors only the ``k + 1`` least ids can be in a result, so
   only these go on, and equal queries are asked once; queries get their own id taken out of
   the ``k + 1`` best at the end. A vector that a third of all rows share so costs nothing.
2. *Cells.* Data and queries are grouped by their nearest of about sqrt(rows) pivots, at most
   ``pivots`` (data rows chosen by a hash). A cell's data are summed up by its count, quantiles
   of the distances to its pivot and the ``k + 1`` least of these.
3. *Bounds.* For a query q, pivot p and a row o at distance d from p, the score q.o lies
   between q.p - |q| d and q.p + |q| d. The lower ends over all cells' least distances
   bound q's (k + 1)-th best score from below; a row of p's cell can then matter to q only if
   d reaches (bound - q.p) / |q|. A query cell needs the rows past the least such reach.
4. *Groups.* Neighbouring query cells share a group as long as they need mostly the same rows
   (by the quantiles) and hold at most ``group_queries`` queries. A row is sent once to every
   group that needs it; groups are solved locally in slices, each query cell against the rows
   it needs; the slices' best are merged.

Scores are exact while they stay under 2**53. Ties go to the smaller id. Unusable vectors
(see ``vectors.packed``) take no part; an id met twice counts once, with its least vector; a
table without usable vectors gives no rows. What has no structure is sent to every group and
compared with every query: bounds cannot help there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch
from tessera.llm.vectors import best_rows, matrix, meet, packed, ranked

QUANTILES = 32


def top_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k greatest scores, ties to the smaller id."""
    ok = np.arange(len(scores))
    if len(ok) > k:
        edge = np.partition(scores, len(ok) - k)[len(ok) - k]
        ok = np.flatnonzero(scores >= edge)
    return ok[np.lexsort([ids[ok], -scores[ok]])][:k]


def _cells(rows: DataFrame, centers: np.ndarray, dim: int) -> DataFrame:
    """Adds the nearest pivot and the distance to it."""
    shared = rows.sparkSession.sparkContext.broadcast(centers)
    schema = pa.schema([("vec_id", pa.int64()), ("vec", pa.binary()), ("cell", pa.int32()), ("dist", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = shared.value
        for rb in batches:
            if rb.num_rows:
                x = matrix(rb.column("vec"), dim)
                cell = ((centers * centers).sum(1)[None] - 2 * x @ centers.T).argmin(1)
                dist = np.sqrt(((x - centers[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([rb.column("vec_id"), rb.column("vec"), pa.array(cell.astype(np.int32)), pa.array(dist)], schema=schema)

    return rows.select("vec_id", "vec").mapInArrow(run, "vec_id long, vec binary, cell int, dist double")


@dataclass
class Summaries:
    """Of the data cells: counts, quantiles of distances (cells x QUANTILES), least distances (with their cells)."""

    count: np.ndarray
    quantile: np.ndarray
    near_cell: np.ndarray
    near_dist: np.ndarray

    def rows_past(self, reach: np.ndarray) -> float:
        """About how many rows lie at or past a reach a cell; a cell's least and greatest distance are exact."""
        share = (self.quantile >= reach[:, None]).mean(1)
        return float((self.count * share).sum())


def least_scores(y: np.ndarray, centers: np.ndarray, cells: Summaries, k: int) -> np.ndarray:
    """A lower bound of every query's k-th best score, -inf where the summaries hold fewer rows."""
    if len(cells.near_dist) < k:
        return np.full(len(y), -np.inf)
    size = np.sqrt((y * y).sum(1))
    low = (y @ centers.T)[:, cells.near_cell] - size[:, None] * cells.near_dist[None]
    return np.partition(low, len(cells.near_dist) - k, axis=1)[:, len(cells.near_dist) - k]


def reaches(y: np.ndarray, least: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """queries x cells: the distance to the cell's pivot from which on its rows can matter."""
    size = np.sqrt((y * y).sum(1))[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (least[:, None] - y @ centers.T) / size
    out = np.where(size > 0, out, -np.inf)
    return out - 1e-9 * (1 + np.abs(np.where(np.isfinite(out), out, 0)))


def query_groups(counts: dict[int, int], reach: dict[int, np.ndarray], centers: np.ndarray, cells: Summaries, most: int) -> dict[int, list[int]]:
    """Query cell -> its groups (several if it holds more than ``most`` queries)."""
    left, out, group, filled, at, own = np.array(sorted(counts)), {}, 0, 0, None, None
    while len(left):
        here = 0 if at is None else int(((centers[left] - centers[at]) ** 2).sum(1).argmin())
        at, left = int(left[here]), np.delete(left, here)
        n = counts[at]
        if own is not None:
            both = np.minimum(own, reach[at])
            apart = cells.rows_past(own) + cells.rows_past(reach[at])
            if filled + n > most or cells.rows_past(both) > 0.75 * apart:
                group, filled, own = group + 1, 0, None
            else:
                own = both
        if own is None:
            own = reach[at]
        parts = -(-n // most)
        out[at] = list(range(group, group + parts))
        group, filled = group + parts - 1, filled + n if parts == 1 else most
    return out


def topk_join(
    table: DataFrame, *, every: int = 50, k: int = 5, scale: float = 256.0, pivots: int = 512, group_queries: int = 4096,
    slice_rows: int = 8192, least_slices: int = 24, report: dict | None = None,
) -> DataFrame:
    """Queries: rows whose vec_id is divisible by ``every``; candidates: all rows but the query's own.

    ``report`` receives the numbers of rows, groups and rows sent."""
    spark = table.sparkSession
    rows, dim = packed(table, floor_scale=scale)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    with Scratch(spark) as work:
        rows = work.keep(rows.drop("norm2"), "vectors")
        same = Window.partitionBy("vec").orderBy("vec_id")
        data = rows.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).drop("r")
        asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
        total = rows.count()
        chosen = rows.orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").limit(min(pivots, max(16, int(total**0.5)))).collect()
        centers = np.unique(np.array([np.frombuffer(r["vec"], np.float64) for r in chosen]), axis=0)
        data = work.keep(_cells(data, centers, dim), "data")
        # equal queries are asked once, by the least of their ids
        queries = asked.groupBy("vec").agg(F.min("vec_id").alias("vec_id"))
        queries = work.keep(_cells(queries, centers, dim), "queries")
        cells = _summaries(data, len(centers), k + 1)
        reach, counts = _cell_reaches(queries, centers, cells, dim, k + 1)
        groups = query_groups(counts, reach, centers, cells, group_queries)
        table_of = np.stack([reach[c] for c in groups])
        members: dict[int, list[int]] = {}
        for i, c in enumerate(groups):
            for g in groups[c]:
                members.setdefault(g, []).append(i)
        # a group's slices by its estimated rows; enough of them over all groups to occupy a cluster
        need = {g: cells.rows_past(table_of[i].min(0)) for g, i in members.items()}
        each = max(256, min(slice_rows, int(sum(need.values()) / least_slices)))
        slices = {g: max(1, -(-int(n) // each)) for g, n in need.items()}
        # pivots x pivots at most, whatever the input
        shared = spark.sparkContext.broadcast((centers, cells, list(groups), table_of, groups, members, slices))
        sent = data.mapInArrow(_sender(shared), "grp int, slices int, vec_id long, vec binary, cell int, dist double")
        placed = queries.mapInArrow(_placer(shared), "grp int, slices int, query_id long, vec binary, cell int")
        if report is not None:
            report |= {"rows": data.count(), "groups": len(members), "sent": sent.count()}
        found = meet(sent, placed, _solver(shared, dim, k + 1), "query_id long, vec_id long, score long")
        found = best_rows(found, k + 1, True).groupBy("query_id").agg(F.collect_list(F.struct("vec_id", "score")).alias("best"))
        of_vector = queries.select("vec", F.col("vec_id").alias("query_id")).join(found, "query_id").select("vec", "best")
        own = asked.select("vec", F.col("vec_id").alias("query_id")).join(of_vector, "vec").select("query_id", F.explode("best").alias("b"))
        own = own.select("query_id", "b.*").where(F.col("query_id") != F.col("vec_id"))
        return work.release(ranked(own, k, True))


def _summaries(data: DataFrame, n: int, least: int) -> Summaries:
    """A row of fixed size a cell, and ``least`` distances a cell."""
    steps = [float(x) for x in np.linspace(0, 1, QUANTILES)]
    got = data.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("dist", steps, 1000).alias("q"), F.max("dist").alias("m")).collect()
    count, quantile = np.zeros(n), np.full((n, QUANTILES), -np.inf)
    for r in got:
        count[r["cell"]], quantile[r["cell"]] = r["n"], r["q"]
        quantile[r["cell"], -1] = r["m"]
    w = Window.partitionBy("cell").orderBy("dist")
    near = data.select("cell", "dist").withColumn("r", F.row_number().over(w)).where(F.col("r") <= least).collect()
    return Summaries(count, quantile, np.array([r["cell"] for r in near], int), np.array([r["dist"] for r in near], float))


def _cell_reaches(queries: DataFrame, centers: np.ndarray, cells: Summaries, dim: int, k: int) -> tuple[dict[int, np.ndarray], dict[int, int]]:
    """Per query cell the least reach into every data cell, and its number of queries."""
    shared = queries.sparkSession.sparkContext.broadcast((centers, cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, cells = shared.value
        best: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        for rb in batches:
            if rb.num_rows:
                own, all_ = matrix(rb.column("vec"), dim), rb.column("cell").to_numpy()
                for a in range(0, len(own), 1024):
                    y, cell = own[a : a + 1024], all_[a : a + 1024]
                    out = reaches(y, least_scores(y, centers, cells, k), centers)
                    for c in np.unique(cell).tolist():
                        here = out[cell == c]
                        best[c] = np.minimum(best[c], here.min(0)) if c in best else here.min(0)
                        count[c] = count.get(c, 0) + len(here)
        for c, line in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(line), c, np.int32)), pa.array(np.arange(len(line), dtype=np.int32)), pa.array(line), pa.array(np.full(len(line), count[c], np.int64))],
                names=["cell", "pivot", "reach", "n"],
            )

    got = queries.mapInArrow(run, "cell int, pivot int, reach double, n long").groupBy("cell", "pivot").agg(F.min("reach").alias("reach"), F.sum("n").alias("n")).toArrow()
    cell, pivot, reach, n = (got[c].to_numpy() for c in ("cell", "pivot", "reach", "n"))
    lines = {c: np.full(len(centers), np.inf) for c in np.unique(cell).tolist()}
    for c in lines:
        lines[c][pivot[cell == c]] = reach[cell == c]
    return lines, {c: int(n[cell == c][0]) for c in lines}


def _sender(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, _, table_of, _, members, slices = shared.value
        least = {g: table_of[i].min(0) for g, i in members.items()}
        for rb in batches:
            cell, dist = rb.column("cell").to_numpy(), rb.column("dist").to_numpy()
            for g, reach in least.items():
                at = np.flatnonzero(dist >= reach[cell])
                if len(at):
                    part = rb.take(pa.array(at))
                    fixed = [pa.array(np.full(len(at), v, np.int32)) for v in (g, slices[g])]
                    yield pa.RecordBatch.from_arrays([*fixed, *part.columns], names=["grp", "slices", *part.schema.names])

    return run


def _placer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, slices = shared.value[4], shared.value[6]
        for rb in batches:
            mixed = (rb.column("vec_id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).tolist()
            own = [groups[c][i % len(groups[c])] for i, c in zip(mixed, rb.column("cell").to_pylist(), strict=True)]
            columns = [pa.array(own, pa.int32()), pa.array([slices[g] for g in own], pa.int32()), rb.column("vec_id"), rb.column("vec"), rb.column("cell")]
            yield pa.RecordBatch.from_arrays(columns, names=["grp", "slices", "query_id", "vec", "cell"])

    return run


def _solver(shared, dim: int, k: int):
    def solve(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(d) and len(q):
            order, table_of = shared.value[2], shared.value[3]
            line_of = {c: i for i, c in enumerate(order)}
            ids, x, cell, dist = d["vec_id"].to_numpy(), matrix(d["vec"], dim), d["cell"].to_numpy(), d["dist"].to_numpy()
            asked, y, of = q["query_id"].to_numpy(), matrix(q["vec"], dim), q["cell"].to_numpy()
            for c in np.unique(of).tolist():
                here, rows = np.flatnonzero(of == c), np.flatnonzero(dist >= table_of[line_of[c]][cell])
                for a in range(0, len(here) if len(rows) else 0, 256):
                    which = here[a : a + 256]
                    for name, line in zip(asked[which].tolist(), y[which] @ x[rows].T, strict=True):
                        out += [(name, int(ids[rows[b]]), int(line[b])) for b in top_rows(line, ids[rows], k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return solve
