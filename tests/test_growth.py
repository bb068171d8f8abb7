"""What jobs leave on disk, and how they are cut into parts, on tables small enough to count."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import runtime
from tessera.operators import resolution, retrieval, temporal, vectors
from tessera.plans import catalogue, source_queries, time_queries
from tessera.plans.star_graph import star_graph
from tessera.streaming import incremental
from tests import compare
from tests.conftest import SMALL


@pytest.mark.parametrize("name", ["stream_vec_sync", "er_remap_edges", "ret_path_nodes"])
def test_queries_in_slices_equal_their_sql(spark, monkeypatch, name):
    query = catalogue.QUERIES[name]
    monkeypatch.setitem(query.__globals__, "slices", lambda rows: 3)
    assert compare.differ(spark, SMALL, query, catalogue.ORACLE_SQL[name]) is None


def test_a_synced_index_takes_a_batch_in_passes(spark):
    asked = []

    def embed(rows):
        asked.append(rows.count())
        return vectors.embed(rows, lambda texts: [[float(len(t))] for t in texts])

    kind = "graph_id string, id string, document string, metadata map<string,string>"
    versions = [{i: "d" * (1 + (i * k) % 7) for i in range(40 * k, 400)} for k in (1, 2, 3)]
    versions[1][399] = None
    tables = [spark.createDataFrame([("g", f"{i}", d, {"k": "v", "n": f"{i % 2}"}) for i, d in v.items()], kind) for v in versions]
    index = incremental.SyncedIndex(runtime.scratch(spark, "index"), embed, buckets=8, compact_every=2, passes=3)
    for n, now in enumerate(tables):
        feed = incremental.changes(tables[n - 1] if n else None, now, n)
        index.put(feed, n)
        index.put(feed, n)  # a batch that is run again
        assert {r["id"]: r["document"] for r in index.read(spark, n).collect()} == {f"{i}": d for i, d in versions[n].items()}
        parts = [index.read(spark, n, at, ["document"]) for at in range(3)]
        assert sorted(r["id"] for p in parts for r in p.collect()) == sorted(f"{i}" for i in versions[n])
    assert len(asked) == 3 * 2 * 3 and sum(asked[:3]) == 360 and max(asked) < 200


def test_marks_tell_contents_apart(spark):
    rows = [("d", {"a": "1", "b": "2"}), ("d", {"a": "2", "b": "1"}), ("d", {"a": "1"}), (None, {"a": "1"}), ("", {"a": "1"}), ("d", None), (None, None)]
    table = spark.createDataFrame(rows, "document string, metadata map<string,string>")
    assert table.select(vectors.content_mark()).distinct().count() == len(rows)
    swapped = spark.createDataFrame([("d", {"b": "2", "a": "1"})], table.schema)
    assert swapped.select(vectors.content_mark()).first() == table.select(vectors.content_mark()).first()


def test_a_synced_index_leaves_only_its_result(spark):
    with runtime.discarding_results(spark):
        found = source_queries.stream_vec_sync(spark, SMALL)
        there = [p for p in runtime._results.get() if runtime.names_in(spark, p)]
        assert len(there) == 1 and found.count() > 0


def test_gathered_parts_are_one_table(spark):
    with runtime.Scratch(spark) as work:
        keys = spark.range(100).select(F.col("id").cast("string").alias("id"))
        found = work.gather((keys.where(runtime.in_slice(["id"], k, 5)) for k in range(5)), "keys")
        assert sorted(int(r["id"]) for r in found.collect()) == list(range(100))
    assert [runtime.slices(n) for n in (0, 999_999, 5_000_000, 10**9)] == [1, 1, 5, 16]


def test_states_of_one_interval_meet_lists_of_queries(spark):
    levels = spark.createDataFrame([("g", f"e{i}", i) for i in range(6)], "graph_id string, id string, level int")
    # equal rows among them; an end before the start; a node that is null
    states = [("g", None if i == 7 else f"n{i % 90}", f"e{i % 4}" if i % 5 else None, f"e{(i * 3) % 6}" if i % 7 else None) for i in range(300)]
    asked = [("g", q, None if q % 6 == 1 else q % 7, None if q % 6 == 2 else 5 - q % 4) for q in range(50)]
    given = spark.createDataFrame(states, "graph_id string, node string, start string, end string"), levels, spark.createDataFrame(asked, "graph_id string, query_id long, left int, right int")
    want = []
    for _, q, left, right in asked:
        low, high = sorted((0 if left is None else left, 5 if right is None else right))
        for _, node, start, end in states:
            a, b = int(start[1:]) if start else 0, int(end[1:]) if end else 5
            if a <= min(high, 5) and b >= low and low <= 5:
                want.append((q, "g", node, start, end))
    for n in (4, 512):
        got = temporal.states_within(*given, list_rows=n)
        assert got.columns == ["query_id", "graph_id", "node", "start", "end"]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 2  # not a row a piece and pair


@pytest.mark.parametrize("threshold, clustered", [(0.2, False), (0.9, True)])
def test_vectors_that_visit_most_cells_are_not_copied_to_them(spark, threshold, clustered):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16)) if not clustered else rng.normal(size=(30, 16))[rng.integers(0, 30, 600)] + 0.1 * rng.normal(size=(600, 16))
    rows = [("g", "t", i, i, f"v{i % 7}", v.tolist()) for i, v in enumerate(x)]
    nodes = spark.createDataFrame(rows, "graph_id string, type string, id long, ord long, name string, embedding array<float>")
    got = resolution.similar_pairs(nodes, threshold, part_rows=200, carry=["name"])
    x = x.astype(np.float32).astype(float)
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    i, j = np.nonzero(np.triu(unit @ unit.T >= threshold, 1))
    assert {(r["a"], r["b"], r["a_name"], r["b_name"]) for r in got.collect()} == {(a, b, f"v{a % 7}", f"v{b % 7}") for a, b in zip(i.tolist(), j.tolist())}
    cells = {r["cell"] for r in spark.createDataFrame(_cells(got), "cell int").collect()}
    assert (len(cells) == 1) != clustered


def _cells(pairs):
    """The cells that pairs are found in."""
    plan = pairs._jdf.queryExecution().analyzed()
    child = plan.children().apply(0)
    from pyspark.sql import DataFrame

    rows = DataFrame(pairs.sparkSession._jvm.org.apache.spark.sql.classic.Dataset.ofRows(pairs.sparkSession._jsparkSession, child), pairs.sparkSession)
    return [(r["cell"],) for r in rows.select("cell").distinct().collect()]


def test_names_of_pairs_take_no_join(spark):
    rows = [("g", "t", i, i, f"name {i % 3}", [1.0, i / 50]) for i in range(40)]
    nodes = spark.createDataFrame(rows, "graph_id string, type string, id long, ord long, name string, embedding array<double>")
    plan = resolution.hybrid_pairs(nodes)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("levenshtein") < plan.index("FlatMapGroupsInPandas") and "Join" not in plan[: plan.index("FlatMapGroupsInPandas")]


def test_paths_in_parts_leave_whole_paths_only(spark):
    rng = random.Random(5)
    pairs = sorted({(f"n{rng.randrange(30)}", f"n{rng.randrange(40)}") for _ in range(90)})  # n30 on are dead ends
    edges = spark.createDataFrame([(f"{a}>{b}", a, b) for a, b in pairs], "id string, source string, target string")
    starts = spark.createDataFrame([(i % 6, f"n{i}", f"n{39 - i}") for i in range(12)] + [(9, "n1", "n1")], "query_id long, start string, stop string")
    with runtime.discarding_results(spark):
        one, three = (retrieval.paths(starts, edges, parts=n) for n in (1, 3))
        rows = lambda df, *c: sorted((r["query_id"], r["start"], r["stop"], *(tuple(r[x]) for x in c), round(r["score"], 9)) for r in df.collect())
        bare = retrieval.paths(starts, edges, parts=3, edge_ids=False)
        assert rows(one, "nodes", "edges") == rows(three, "nodes", "edges") and rows(bare, "nodes") == rows(one, "nodes")
        assert one.count() > 5 and "edges" not in bare.columns and len(runtime._results.get()) == 3
    step = lambda n: [b for a, b in pairs if a == n]
    want, now = [], [(r["query_id"], r["stop"], (r["start"],), 1.0) for r in starts.collect()]
    for _ in range(6):
        want += [w for w in now if w[2][-1] == w[1]]
        now = [(q, stop, (*way, b), s) for q, stop, way, x in now if way[-1] != stop for b in step(way[-1]) if b not in way and (s := 0.7 * x / len(step(way[-1]))) >= 0.01]
    with runtime.discarding_results(spark):
        assert rows(retrieval.paths(starts, edges, parts=2), "nodes") == sorted((q, w[0], stop, w, round(s, 9)) for q, stop, w, s in want)


@pytest.mark.parametrize("most", [0, 500_000])
def test_what_is_near_is_found_round_by_round(spark, most):
    rng = random.Random(9)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(80)}") for _ in range(110)]
    edges = spark.createDataFrame(pairs, "source string, target string")
    entries = spark.createDataFrame([(1, "n1"), (2, "n2"), (2, "n1"), (3, "n99")], "query_id long, id string")
    want, front = {"n1", "n2", "n99"}, {"n1", "n2", "n99"}
    for steps in range(5):
        with runtime.Scratch(spark) as work:
            assert {r["id"] for r in retrieval.reachable(entries, edges, steps, work, most).collect()} == want
        front = {b for a, b in pairs if a in front} - want
        want = want | front
    assert 10 < len(want) < 60


def test_contexts_keep_only_what_is_near(spark):
    graph = star_graph(spark, SMALL)
    with time_queries._asking_near(spark, SMALL, graph) as a:
        every, near = graph.edges.count(), a.edges.count()
        assert 0 < near < every / 4
        # all edges out of a node, or none
        degree = lambda df: df.groupBy("source").agg(F.count("*").alias("d"))
        assert degree(a.edges).exceptAll(degree(graph.edges)).isEmpty()
        assert a.entries.join(graph.edges, a.entries["id"] == graph.edges["source"]).count() == a.entries.join(a.edges, a.entries["id"] == a.edges["source"]).count() > 0
        ends = a.edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
        assert ends.join(a.nodes, "id", "left_anti").count() <= ends.count() / 4  # ends of the last step only


def test_events_of_one_history_stay_where_they_are(spark):
    rng = random.Random(3)
    rows = [(1, f"e{i}", i % 50, " ".join(["word"] * rng.randrange(4))) for i in range(400)]
    events = spark.createDataFrame(rows, "query_id long, id string, level int, text string")
    own = retrieval.history(events, 60, few_queries=True)
    assert own.collect() == retrieval.history(events, 60).collect()
    assert "SortMergeJoin" not in own._jdf.queryExecution().sparkPlan().toString() and "ShuffledHashJoin" not in own._jdf.queryExecution().sparkPlan().toString()


def test_timed_edges_need_only_the_levels_of_their_own_times(spark):
    graph = star_graph(spark, SMALL)
    levels = runtime.materialize(time_queries._levels(spark, SMALL))
    with time_queries._asking_near(spark, SMALL, graph) as a:
        rows = a.work.keep(time_queries._timed(a.edges), "rows")
        # the ends are those that the whole graph gives, for all edges that a path can hold
        inner = retrieval.reachable(a.entries, graph.edges, 4, a.work).withColumnRenamed("id", "source")
        cut = lambda df: df.join(inner, "source", "left_semi").select("id", "time_start_event", "time_end_event")
        assert cut(rows).exceptAll(cut(time_queries._timed(graph.edges))).isEmpty() and cut(rows).count() == cut(graph.edges.withColumns({"time_start_event": F.lit(0), "time_end_event": F.lit(0)})).count() > 0
        times = rows.select(F.explode(F.array("time_start_event", "time_end_event")).alias("id")).where("id is not null").distinct()
        known = levels.join(times, "id", "left_semi")
        assert 0 < known.count() < levels.count() / 2
        few, every = (temporal.edges_as_of(rows, lv, 3, 1).select("id", "mark") for lv in (known, levels))
        assert few.exceptAll(every).isEmpty() and few.count() == every.count() < rows.count()
