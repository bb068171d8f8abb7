"""Small cases with known answers."""

import os
import random
import threading
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import runtime
from tessera.functions import models
from tessera.operators import annotation, build, chunking, evaluation, extraction, merge, resolution, responses, retrieval, vectors
from tessera.operators.graph import Graph, put_edges, remove_nodes, repair_dangling
from tessera.plans import catalogue, source_queries, text_queries
from tessera.sources import files
from tessera.streaming import incremental
from tests import compare
from tests.conftest import SMALL


def sequential(ids, sim, best):
    """Clusters one by one, in order."""
    leaders, out = [], {}
    for i in ids:
        near = [(sim[frozenset((i, x))], x) for x in leaders if frozenset((i, x)) in sim]
        out[i] = i if not near else (max(near, key=lambda p: (p[0], -p[1]))[1] if best else near[0][1])
        if not near:
            leaders.append(i)
    return out


@pytest.mark.parametrize("best", [False, True])
def test_clusters_equal_sequential_ones(spark, best):
    rng = random.Random(5)
    sim = {frozenset((a, b)): round(rng.random(), 3) for a in range(60) for b in range(a) if rng.random() < 0.08}
    nodes = spark.createDataFrame([("g", i) for i in range(60)], "graph_id string, id long")
    pairs = spark.createDataFrame([("g", min(p), max(p), s, min(p), max(p)) for p, s in sim.items()], "graph_id string, a long, b long, similarity double, oa long, ob long")
    got = {r["id"]: r["leader"] for r in resolution.clusters(nodes, pairs, best).collect()}
    assert got == sequential(range(60), sim, best)


def test_chunks_equal_their_sql(spark, tmp_path):
    """Kinds of white space that the given texts lack, texts without any, and texts of just a chunk's size."""
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice(["word", "a", "long" * 30, " ", " ", "\n", "\n\n", "\n\n\n", "жук"]) for _ in range(n))
    texts = [some(rng.randrange(1, 900)) for _ in range(40)] + [None, "", " ", "\n\n", "x" * 500, "x" * 501, "x" * 2000 + " y " + "z" * 499, " " * 1300, ("a" * 499 + " ") * 5]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    (tmp_path / "sql").mkdir()
    one = spark.read.parquet(str(tmp_path / "documents.parquet")).toPandas()
    one.to_parquet(tmp_path / "sql" / "documents.parquet")
    name = "chunk_split"
    assert compare.differ(spark, str(tmp_path / "sql"), catalogue.QUERIES[name], catalogue.ORACLE_SQL[name]) is None


def test_chunks_keep_the_text():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice([" ", "\n", "\n\n"]) if rng.random() < 0.3 else chr(0x4E00 + k) for k in range(rng.randrange(0, 400)))
        assert "".join(chunking.pieces(text, 20)) == text
        out = chunking.chunks_of(text, 40, 10)
        assert all(0 < len(c) <= 40 for c in out)
        at = 0
        for c in out:  # each chunk begins at most 10 characters before the end of the one before
            at = min(e for k in range(min(10, at) + 1) if text[at - k :].startswith(c) and (e := at - k + len(c)) > at)
        assert at == len(text)


def test_packing_passes_over_what_does_not_fit(spark):
    items = spark.createDataFrame([(1, "a", 3.0, 5, "x"), (1, "b", 2.0, 9, "y"), (1, "c", 1.0, 4, "z")], "query_id int, id string, score double, tokens long, text string")
    got = retrieval.pack(items, spark.createDataFrame([(1, 10)], "query_id int, budget int")).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["place"])] == ["a", "c"]


def plain_pack(items, budgets):
    out, left = [], dict(budgets)
    for q, i, score, tokens, text in sorted(items, key=lambda r: (r[0], -r[2], r[1], r[3] or 0, r[4])):
        if left.get(q) is not None and (tokens or 0) <= left[q]:
            left[q] -= tokens or 0
            out.append((q, sum(o[0] == q for o in out), i, text, tokens or 0))
    return sorted(out)


def test_packing_equals_a_plain_fold(spark):
    rng = random.Random(7)
    items = [(q, f"i{n}", float(rng.randrange(20)), rng.choice([None, 0, 1, 2, 3, 5, 8, 40, 90, 300]), f"t{n}") for q in range(9) for n in range(rng.randrange(1, 150))]
    budgets = [(q, rng.choice([0, 1, 10, 100, 250])) for q in range(8)] + [(20, 5)]
    table = spark.createDataFrame(items, "query_id int, id string, score double, tokens long, text string")
    got = retrieval.pack(table, spark.createDataFrame(budgets, "query_id int, budget int"), salts=3)
    assert sorted((r["query_id"], r["place"], r["id"], r["text"], r["tokens"]) for r in got.collect()) == plain_pack(items, budgets)
    assert retrieval.pack(table.limit(0), spark.createDataFrame(budgets, "query_id int, budget int")).count() == 0


def test_packing_of_a_million_candidates(spark):
    n = F.col("n")
    items = spark.range(1_000_000).withColumnRenamed("id", "n").select(F.lit(1).alias("query_id"), n.cast("string").alias("id"), (-n).cast("double").alias("score"), (n * 7919 % 211 + 3).alias("tokens"), F.lit("text").alias("text"))
    got = retrieval.pack(items, spark.createDataFrame([(1, 1000)], "query_id int, budget int"))
    want, left = [], 1000
    for i in range(1_000_000):
        t = i * 7919 % 211 + 3
        if t <= left:
            want.append(f"{i}")
            left -= t
    assert [r["id"] for r in sorted(got.collect(), key=lambda r: r["place"])] == want


def test_replies_are_asked_once_and_outlive_a_lost_worker(spark, tmp_path):
    asked, broken = str(tmp_path / "asked"), str(tmp_path / "broken")

    def ask(prompts):
        if "p7" in prompts and os.path.exists(broken):
            os.remove(broken)
            os._exit(1)  # the worker is gone, and with it the task
        with open(asked, "a") as f:
            f.writelines(p + "\n" for p in prompts)
        if "bad" in prompts:
            raise ValueError
        return [p.upper() for p in prompts]

    rows = [(i, f"p{i % 40}") for i in range(120)] + [(200, None), (201, ""), (202, "bad")]
    prompts, path = spark.createDataFrame(rows, "k int, prompt string"), runtime.scratch(spark, "replies")
    open(broken, "w").close()
    with pytest.raises(Exception, match="[Ww]orker|EOF|crashed"):
        models.generate_stored(prompts, ask, path, round_prompts=5).collect()
    before = open(asked).read().split("\n") if os.path.exists(asked) else []
    got = {r["k"]: (r["raw"], r["status"]) for r in models.generate_stored(prompts, ask, path, round_prompts=5).collect()}
    assert got == {i: (f"P{i % 40}", "ok") for i in range(120)} | {200: ("", "ok"), 201: ("", "ok"), 202: (None, "failed")}
    again = open(asked).read().split("\n")
    counts = {p: again.count(p) for p in {f"p{i}" for i in range(40)}}
    assert set(counts.values()) <= {1, 2} and sum(v == 2 for v in counts.values()) <= 16  # of the rounds with the lost task and the failing prompt only
    assert len(before) > 1 or not before
    models.generate_stored(prompts, ask, path).collect()
    assert {p for p in open(asked).read().split("\n")[len(again) - 1 :]} <= {"bad", ""}


def test_repair_of_replies():
    assert responses.repair_text('so {a} ```json\n{"u": "http://x" // why\n}\n```') == '{"u": "http://x" \n}'
    assert responses.repair_text('first {"a": 1} then {"b": 2} end') == '{"b": 2}'
    assert responses.readable(responses.repair_text('x {"a": "v" (note), /* c */ "b": 1} # y'))
    assert responses.repair_text(None) == responses.repair_text("none") == ""


def plain_history(events, budget):
    import hashlib

    events = sorted(set(events))
    size = lambda e: len((e[2] or "").split())
    left, gone = sum(map(size, events)), set()
    for e in sorted(events[1:-1], key=lambda e: hashlib.md5(f"7{e[1]}".encode()).hexdigest()):
        if left > budget:
            gone.add(e)
            left -= size(e)
    return "\n".join(e[2] for e in events if e not in gone)


def test_history_over_budget_equals_a_plain_fold(spark):
    rng = random.Random(9)
    for budget in (0, 3, 30, 1000):
        events = [(q, lv, f"{q}e{lv}", "w " * (1 + lv * 7 % 5) * (q < 2)) for q in (1, 2) for lv in range(40)]
        events += [(3, 0, "a", "word"), *[(3, i, f"m{i}", "") for i in range(1, 9)], (3, 9, "n", "word"), (3, 10, "z", "word"), (4, 0, "only", "one two"), (4, 0, "only", "one two")]
        events += [(5, i, f"x{i}", rng.choice(["", "", "a", "a b c d"])) for i in range(60)]
        table = spark.createDataFrame(events, "query_id int, level int, id string, text string")
        want = {q: plain_history([e[1:] for e in events if e[0] == q], budget) for q in range(1, 6)}
        assert {r["query_id"]: r["text"] for r in retrieval.history(table, budget).collect()} == want
        assert {r["query_id"]: r["text"] for r in retrieval.history(table.withColumn("b", F.lit(budget)), F.col("b")).collect()} == want


def test_prompts_with_relations_and_references(spark):
    chunks = spark.createDataFrame([(1, "t"), (2, "u")], "chunk_id int, text string")
    names = spark.createDataFrame([(1, "b"), (1, "a")], "chunk_id int, name string")
    said = spark.createDataFrame([(1, "a", "knows", "b")], "chunk_id int, source string, relation string, target string")
    refs = spark.createDataFrame([(1, "she", "a")], "chunk_id int, mention string, name string")
    got = {r["chunk_id"]: r["prompt"] for r in extraction.prompt_rows(chunks, names, relations=said, references=refs).collect()}
    assert got[1] == "Text fragment:\nt\n\nEntities in chunk:\na, b\n\nCoreference:\nshe -> a\n\nRelations in chunk:\na knows b"
    assert got[2].endswith("Relations in chunk:\n")


def test_metrics_of_known_texts(spark):
    df = spark.createDataFrame([("a b a b a",), ("",), ("one two three",)], "t string")
    got = df.select(evaluation.distinct_n(F.col("t")).alias("d"), evaluation.repetition_n(F.col("t")).alias("r")).collect()
    assert [(r["d"], r["r"]) for r in got] == [(0.5, 0.5), (0.0, 0.0), (1.0, 0.0)]


def test_spans_without_overlap(spark):
    df = spark.range(1).select(annotation.without_overlap(F.expr("array(struct(0 as start, 4 as end, 'a' as label), struct(3 as start, 10 as end, 'b' as label), struct(10 as start, 12 as end, 'c' as label))")).alias("x"))
    assert [(s["start"], s["end"]) for s in df.first()["x"]] == [(3, 10), (10, 12)]


def test_graph_tables(spark):
    nodes = spark.createDataFrame([("g", "a", "A", "item"), ("g", "b", "B", "item")], "graph_id string, id string, name string, type string")
    edges = spark.createDataFrame([("g", "e1", "a", "b", "r", 1.0), ("g", "e2", "a", "x", "r", 1.0)], "graph_id string, id string, source string, target string, relation string, weight double")
    g = Graph(nodes, edges)
    assert {r["id"] for r in repair_dangling(g).nodes.collect()} == {"a", "b", "x"}
    assert {r["id"] for r in remove_nodes(g, nodes.where("id = 'b'")).edges.collect()} == {"e2"}
    new = edges.where("id = 'e1'").withColumn("id", F.lit("e3")).withColumn("weight", F.lit(9.0))
    assert {(r["id"], r["weight"]) for r in put_edges(g, new).edges.collect()} == {("e2", 1.0), ("e3", 9.0)}


def test_stream_equals_batch(spark):
    stream = {tuple(r) for r in source_queries.stream_chat_window(spark, SMALL).select("conv_id", "n", "context").collect()}
    assert stream == {tuple(r) for r in text_queries.chat_window(spark, SMALL).select("conv_id", "n", "context").collect()} | {r for r in stream if r[1] == 0}


@pytest.mark.parametrize("threshold", [0.3, 0.9])
def test_similar_pairs_lose_none(spark, threshold):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(9, 12))[rng.integers(0, 9, 400)] + 0.3 * rng.normal(size=(400, 12))
    x[7], x[8] = 0, x[9]
    rows = [("g", str(i % 2 if i < 300 else 0), i, (i * 37) % 400, None if i == 11 else x[i].tolist()) for i in range(400)]
    nodes = spark.createDataFrame(rows, "graph_id string, type string, id long, ord long, embedding array<double>")
    got = {(r["a"], r["b"]): r["similarity"] for r in resolution.similar_pairs(nodes, threshold, pivots=20, part_rows=40).collect()}
    unit = x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None]
    want = {(p[2], q[2]): float(unit[p[2]] @ unit[q[2]]) for p in rows for q in rows if p[1] == q[1] and p[3] < q[3] and p[4] and q[4] and p[2] != 7 and q[2] != 7}
    want = {k: v for k, v in want.items() if v >= threshold}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items()) and len(want) > 100
    assert resolution.similar_pairs(nodes.limit(0), threshold).count() == 0


def test_merged_nodes_keep_their_states_in_order(spark):
    kind = "graph_id string, id string, ord int, name string, type string, base_description string, base_attributes map<string,string>, chunk_id array<long>, states array<struct<d:string,m:map<string,string>>>"
    rows = [("g", "a", 2, "Ann", "character", "late", {"x": "2"}, [3], [("s3", {"k": "v"})]), ("g", "b", 1, "Anna", "character", "early", {"x": "1", "y": "1"}, [1], [("s1", {}), ("s2", {})])]
    members = spark.createDataFrame([("g", "a", "b", 0.9), ("g", "b", "b", 1.0)], "graph_id string, id string, leader string, similarity double")
    r = resolution.combine(spark.createDataFrame(rows, kind), members).first()
    assert [s["d"] for s in r["states"]] == ["s1", "s2", "s3"] and r["merge_similarity"] == 0.9
    assert (r["id"], r["name"], r["base_description"], r["base_attributes"], r["chunk_id"]) == ("b", "Anna", "late", {"x": "2", "y": "1"}, [1, 3])


def test_suffixes_run_on_over_buckets_of_chunks(spark):
    rows = [("g", c, p, "Inn" if (c + p) % 2 else "Ann") for c in range(40) for p in range(5)]
    entities = spark.createDataFrame(rows, "graph_id string, chunk_id long, pos int, name string")
    taken = spark.createDataFrame([("g", "inn", 3)], "graph_id string, base_id string, used long")
    for first, used in (({}, None), ({"inn": 3}, taken)):
        got = {(r["chunk_id"], r["pos"]): r["id"] for r in extraction.entity_nodes(entities, used, bucket_chunks=7).collect()}
        seen = dict(first)
        for _, c, p, name in rows:
            base, n = name.lower(), seen.get(name.lower(), 0)
            assert got[c, p] == (base if n == 0 else f"{base}_{n}")
            seen[base] = n + 1


def test_versions_of_a_table_keep_the_latest_rows(spark):
    store = incremental.merge_into(runtime.scratch(spark, "versions"), compact_every=3)
    held = {}
    for n in range(8):
        batch = [("g", f"{i % 5}", i, f"{n}:{i}") for i in range(n, n + 4)]
        for _ in range(2):  # a batch that is run again
            store.put(spark.createDataFrame(batch, "graph_id string, id string, ord int, name string"), n)
        held |= {i: name for _, i, _, name in batch}
        assert {r["id"]: r["name"] for r in store.read(spark, n).collect()} == held


def test_csv_rows_are_numbered_by_file(spark):
    path = runtime.scratch(spark, "csv").removeprefix("file://")
    os.makedirs(path)
    for f in "ab":
        with open(f"{path}/{f}.csv", "w") as out:
            out.write("k,v\n" + "".join(f'{f}{i},"x\ny{i}"\n' for i in range(30)))
    got = sorted((r["source"][-5], r["row_index"], r["text"]) for r in files.load_csv(spark, f"file://{path}/*.csv", ["k", "v"]).collect())
    assert got == [(f, i, f"{f}{i}\nx\ny{i}") for f in "ab" for i in range(30)]


def test_export_refuses_what_does_not_fit_a_row(spark):
    nodes = spark.createDataFrame([("g", str(i)) for i in range(5)], "graph_id string, id string")
    edges = spark.createDataFrame([("g", "e")], "graph_id string, id string")
    assert files.export_graph(Graph(nodes, edges), most=6).count() == 1
    with pytest.raises(ValueError, match="more than 5"):
        files.export_graph(Graph(nodes, edges), most=5)


def test_a_query_does_not_find_its_own_row(spark):
    rows = spark.createDataFrame([(i, [1.0, i / 10], f"m{i}") for i in range(6)], "id long, embedding array<double>, mark string")
    asked = rows.where("id = 2").select(F.col("id").alias("query_id"), "embedding")
    got = vectors.top_k(rows, asked, 2, metadata=["mark"], skip_own=True, slices=3).orderBy("rank").collect()
    assert [(r["id"], r["rank"], r["mark"]) for r in got] == [(3, 1, "m3"), (1, 2, "m1")]
    assert sorted(r["id"] for r in vectors.ids(rows.union(rows)).collect()) == list(range(6))


def test_scratch_tables_go_and_settings_stay(spark):
    before = spark.conf.get(runtime._CLEANUP, None)
    there = lambda path: os.path.isdir(path.removeprefix("file://"))
    with runtime.discarding_results(spark):
        with runtime.Scratch(spark) as work:
            kept, gone = work.keep(spark.range(5).toDF("v"), "t"), work.keep(spark.range(0).toDF("v"), "t")
            paths = [work._paths[id(t)][1] for t in (kept, gone)]
            assert gone.count() == 0 and all(map(there, paths))
            work.drop(gone)
            assert not there(paths[1]) and there(paths[0])
            result = work.release(kept.where("v > 2"))
            own = runtime._results.get()[-1]
        assert not there(paths[0]) and there(own) and result.count() == 2
    assert not there(own)
    with pytest.raises(ZeroDivisionError):
        with runtime.Scratch(spark) as work:
            path = work._paths[id(work.keep(spark.range(3), "t"))][1]
            raise ZeroDivisionError
    assert not there(path)
    threads = [threading.Thread(target=runtime.materialize, args=(spark.range(n + 1), "t")) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert spark.conf.get(runtime._CLEANUP, None) == before


def test_results_of_other_threads_stay(spark):
    found = []
    with runtime.discarding_results(spark):
        thread = threading.Thread(target=lambda: found.append(runtime.materialize(spark.range(3), "t")))
        thread.start()
        thread.join()
        path = runtime.scratch(spark, "mine")
        spark.range(2).write.parquet(path)
        with runtime.discarding_results(spark):
            inner = runtime.materialize(spark.range(5), "t")
        outer = runtime.materialize(spark.range(4), "t")
        assert outer.count() == 4
    assert found[0].count() == 3
    for gone in (inner, outer):
        with pytest.raises(Exception, match="exist|NOT_FOUND|No such"):
            gone.collect()
    assert not runtime.names_in(spark, path)


def test_tables_of_a_pool_belong_to_who_asks(spark):
    with runtime.discarding_results(spark), runtime.Scratch(spark) as work, ThreadPoolExecutor(2) as pool:
        jobs = [runtime.submit(pool, lambda n=n: work.keep(spark.range(n), "t")) for n in range(4)]
        result = runtime.submit(pool, lambda: runtime.materialize(spark.range(7), "t"))
        assert [j.result().count() for j in jobs] == [0, 1, 2, 3] and result.result().count() == 7
    for gone in (jobs[3], result):
        with pytest.raises(Exception, match="exist|NOT_FOUND|No such"):
            gone.result().collect()


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Bare:
        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        runtime.shared_dir(Bare)


ENTITY = "graph_id string, chunk_id long, pos int, name string, type string, description string"
RELATION = "graph_id string, chunk_id long, pos int, node1 string, node2 string, relation_from1to2 string, relation_from2to1 string, description string, weight double"


def test_builds_merge_names_and_keep_edges(spark):
    told = [("g", 1, 0, "Ann", "character", "a"), ("g", 1, 1, "Bob", "character", "b"), ("g", 2, 0, "ann", "character", "later"), ("g", 2, 1, "Inn", "location", ""), ("h", 1, 0, "Ann", "character", "other")]
    said = [("g", 1, 0, "Ann", "Bob", "knows", "is known by", "", 1.0), ("g", 2, 0, "ann", "Inn", "stays at", "hosts", "", 1.0), ("g", 2, 1, "ann", "nobody", "sees", "is seen by", "", 1.0)]
    entities, relations = spark.createDataFrame(told, ENTITY), spark.createDataFrame(said, RELATION)
    missing = spark.createDataFrame([("g", 3, 0, "Bob", "group", "a band")], ENTITY)
    g = build.from_entities(entities, relations, missing=missing)
    assert {(r["graph_id"], r["id"]): (r["base_description"], r["chunk_id"]) for r in g.nodes.collect()} == {
        ("g", "ann"): ("later", [1, 2]), ("g", "bob"): ("b", [1]), ("g", "bob_1"): ("a band", [3]), ("g", "inn"): ("", [2]), ("h", "ann"): ("other", [1])
    }
    ends = {("ann", "knows", "bob"), ("bob", "is known by", "ann"), ("ann", "stays at", "inn"), ("inn", "hosts", "ann")}
    assert {(r["source"], r["relation"], r["target"]) for r in g.edges.collect()} == ends
    names = entities.where("name <> 'Inn'")
    n = build.from_names(names, entities, relations)
    assert {(r["graph_id"], r["id"]): (r["description"], r["chunk_id"]) for r in n.nodes.collect()} == {
        ("g", "ann"): ("later", [1, 2]), ("g", "bob"): ("b", [1]), ("g", "inn"): ("", [2]), ("h", "ann"): ("other", [1])
    }
    assert {(r["source"], r["relation"], r["target"]) for r in n.edges.collect()} == ends
    m = build.from_mentions(names.withColumnRenamed("name", "text"), entities, relations)
    assert {r["id"] for r in m.nodes.collect()} == {"ann", "bob", "inn"} and m.edges.count() == 4
    assert build.from_names(names.limit(0), entities.limit(0), relations).nodes.count() == 0
    assert build.from_entities(entities.limit(0), relations).edges.count() == 0


NODE = "graph_id string, id string, ord int, name string, type string, base_description string, base_attributes map<string,string>, chunk_id array<long>"
EDGE = "graph_id string, id string, source string, target string, relation string, chunk_id long"


def _graph(spark, nodes, edges):
    rows = [("g", i, n, name, kind, f"about {i}", {i: "x"}, [n]) for n, (i, name, kind) in enumerate(nodes)]
    return Graph(spark.createDataFrame(rows, NODE), spark.createDataFrame([("g", i, a, b, "r", 1) for i, a, b in edges], EDGE))


def test_merges_of_graphs_are_one_sequential_pass(spark):
    """Random vectors in random batches: the leaders of a fold over all, whatever the batches."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors_of = spark.createDataFrame([(f"n{i}", v.tolist()) for i, v in enumerate(x)], "id string, embedding array<double>")
    leaders, want = [], {}
    for i in range(120):
        hit = next((j for j in leaders if i % 2 == j % 2 and x[i] @ x[j] >= 0.8), None)
        want[f"n{i}"] = f"n{i if hit is None else hit}"
        leaders += [i] if hit is None else []
    store = merge.GraphStore(spark, runtime.scratch(spark, "graph"), keep=2)
    similar = lambda n: resolution.similar_pairs(n.join(vectors_of, "id"), 0.8, only="fresh")
    for n, (a, b) in enumerate(((0, 50), (50, 51), (51, 120))):
        edges = [(f"e{i}", f"n{i - 1}", f"n{i}") for i in range(max(a, 1), b)] + [("lost", "n0", "nowhere")]
        assert store.merge(_graph(spark, [(f"n{i}", f"name {i}", f"t{i % 2}") for i in range(a, b)], edges), similar) == n + 1
    done = store.read()
    got = {r["id"]: len(r["base_attributes"]) for r in done.nodes.collect()}
    members = {k: [i for i, j in want.items() if j == k] for k in set(want.values())}
    assert got == {k: len(v) for k, v in members.items()}
    assert {r["id"]: (r["source"], r["target"]) for r in done.edges.collect()} == {f"e{i}": (want[f"n{i - 1}"], want[f"n{i}"]) for i in range(1, 120)}
    assert {r["id"]: r["leader"] for r in store.aliases().collect()} == want
    assert store.versions() == [2, 3] and store.read(2).nodes.count() > 0
    with pytest.raises(Exception, match="already exists|FileAlreadyExists"):
        runtime.write_once(spark, f"{store.path}/published/3")


def test_merges_by_id_and_name(spark):
    old = _graph(spark, [("inn", "The Inn", "place"), ("ann", "Ann", "person"), ("ann_1", "ann", "person")], [("e", "ann", "inn")])
    new = _graph(spark, [("inn_2", "the inn", "place"), ("ann", "Anna", "person"), ("bob", "Bob", "person"), ("bob_1", "BOB", "person"), ("inn", "Inn", "event")], [("e", "bob_1", "inn_2"), ("f", "ann", "bob"), ("h", "bob", None)])
    done, members = merge.merge(old, new)
    got = {r["id"]: (r["name"], r["type"], len(r["base_attributes"])) for r in done.nodes.collect()}
    assert got == {"inn": ("The Inn", "place", 2), "ann": ("Anna", "person", 1), "ann_1": ("ann", "person", 1), "bob": ("Bob", "person", 2)}
    assert {r["id"]: (r["source"], r["target"]) for r in done.edges.collect()} == {"e": ("bob", "inn"), "f": ("ann", "bob")}
    assert {r["id"]: r["leader"] for r in members.collect()} == {"inn": "inn", "ann": "ann", "ann_1": "ann_1", "inn_2": "inn", "bob": "bob", "bob_1": "bob"}
    none = _graph(spark, [], [])
    assert merge.merge(old, none)[0].nodes.count() == 3 and merge.merge(none, none)[0].nodes.count() == 0


def test_hybrid_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 3))
    names = [f"{'The ' * (i % 2)}Grey House {i % 7}" for i in range(90)]
    rows = [("g", f"t{i % 3}", i, i, names[i], x[i].tolist()) for i in range(90)] + [("g", "t0", 90, 90, names[0], [0.0] * 3), ("g", "t0", 91, 91, names[0], None)]
    nodes = spark.createDataFrame(rows, "graph_id string, type string, id int, ord int, name string, embedding array<double>")
    found = {(r["a"], r["b"]): r["similarity"] for r in resolution.hybrid_pairs(nodes, 0.82, pivots=8).collect()}

    def distance(p, q):
        row = list(range(len(q) + 1))
        for i, c in enumerate(p, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(q, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    want = {}
    for a in range(90):
        for b in range(a + 1, 90):
            if a % 3 == b % 3:
                p, q = names[a].lower(), names[b].lower()
                lexical = (1 - distance(p, q) / max(len(p), len(q)) + len(set(p.split()) & set(q.split())) / len(set(p.split()) | set(q.split()))) / 2
                cos = x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b])
                s = 0.6 * cos + 0.3 * lexical + 0.1 * (0.9 if p != q and (p in q or q in p) else 1.0)
                if s >= 0.82:
                    want[a, b] = s
    assert found.keys() == want.keys() and len(want) > 20 and all(abs(found[k] - want[k]) < 1e-9 for k in want)
    with pytest.raises(ValueError, match="no pair"):
        resolution.hybrid_pairs(nodes, 0.3)


def test_a_synced_index_follows_versions_in_any_batches(spark):
    rng, kept, feeds = random.Random(8), {}, []
    index = incremental.SyncedIndex(runtime.scratch(spark, "index"), lambda d: vectors.embed(d, lambda texts: [[float(len(t))] for t in texts]), buckets=4, compact_every=2)
    kind = "graph_id string, id string, document string, metadata map<string,string>"
    before = None
    for version in range(6):
        for i in range(30):
            if rng.random() < 0.5:
                kept[f"{i}"] = "d" * rng.randrange(1, 9)
            elif rng.random() < 0.3:
                kept.pop(f"{i}", None)
        now = spark.createDataFrame([("g", i, d, {"k": "v"}) for i, d in kept.items()], kind)
        feed = incremental.changes(before, now, version)
        feeds.append(feed.collect())
        index.put(feed, version)
        index.put(feed, version)  # a batch that is run again
        before = now
        got = {r["id"]: (r["document"], r["embedding"][0]) for r in index.read(spark, version).collect()}
        assert got == {i: (d, float(len(d))) for i, d in kept.items()}
    index.put(spark.createDataFrame(feeds[1], feed.schema), 6)  # changes that come late
    assert {r["id"]: r["document"] for r in index.read(spark, 6).collect()} == kept
    assert set(runtime.names_in(spark, index.table.path)) == {"columns", "delta=4", "delta=5", "delta=6", "snapshot=3", "snapshot=5"}


def test_searches_with_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [0.6, 0.8])]
    table = spark.createDataFrame(rows, "id int, embedding array<double>")
    got = vectors.top_k(table, table.withColumnRenamed("id", "query_id"), 5, skip_own=True).collect()
    assert {(r["query_id"], r["id"]): r["distance"] for r in got} == {(1, 2): 1.0, (1, 6): 0.4, (2, 1): 1.0, (2, 6): 1.0, (6, 1): 0.4, (6, 2): 1.0}


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_a_stored_index_finds_what_a_comparison_finds(spark, metric):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(25, 8))
    x = np.repeat(centers, 80, axis=0) + rng.normal(size=(2000, 8)) * 0.25
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, [0.0] * 8), (2001, None), (2002, [float("nan")] + [0.0] * 7), (2003, x[5].tolist()), (2004, x[5].tolist())]
    table = spark.createDataFrame(rows, "id int, embedding array<double>")
    asked = table.where("id % 20 = 0 or id > 1999").withColumnRenamed("id", "query_id")
    index = vectors.StoredIndex.build(table, runtime.scratch(spark, "index"), cells=32, metric=metric)
    assert index.rows().count() == 2003
    want = {(r["query_id"], r["rank"]): (r["id"], round(r["distance"], 7)) for r in vectors.top_k(table, asked, 7, metric).collect()}
    for probes in (1, 3):
        got = {(r["query_id"], r["rank"]): (r["id"], round(r["distance"], 7)) for r in index.search(asked, 7, probes, part_rows=40).collect()}
        assert got.keys() == want.keys() and all(abs(got[k][1] - want[k][1]) < 1e-6 for k in want)
        assert sum(got[k] == want[k] for k in want) >= 0.99 * len(want)  # but for ties within rounding
    near = index.search(asked, 7, 4, exact=False).collect()
    assert sum(want.get((r["query_id"], r["rank"]), (None,))[0] == r["id"] for r in near) >= 0.95 * len(want)
    # cells that cannot hold anything near are not read
    kept = []
    visit = vectors.StoredIndex._visit
    index._visit = lambda *a: kept.append(a[0].count()) or visit(index, *a)
    index.search(asked, 7, 2).collect()
    assert sum(kept) < 0.5 * 32 * asked.count()
    empty = vectors.StoredIndex.build(table.limit(0), runtime.scratch(spark, "index"))
    assert empty.search(asked, 3).collect() == [] and index.search(asked.limit(0), 3).collect() == []
