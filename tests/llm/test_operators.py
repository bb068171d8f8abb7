"""Every operator against a plain version on small tables, and its defined edge cases."""

import hashlib
import os
import re
import tracemalloc
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers as P
import pytest
import regex
import sentencepiece
from pyspark.sql import functions as F

from tessera.llm import ann, chat, common, graph, html_text, jaccard_join, langid, mixing, piece_codec, quality, queries, token_counts, topk_join
from tessera.llm.common import Scratch, materialize
from tests import compare

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, s string, score double"
ODD = [
    (1, None, None, None, None, "w", "x", 0.5),
    (2, "", "en", "a", 0, "w", "x", 0.5),
    (3, "  \n ", "en", "a", 4, "w", "x", 0.5),
    (4, "The the of and to in", "en", "b", 20, None, "x", None),
    (4, "The the of and to in", "en", "b", 20, None, "x", None),
    (5, "le la les et de un " * 9000, "fr", "b", 171000, "w", None, 0.1),
    (6, "▁ a  b\x00 é\r\n\U0001f600", "fr", None, 12, "w", "x", 0.5),
    (None, "der die das und", "de", "c", 15, "w", "x", 0.5),
    (7, "123 456 !!!", "de", "c", 11, "w", "x", 0.5),
]


def read(name, sf=SF):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# SQL -------------------------------------------------------------------------------------------
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.parametrize("sf", [SF, SF.replace("0.01", "0.001")])
def test_queries_equal_their_sql(spark, name, sf):
    assert compare.differ(spark, sf, queries.QUERIES[name], queries.ORACLE_SQL[name]) is None


# 1 ---------------------------------------------------------------------------------------------
def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_targets(sizes):
    """Sources by name, null last: raise a common level until the words are dealt (bisection)."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, low, high = 1.5 * sum(sizes.values()), 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(weight[s] * mid, 2 * sizes[s]) for s in order) < total else (low, mid)
    return {s: min(weight[s] * low, 2 * sizes[s]) for s in order}


def test_mix_targets_and_taken(spark):
    got = [r.asDict() for r in queries.op1_source_mix(spark, SF).collect()]
    again = {r["doc_id"]: r["taken"] for r in queries.op1_source_mix(spark, SF).collect()}
    assert {r["doc_id"]: r["taken"] for r in got} == again
    docs = read("documents")
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d["doc_id"], len(words(d["text"]))) for d in docs)
    size, taken, source = Counter(), Counter(), {d["doc_id"]: d["source"] for d in docs}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        size[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    want = plain_targets(size)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == size[s] and abs(r["target"] - want[s]) < 1e-3
    assert all(abs(taken[s] - want[s]) <= 64 for s in want)  # half a block


def test_mix_draws_are_disjoint_and_exact(spark):
    with Scratch(spark) as work:
        documents, draws, sources = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"), work, shard_blocks=256)
        size_of = {r["row_id"]: r["size"] for r in documents.collect()}
        rows = draws.collect()
    blocks = [(r["row_id"], r["number"], r["copy"], b) for r in rows for b in range(r["first"], r["first"] + r["blocks"])]
    assert len(set(blocks)) == len(blocks)
    per = Counter()
    for r in rows:
        per[r["shard"]] += r["blocks"]
        n = -(-size_of[r["row_id"]] // 128)
        assert r["words"] == min(size_of[r["row_id"]], 128 * (r["first"] + r["blocks"])) - 128 * r["first"] > 0
        assert r["first"] + r["blocks"] <= n and r["whole"] == (r["blocks"] == n)
    assert max(per.values()) - min(per.values()) <= len(per) and len(per) == -(-len(blocks) // 256)
    for shard in list(per)[:3]:
        assert sorted(r["place"] for r in rows if r["shard"] == shard) == list(range(1, sum(r["shard"] == shard for r in rows) + 1))
    # documents are cut only where a shard or a source's target ends
    assert sum(not r["whole"] for r in rows) <= 2 * (len(per) + 1) * len(sources)


def test_large_hypergeometric_draws_are_exact():
    from math import comb

    for good, bad, take in ((5, 7, 6), (40, 3, 20), (300, 500, 77), (2, 900, 3), (10, 10, 20), (9, 0, 4)):
        k, p = mixing.hypergeometric_weights(good, bad, take)
        exact = {i: comb(good, i) * comb(bad, take - i) / comb(good + bad, take) for i in range(max(0, take - bad), min(good, take) + 1)}
        assert dict(zip(k.tolist(), np.round(p, 12))) == {i: round(v, 12) for i, v in exact.items()}
    rng, n = np.random.default_rng(4), 3_000_000_000
    drawn = np.array([mixing.hypergeometric(rng, n, 2 * n, n) for _ in range(12)]) - n / 3
    spread = (n * (1 / 3) * (2 / 3) * (2 * n) / (3 * n)) ** 0.5
    assert 0.4 * spread < drawn.std() < 2 * spread and abs(drawn.mean()) < 2 * spread
    parts = list(mixing.shard_quotas(np.array([2_500_000_000, 7, 0, 900_000_000]), 5, 7, 1 << 16, 3))
    assert [p[0] for p in parts] == [5, 6] and all(abs(int(p[2].sum()) - 3_400_000_007 / 65536) < 20 for p in parts)


def test_splitting_tree_keeps_quotas():
    quota = np.array([1000, 3, 0, 517])
    parts = list(mixing.shard_quotas(quota, 0, 13, 13, 5))
    assert (sum(own for _, _, own in parts) == quota).all()
    sizes = [int(own.sum()) for _, _, own in parts]
    assert max(sizes) - min(sizes) <= 2
    for k in (0, 4, 9):  # a task that descends to a part of the shards finds the same
        assert all((a[2] == b[2]).all() and (a[1] == b[1]).all() for a, b in zip(mixing.shard_quotas(quota, k, k + 3, 13, 5), parts[k : k + 3]))


def test_mix_odd_rows(spark, odd, none):
    with Scratch(spark) as work:
        documents, draws, sources = mixing.mix(odd, work)
        got = mixing.taken_by_document(documents, draws, sources).collect()
        assert len(got) == len(ODD) and all(r["taken"] <= 2 * r["size"] and (r["taken"] > 0) == (r["place"] is not None) for r in got)
        text = mixing.mixed_texts(odd, draws).collect()
        assert sum(len(words(r["text"])) for r in text) == sum(r["taken"] for r in got)
        assert {len(r) for r in text} == {len(odd.columns) + 2}
        assert mixing.taken_by_document(*mixing.mix(none, work)).count() == 0
        assert mixing.mixed_texts(none, mixing.mix(none, work)[1]).count() == 0


def test_mixed_texts_are_cut_from_their_own_rows(spark):
    said = lambda row: "  " + "\n\n".join("\t".join(f"r{row}w{i}" for i in range(k, k + 20)) for k in range(0, 300, 20)) + " \n"
    rows = [(None, "a", said(r), str(r)) for r in (0, 1, 2, 2)] + [(5, "a", said(3), "3"), (5, "a", said(4), "4")]
    rows += [(None, "a", "alpha beta gamma", "5"), (None, "a", "delta epsilon zeta", "6"), (7, "a", "one two three", "7"), (7, "a", "four five six", "8")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, mark string")
    with Scratch(spark) as work:
        _, draws, _ = mixing.mix(docs, work, shard_blocks=4)
        mixed = mixing.mixed_texts(docs, draws).withColumn("part", F.spark_partition_id()).collect()
        total = draws.agg({"words": "sum"}).first()[0]
    taken, text_of = Counter(), {m: t for _, _, t, m in rows}
    for r in mixed:
        assert r["text"] in text_of[r["mark"]]  # white space and all
        taken[int(r["mark"])] += len(words(r["text"]))
    assert all(taken[r] >= 300 for r in (0, 1, 3, 4)) and taken[2] >= 600 and all(taken[r] >= 3 for r in (5, 6, 7, 8))
    assert sum(taken.values()) == total
    # shards lie whole in a partition, in the order of their places
    assert all(len({r["part"] for r in mixed if r["shard"] == s}) == 1 for s in {r["shard"] for r in mixed})
    order = [(r["part"], r["shard"], r["place"]) for r in mixed]
    assert order == sorted(order) and len(set(order)) == len(order)


# 2 ---------------------------------------------------------------------------------------------
def test_language_held_out(spark):
    got = {r["doc_id"]: r for r in queries.op2_language(spark, SF).collect()}
    docs = read("documents")
    assert len(got) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0]
    assert all(got[d["doc_id"]]["held_out"] for d in held)
    assert sum(got[d["doc_id"]]["lang_pred"] == d["lang"] for d in held) / len(held) > 0.97
    assert sum(r["rejected"] for r in got.values()) <= 0.02 * len(docs)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_odd_rows(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs, queries.fold(5) != 0, sample_docs=300)
    got = langid.predict(odd, model).collect()
    by = {(r["doc_id"], r["text"]): r["lang_pred"] for r in got}
    assert len(got) == len(ODD) and got[0].asDict().keys() >= {"words", "s", "rejected"}
    assert len(got[0]) == len(set(got[0].asDict())) == 10  # its score is the prediction's
    assert by[1, None] == by[2, ""] == by[3, "  \n "] == by[7, "123 456 !!!"] == "und"
    assert by[5, "le la les et de un " * 9000] == "fr"
    assert langid.predict(none, model).count() == 0
    assert langid.fit(none, queries.fold(5) != 0) is None
    assert {r["lang_pred"] for r in langid.predict(odd, None).collect()} == {"und"}


def plain_language(model, text):
    """(language, score) of one text, n-gram by n-gram."""
    if not any(unicodedata.category(c).startswith("L") for c in text or ""):
        return "und", 0.0
    b = re.sub(r"[\W\d_]+", " ", f" {text.lower()} ").encode()
    rows = []
    for n in (2, 3, 4):
        for i in range(len(b) - n + 1):  # the whole text
            gram = b[i : i + n]
            if b" " in gram[1:-1] or gram == b"  ":
                continue
            h = n * 0x9E3779B1 & 0xFFFFFFFF
            for c in gram:
                h = (h ^ c) * 16777619 & 0xFFFFFFFF
            rows.append((h ^ h >> 15) & (len(model.embedding) - 1))
    z = model.embedding[rows].mean(0) @ model.softmax / model.temperature
    p = np.exp(z - z.max())
    return model.langs[int(p.argmax())], float(p.max() / p.sum())


def test_language_equals_a_plain_predictor(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs, queries.fold(5) != 0, sample_docs=400)
    texts = [d["text"] for d in read("documents")[:40]] + [max((d["text"] for d in read("documents")), key=len)] + ["½", "² ³", "Ⅷ ½ x", "123", "\u0301", "__", "ж", "漢", None, ""]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in langid.predict(table, model).collect():
        lang, score = plain_language(model, r["text"])
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-4, r


def test_samples_are_bounded_under_repeated_ids(spark):
    from tessera.llm.common import sample_share

    rows = spark.range(60_000).selectExpr("if(id < 50000, 7, id) as doc_id", "concat('t', id) as text")
    for want in (100, 100_000):
        got = sample_share(rows, want, "doc_id").collect()
        assert len({r["doc_id"] for r in got}) == len(got) <= max(1.5 * want, 10_001)
        assert len(got) >= min(0.5 * want, 10_001)
    assert {r["text"] for r in sample_share(rows, 100_000, "doc_id").collect() if r["doc_id"] == 7} == {"t0"}


def test_language_learns_in_little_of_the_driver():
    rng = np.random.default_rng(5)
    idx = [np.unique(rng.integers(0, 1 << 15, 3000)) for _ in range(1000)]
    count = [rng.integers(1, 4, len(i)) for i in idx]
    # what a task sends of a text is smaller than its plain numbers, and says the same
    assert sum(len(langid.packed(i, n)) for i, n in zip(idx, count)) < 0.6 * sum(8 * len(i) for i in idx)
    rows = [(f"l{k % 3}", *langid.unpacked(langid.packed(i, n))) for k, (i, n) in enumerate(zip(idx, count))]
    assert all((r[1] == i).all() and (r[2] == (n / n.sum()).astype(np.float32)).all() for r, i, n in zip(rows, idx, count))
    assert [len(x) for x in langid.unpacked(langid.packed(idx[0][:0], count[0][:0]))] == [0, 0]
    tracemalloc.start()
    langid.train(rows, 1 << 15, 16, 1, 2.0, 0.001)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the 200 held-back texts take over 70 MB at once, twice
    assert peak < 60e6


def test_subwords_do_not_cross_texts():
    texts = [langid.letters(t) for t in ("abc def", "x", "", "éa")]
    together = langid.subwords(texts, 1 << 15)
    for i, t in enumerate(texts):
        for n, alone in enumerate(langid.subwords([t], 1 << 15)[0]):
            ids, bound = together[0][n], together[1][n]
            assert ids[bound[i] : bound[i + 1]].tolist() == alone.tolist()


# 3, 8 ------------------------------------------------------------------------------------------
def vectors(sf=SF):
    rows = read("embeddings", sf)
    return np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)


def plain_top(ids, score, every, k, sign):
    out = {}
    for q in ids[ids % every == 0].tolist():
        s = score(q)
        rank = sorted((sign * v, i) for i, v in zip(ids.tolist(), s.tolist()) if i != q)[:k]
        out[q] = [(i, sign * v) for v, i in rank]
    return out


def grouped(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return dict(out)


@pytest.mark.parametrize("group_queries", [4096, 7])
def test_topk_is_exact(spark, group_queries):
    ids, x = vectors()
    f = np.floor(256 * x)
    at = {i: n for n, i in enumerate(ids.tolist())}
    want = plain_top(ids, lambda q: f @ f[at[q]], 50, 5, -1)
    got = grouped(topk_join.topk_join(spark.read.parquet(f"{SF}/embeddings.parquet"), group_queries=group_queries, pivots=16).collect())
    assert got == {q: [(i, int(v)) for i, v in r] for q, r in want.items()}


def clustered(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(12, 16))[rng.integers(0, 12, n)] + 0.03 * rng.normal(size=(n, 16))
    x[5:40] = x[5]  # ties
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def test_topk_prunes_and_stays_exact_on_clusters_and_ties(spark):
    x, table = clustered(spark)
    f = np.floor(256 * x)
    want = plain_top(np.arange(len(x)), lambda q: f @ f[q], 50, 5, -1)
    want = {q: [(i, int(v)) for i, v in r] for q, r in want.items()}
    report = {}
    assert grouped(topk_join.topk_join(table, report=report).collect()) == want
    assert report["groups"] >= 4 and report["sent"] / (report["rows"] * report["groups"]) < 0.5
    assert grouped(topk_join.topk_join(table, group_queries=3, slice_rows=300).collect()) == want


def test_topk_counts_a_repeated_id_once(spark):
    kind = "vec_id long, embedding array<float>"
    far = [(i, [-1.0, i / 64]) for i in range(2, 9)]
    rows = [(0, [1.0, 0.0]), *[(1, [1.0, 0.0])] * 10, *far]
    got = grouped(topk_join.topk_join(spark.createDataFrame(rows, kind)).collect())
    assert got == {0: [(1, 65536), *[(i, -65536) for i in range(2, 6)]]}
    for repeated in ([(1, [1.0, 0.0])] * 30, [(50, [1.0, 0.0])] * 10, [(1, [1.0, 0.0]), (1, [-1.0, 0.0])]):
        rows = [(i, [-1.0, i / 640]) for i in range(2, 49)] + [(50, [1.0, 0.0])] + repeated
        least = {}
        for i, v in rows:
            f = [float(np.floor(256 * c)) for c in v]
            least[i] = min(least.get(i, f), f, key=lambda v: np.array(v).tobytes())
        ids, x = np.array(sorted(least)), np.array([least[i] for i in sorted(least)])
        want = plain_top(ids, lambda q: x @ np.array(least[q]), 50, 5, -1)
        got = grouped(topk_join.topk_join(spark.createDataFrame(rows, kind)).collect())
        assert got == {q: [(i, int(v)) for i, v in r] for q, r in want.items()}


def test_topk_of_equal_and_zero_vectors(spark):
    rng = np.random.default_rng(3)
    x = np.where(np.arange(900)[:, None] % 3 == 0, 0.5, rng.normal(size=(900, 8)))
    x[100:130] = 0
    f = np.floor(256 * x)
    want = plain_top(np.arange(900), lambda q: f @ f[q], 50, 5, -1)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert grouped(topk_join.topk_join(table).collect()) == {q: [(i, int(v)) for i, v in r] for q, r in want.items()}


def test_ann_recall_and_scores(spark):
    for x, table in (clustered(spark), (vectors("/root/testdata/sf0.1")[1], spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))):
        ids = np.arange(len(x))
        want = plain_top(ids, lambda q: np.sqrt(((x - x[q]) ** 2).sum(1)), 100, 10, 1)
        got = grouped(ann.search(table).collect())
        assert got.keys() == want.keys()
        for q, r in got.items():
            assert all(abs(v - np.sqrt(((x[i] - x[q]) ** 2).sum())) < 1e-12 for i, v in r)
        assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.95


@pytest.mark.parametrize("seed", [1, 2, 3, 4, 5])
def test_ann_gives_k_rows_on_tight_clusters(spark, seed):
    """Clusters of 11 rows far from each other: k true neighbours and no spare one."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(400, 64))
    x = np.repeat(centers, 11, axis=0) + rng.normal(size=(4400, 64)) * 0.02
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = ann.search(table, every=11).collect()
    assert Counter(Counter(r["query_id"] for r in rows).values()) == {10: 400}
    right = sum(r["query_id"] // 11 == r["vec_id"] // 11 for r in rows)
    assert right >= 0.95 * len(rows)


@pytest.mark.parametrize("search, every", [(topk_join.topk_join, 50), (ann.search, 100)])
def test_vector_odd_rows(spark, search, every):
    kind = "vec_id long, embedding array<float>, label int, score double"
    rows = [(0, [1.0, 0.0], 1, 0.0), (100, [0.0, 1.0], 1, 0.0), (1, [1.0, 1.0], 1, 0.0), (1, [1.0, 1.0], 1, 0.0), (2, None, 1, 0.0), (3, [None, 1.0], 1, 0.0), (4, [float("nan"), 1.0], 1, 0.0), (200, [float("inf"), 1.0], 1, 0.0), (5, [1.0], 1, 0.0), (None, [1.0, 1.0], 1, 0.0)]
    got = grouped(search(spark.createDataFrame(rows, kind)).collect())
    assert {q: {i for i, _ in r} for q, r in got.items()} == {0: {1, 100}, 100: {0, 1}}
    assert search(spark.createDataFrame([], kind)).count() == 0
    assert search(spark.createDataFrame([(0, None, 1, 0.0)], kind)).count() == 0


# 4 ---------------------------------------------------------------------------------------------
def test_pieces_equal_the_library(spark, odd, none):
    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r["doc_id"]: r for r in queries.op4_pieces(spark, SF).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for d in read("documents"):
        ids = sp.encode(d["text"] or "", add_eos=True)
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))
    for r in piece_codec.encode_decode(odd, path, keep=["doc_id", "text"]).collect():
        assert r["ids"] == sp.encode(r["text"] or "", add_eos=True) and r["decoded"] == sp.decode(r["ids"])
    assert piece_codec.encode_decode(none, path).count() == 0
    clash = odd.withColumnRenamed("words", "ids").withColumnRenamed("s", "decoded")
    assert {str(r["ids"]) for r in piece_codec.encode_decode(clash, path, keep=["doc_id", "ids", "decoded"]).collect()} == {str(r["ids"]) for r in piece_codec.encode_decode(odd, path).collect()}


def test_round_trips_are_told_without_handing_texts_back(spark, odd, none):
    import corpus_pipeline

    path, more = P.path("piece_bpe_32k.model"), [(90, "a▁b ▁"), (91, "<s> \U0001f600\x00 </s>"), (92, " "), (93, "")]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    told = piece_codec.encode_decode(docs, path, keep=["doc_id", "text"], round_trip=True, batch_chars=3, table_limit=2)
    plain = piece_codec.encode_decode(docs, path, keep=["doc_id", "text"])
    rows = lambda df: Counter((r["doc_id"], r["text"], tuple(r["ids"]), r["round_trip"]) for r in df.collect())
    assert told.columns == ["doc_id", "text", "ids", "round_trip"] and piece_codec.encode_decode(none, path, round_trip=True).count() == 0
    assert rows(told) == rows(plain.withColumn("round_trip", F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), "▁", " ")))
    # of the pipeline's stage, texts go to Python once and do not come back
    given = docs.selectExpr("doc_id", "text", "'en' lang", "'a' source", "length(text) n_chars")
    plan = corpus_pipeline.pieces(spark, given, SF)._jdf.queryExecution().optimizedPlan().toString()
    (arrow,) = [x for x in plan.splitlines() if "MapInArrow" in x]
    assert "round_trip" in arrow and "decoded" not in arrow and "text" not in arrow.split("[", 1)[1], arrow


def test_models_that_change_texts_are_not_cut(spark, tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    given = pb.ModelProto.FromString(open(P.path("piece_bpe_32k.model"), "rb").read())
    texts = ["  two  spaces ", "the user's own word", "a b", " ", None]
    for change in ("none", "spaces", "symbol", "prefix"):
        model = pb.ModelProto()
        model.CopyFrom(given)
        if change == "spaces":
            model.normalizer_spec.remove_extra_whitespaces = True
        elif change == "prefix":
            model.normalizer_spec.add_dummy_prefix = False
        elif change == "symbol":
            model.pieces.add(piece="user's own", score=0, type=pb.ModelProto.SentencePiece.USER_DEFINED)
        path = str(tmp_path / f"{change}.model")
        with open(path, "wb") as f:
            f.write(model.SerializeToString())
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        assert piece_codec.pieces_stay_in_chunks(sp) == (change == "none")
        rows = piece_codec.encode_decode(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), path).collect()
        for r in rows:
            ids = sp.encode(texts[r["k"]] or "")
            assert r["ids"] == [*ids, sp.eos_id()] and r["decoded"] == sp.decode(ids), (change, r)


def test_chunk_table_on_random_texts():
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(3)
    alphabet = list("ab the▁  \n\té日\U0001f600<s>")
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(500)]
    flat, sizes, decoded = piece_codec.ChunkTable(sp, table_limit=20).encode(texts)
    at = np.cumsum(sizes) - sizes
    assert [flat[a : a + n].tolist() for a, n in zip(at, sizes)] == sp.encode(texts)
    assert decoded == [sp.decode(x) for x in sp.encode(texts)]


# 5 ---------------------------------------------------------------------------------------------
def test_quality_held_out(spark):
    got = {r["doc_id"]: r for r in queries.op5_quality(spark, "/root/testdata/sf0.1").collect()}
    labels = [r for r in read("labels", "/root/testdata/sf0.1") if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert all(got[r["doc_id"]]["held_out"] for r in labels)
    assert np.mean([got[r["doc_id"]]["predicted"] == r["quality"] for r in labels]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def plain_trees(x, y, trees, depth, bins, rate, l2, least=8):
    """Split by split: every edge of every feature is tried on the rows of its node."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    raw = np.full(n, np.log(mean / (1 - mean)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h, nodes = p - y, np.maximum(p * (1 - p), 1e-6), [np.arange(n)]
        for _ in range(depth):
            below = []
            for rows in nodes:
                best, cut = 1e-9, None
                for f in range(width):
                    for e in edges[f]:
                        left = rows[x[rows, f] <= e]
                        if least <= len(left) <= len(rows) - least:
                            right = np.setdiff1d(rows, left)
                            gain = sum(g[r].sum() ** 2 / (h[r].sum() + l2) * s for r, s in ((left, 1), (right, 1), (rows, -1)))
                            if gain > best + 1e-12:
                                best, cut = gain, (f, e)
                left = rows[x[rows, cut[0]] <= cut[1]] if cut else rows
                below += [left, np.setdiff1d(rows, left)]
            nodes = below
        for rows in nodes:
            raw[rows] -= rate * g[rows].sum() / (h[rows].sum() + l2)
    return 1 / (1 + np.exp(-raw))


def test_quality_training_equals_a_plain_one():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(160, 4)), 2)
    y = ((x[:, 0] * x[:, 1] > 0) | (x[:, 2] > 1)).astype(float)
    for bins, depth in ((6, 2), (12, 3)):
        model = quality.train(x, y, trees=6, depth=depth, bins=bins, rate=0.3, l2=1.0)
        assert np.allclose(quality.score(model, x), plain_trees(x, y, 6, depth, bins, 0.3, 1.0), atol=1e-9)


def test_quality_odd_rows_and_trees(spark, odd, none):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.train(x, y, trees=30, depth=3, bins=32, rate=0.3, l2=1.0)
    s = quality.score(model, x)
    assert ((s >= 0.5) == y).mean() > 0.97
    one = [model.base] * 5
    for t in range(30):  # walked one by one
        for r in range(5):
            node = 0
            for _ in range(3):
                node = 2 * node + 1 + int(x[r, model.feature[t, node]] > model.threshold[t, node])
            one[r] += model.leaf[t, node - 7]
    assert np.allclose(1 / (1 + np.exp(-np.array(one))), s[:5])
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, None), (5, 1), (None, 1), (2, 0)], "doc_id long, quality int")
    fitted = quality.fit(odd, labels, queries.fold(3) >= 0)
    got = quality.predict(odd, fitted).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got) and len(got[0]) == len(set(got[0].asDict())) == 8
    assert quality.fit(none, labels, queries.fold(3) >= 0) is None
    assert quality.predict(none, fitted).count() == 0


# 6 ---------------------------------------------------------------------------------------------
def test_main_text_of_all_pages(spark):
    import html as h

    got = {r["page_id"]: r for r in queries.op6_main_text(spark, SF).collect()}
    for p in read("pages"):
        article = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        plain = h.unescape(re.sub(r"<[^>]*>", " ", article)).split()
        r = got[p["page_id"]]
        assert r["text"].split() == plain and r["n_chars"] == len(r["text"])


def test_main_text_cases(spark):
    page = """<body><header>Site</header><nav><a href=/>Home</a></nav><div class="side-bar sidebar">Side</div>
    <main><h1>Title &amp; more</h1><p>First  long\n paragraph with text. <a href=x>link</a> goes on.<p>Second<br>one<ul><li>a<li>b</ul>
    <form>Name <input></form><script>var x = "</p>";</script><div class="cookie-notice">We use</div></main>
    <section id="comments"><p>I disagree with all of it and say so at length, again and again.</p></section><footer>(c)</footer>"""
    assert html_text.main_text(page) == "Title & more\n\nFirst long paragraph with text. link goes on.\n\nSecond one\n\na\n\nb"
    for empty in (None, "", "   ", "<html></html>", "<nav>x</nav>", "<script>"):
        assert html_text.main_text(empty) == ""
    assert html_text.main_text("just text") == "just text"
    assert html_text.main_text("<p>a</p>" * 20000).count("a") == 20000
    assert html_text.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    table = spark.createDataFrame([(1, None, None, "t"), (2, "u", "<p>x", "t")], "page_id long, url string, html string, text string")
    assert sorted((r["page_id"], r["text"]) for r in html_text.extract(table).collect()) == [(1, ""), (2, "x")]
    assert html_text.extract(table.limit(0)).count() == 0


def test_main_text_in_marked_wrappers():
    said = "<p>" + "Some words of the article itself. " * 9 + "</p>"
    ad, said_text = "<div class='ad'><p>Buy now, it is cheap.</p></div>", ("Some words of the article itself. " * 9).strip()
    for open_, close in (
        ("<div class='has-sidebar'>", "</div>"), ("<div class='no-sidebar page'>", "</div>"), ("<div class='with-comments'>", "</div>"), ("<div class='sidebar-layout'>", "</div>"),
        ("<form id='page' role='form'>", "</form>"), ("<div class='sidebar'><main>", "</main></div>"), ("<form><div class='widget'><article>", "</article></div></form>"),
    ):
        assert html_text.main_text(f"<body>{open_}{said}{ad}{said}{close}</body>") == said_text + "\n\n" + said_text
    # marked parts beside it still go, whatever they hold
    for part in ("<div class='comments'><article><p>I like it.</p></article></div>", "<form><p>Your name</p></form>", "<p class='share'>Tell others</p>"):
        assert html_text.main_text(f"<body><div class='no-sidebar'><article>{said}</article>{part}</div></body>") == said_text
    assert html_text.main_text(f"<article><p>One <span class='ad'>buy</span> two.</p>{said}</article>") == "One two.\n\n" + said_text


def test_main_text_keeps_what_a_word_alone_does_not_mark():
    said = "<p>" + "Some words of the article itself. " * 9 + "</p>"
    text = ("Some words of the article itself. " * 9).strip()
    page = f"""<body><article><h1 id=ad>Title</h1>{said}<h2 id="notice-of-appeal">Appeal</h2>{said}<section class="social-history"><h3>Then</h3>{said}</section>
    <p id="comments">Last, <a href=x>linked</a>.</p><div class="related-work"><a href=1>One</a> <a href=2>Two</a></div><div class="cookie-notice">We use them.</div></article></body>"""
    assert html_text.main_text(page).split("\n\n") == ["Title", text, "Appeal", text, "Then", text, "Last, linked."]


PARAS = [f"Paragraph {i} of the article says this and that about its matter, " + "word by word, " * 12 + "to its end." for i in range(4)]
REMARKS = "".join(f"<div><b>Reader {i}</b><p>I read it and have much to say about it, remark {i}, " + "again and again, " * 14 + "so there.</p></div>" for i in range(12))


@pytest.mark.parametrize(
    "page",
    [
        "<article>{a}</article><section id='comments'>{r}</section>",
        "<main>{a}</main><section id='comments'>{r}</section>",
        "<main>{a}<section id='comments'>{r}</section></main>",
        "<div>{a}</div><section id='comments'>{r}</section>",
        "<article>{a}<section class='post-comments'>{r}</section></article>",
        "<div id='content'>{a}</div><div id='comments'><article>{r}</article></div>",
        "<article>{a}</article><div class='cookie-notice'>{r}</div>",
        "<div class='cookie-notice'><p>" + "We use cookies and say so in one more sentence. " * 30 + "</p></div><div id='content'>{a}</div>",
        "<div id='content'>{a}</div><div class='sidebar'><article><p>One short teaser of another text.</p></article></div>",
        "<div class='comments'><main>{r}</main></div><div>{a}</div>",
        "<div class='widget'><article>{a}</article></div><div id='comments'>{r}</div><p>Left over.</p>",
        "<div class='widget'><div>{a}</div></div><div id='comments'>{r}</div>",
        "<form id='page'>{a}<div class='comment-list'>{r}</div></form>",
    ],
)
def test_main_text_without_large_marked_parts(page):
    said = "".join(f"<p>{p}</p>" for p in PARAS)
    assert html_text.main_text("<body><nav><a href=/>Home</a></nav>" + page.format(a=said, r=REMARKS) + "<footer>(c)</footer></body>").split("\n\n") == PARAS


def test_main_text_by_density_alone():
    said = [" ".join(f"word{i}{k}" for k in range(60)) + "." for i in range(5)]
    para = "".join(f"<p>{t}</p>" for t in said)
    links = "".join(f"<li><a href='/{i}'>Entry number {i}</a></li>" for i in range(12))
    pages = {
        "a container": (f"<body><div id=top>Site</div><ul>{links}</ul><div class=x>{para}</div><div><ul>{links}</ul></div></body>", said),
        "a heading in the wrapper": (f"<body><div><ul>{links}</ul></div><div class='navigation-systems'><h1>Head</h1><div>{para}</div><p>Short end.</p></div></body>", ["Head", *said, "Short end."]),
        "a heading in body": (f"<body><h1>Head</h1><ul>{links}</ul><div>{para}</div></body>", ["Head", *said]),
        "two parts": (f"<body><table><tr><td><ul>{links}</ul></td><td><div>{para}</div><div>{para}</div></td></tr></table></body>", said + said),
        "comments": (f"<body><div>{para}</div><div class='post-comments'>{para}</div><div id='disqus_thread'>{para}</div></body>", said),
        "misleading names": (f"<body><div class='sidebar-layout with-ads'><div class='menu-planning'>{para}</div><div class='sidebar'><p>Beside it</p></div></div></body>", said),
    }
    for name, (page, want) in pages.items():
        assert html_text.main_text(page).split("\n\n") == want, name


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "deep" + "</div>" * 100_000, "<a b" * 100_000, "<li><div>x" * 20_000, "<a '>' " * 50_000 + "'", "<b>" * 20_000 + "<hr>x" * 20_000, "<script>" + "</script" * 50_000])
def test_main_text_takes_linear_time(page):
    import time

    html_text.main_text("<p>warm")
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 4


# 7 ---------------------------------------------------------------------------------------------
def test_chat_reads_back(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    talks = defaultdict(list)
    for r in read("conversations"):
        talks[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    said = r"\### Assistant: </turn> ok"
    talks[-7] = [(0, "user", said), (1, "assistant", said)]
    got = {r["conv_id"]: r for r in queries.op7_chat(spark, SF).collect()}
    assert got.keys() == talks.keys()
    for k, turns in talks.items():
        turns.sort()
        under = "".join(t for _, r, t in turns if r == "assistant")
        r = got[k]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for _, a, b in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(under), sha(under))


def test_chat_templates(spark):
    turns = [("system", "s"), ("user", "</turn>\n### Assistant: no"), ("assistant", "a\\"), ("x:<#", ""), ("assistant", "")]
    text, found, masked, rewrites = chat.spans(turns, chat.marked_turns)
    assert not rewrites and chat.read_back(text) == turns and [chat.unescape(text[a:b]) for a, b in masked] == ["a\\", ""]
    assert "".join(text[a:b] for a, b in found) == text
    last_only = lambda t, opened: f"{len(t)} turns|" + "".join(x for _, x in t)
    assert chat.spans(turns, last_only)[3]
    no_opening = lambda t, opened: "".join(f"[{r}]{x}[/]" for r, x in t)
    text, _, masked, rewrites = chat.spans([("user", "q"), ("assistant", "[x")], no_opening)
    assert not rewrites and [text[a:b] for a, b in masked] == ["[x"]
    rows = spark.createDataFrame([(1, 0, None, None, 1), (1, 0, "user", "b", 1), (None, None, "user", "x", 1)], "conv_id long, turn long, role string, text string, turns int")
    got = {r["conv_id"]: r for r in chat.format_conversations(rows).collect()}
    assert got[1]["n_turns"] == 2 and chat.read_back(got[None]["formatted"]) == [("user", "x")]
    assert chat.format_conversations(rows.limit(0)).count() == 0


def test_chat_of_many_turns():
    rng = np.random.default_rng(5)
    turns = [(("user", "assistant", "judge")[i % 3], "".join(rng.choice(list("ab <#\\:"), 60))) for i in range(1500)]
    template = chat.TurnTemplate(chat.marked_turn, limit=30_000)
    text, found, masked, rewrites = chat.spans(turns, template)
    assert not rewrites and chat.read_back(text) == turns and text == "".join(chat.marked_turn(*t) for t in turns)
    assert [chat.unescape(text[a:b]) for a, b in masked] == [t for r, t in turns if r == "assistant"]
    assert [text[a:b] for a, b in found] == [chat.marked_turn(*t) for t in turns]


# 9 ---------------------------------------------------------------------------------------------
def plain_components(rows):
    sets = defaultdict(list)
    count = {}
    for i, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])
        sets[i].append(s)
        count[i, t] = len(s)
    flat = [(i, s) for i, own in sets.items() for s in own if s]
    root = {i: i for i in sets}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    where = defaultdict(set)
    for n, (_, s) in enumerate(flat):
        for x in s:
            where[x].add(n)
    for n, (i, s) in enumerate(flat):
        hits = Counter(m for x in s for m in where[x] if m < n)
        for m, both in hits.items():
            if 100 * both >= 90 * (len(s) + len(flat[m][1]) - both):
                a, b = find(i), find(flat[m][0])
                root[max(a, b)] = min(a, b)
    return count, {i: find(i) for i in sets}


def test_components_ask_no_round_of_what_is_stars(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name, keep=Scratch.keep: kept.append(name) or keep(self, df, name))

    def found(edges):
        kept.clear()
        return {r["v"]: r["c"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}

    assert found([(1, 5), (6, 1), (1, 5), (3, 9), (4, 4)]) == {1: 1, 5: 1, 6: 1, 3: 3, 9: 3} and kept == ["edges", "result"]
    # a chain of three is a star after one round, and no further round confirms it
    assert found([(1, 2), (2, 3)]) == {1: 1, 2: 1, 3: 1} and kept.count("edges") == 2
    assert found([]) == {}
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 150, (110, 2))] + [(i, i + 1) for i in range(200, 240)] + [(300, i) for i in range(301, 330)]
    want = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in want:
        for x, y in edges:
            if x != y:
                want[x] = want[y] = min(want[x], want[y])
    assert found(edges) == want


def test_jaccard_components(spark):
    rows = [(d["doc_id"], d["text"]) for d in read("documents")]
    count, comp = plain_components(rows)
    got = queries.op9_jaccard(spark, SF).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (count[i, t], comp[i]) for i, t in rows}


@pytest.mark.parametrize("block, most", [(512, 6), (16, 1), (16, 4)])
def test_jaccard_on_chains_and_hot_groups(spark, block, most):
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(140)]
    common = [f"c{k}" for k in range(60)]
    rows = []
    for n in range(160):  # near copies of one text at many distances
        w = list(base)
        for k in rng.choice(len(w), rng.integers(0, 9), replace=False):
            w[k] = f"x{rng.integers(0, 50)}"
        rows.append((n * 3, " ".join(w)))
    for n in range(120):  # a passage shared by different texts
        rows.append((1000 + n, " ".join([f"u{n}a{k}" for k in range(rng.integers(3, 80))] + common)))
    rows += [(2000 + n, t) for n, t in enumerate(["A b", "a B", "a", "a b c", "a b c d", "", None, "  ", "A B C", "a b c d e f g h i j k l", "a b c d e f g h i j k"])]
    rows += [(3000 + n, " ".join(f"s{k}" for k in range(n, n + 200))) for n in range(0, 60, 4)]  # a chain
    rows += rows[:5] + [(6, "q r s"), (None, "q r s t")]
    rows = [(int(i) if i is not None else None, t) for i, t in rows]
    count, comp = plain_components([(i, t) for i, t in rows if i is not None])
    table = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, n string, v int")
    got = jaccard_join.jaccard_components(table, block=block, most_matches=most).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == comp[r["doc_id"]], r
    assert Counter(r["n_shingles"] for r in got if r["doc_id"] is not None) == Counter(count[i, t] for i, t in rows if i is not None)


def test_jaccard_empty(spark, none):
    assert jaccard_join.jaccard_components(none).count() == 0


def test_jaccard_of_repeated_ids(spark):
    rows = [(1, "a b c"), (5, "a b c"), (5, "x y z"), (9, "x y z"), (5, ""), (2, "A  b\tc"), (3, None), (3, None), (4, "\x00 b c"), (None, "a b c"), (None, "")]
    rows += [(7, "l m n"), (8, "l m n"), (7, "o p q"), (6, "o p q"), (11, "lone words here"), (11, " ")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    _, comp = plain_components([r for r in rows if r[0] is not None])
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == comp
    # an id's rows agree, words or not
    assert len({(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None}) == len(comp)
    assert comp[9] == 1 and comp[7] == comp[8] == 6


def test_shingles_of_thue_morse_words_differ():
    word = "a"
    for _ in range(11):  # equal to its complement under every polynomial hash modulo 2 ** 64
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    a, b = jaccard_join.shingle_sets([word, other], 3)
    assert a.tolist() != b.tolist()
    a, b = jaccard_join.exact_sets([word, other], 3)
    assert a.tolist() != b.tolist()


def test_shingle_sets_agree_with_plain_ones():
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["a", "B", "b", "É", "é", "\u00a0x", "c\td"], n)) for n in rng.integers(0, 9, 60)] + [None, "", " \n"]
    for width in (1, 3, 5):
        plain = []
        for t in texts:
            w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            plain.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
        for found in (jaccard_join.shingle_sets(texts, width), jaccard_join.exact_sets([t or "" for t in texts], width)):
            for i in range(len(texts)):
                assert len(found[i]) == len(plain[i])
                for j in range(i):
                    assert len(np.intersect1d(found[i], found[j])) == len(plain[i] & plain[j])
    many = [" ".join(f"w{i}" for i in range(a, a + 300)) for a in range(0, 30_000, 150)]
    for x, y in zip(jaccard_join.exact_sets(many, 5), jaccard_join.exact_sets(many, 5)[1:]):
        assert len(x) == 296 and len(np.intersect1d(x, y)) == 146


# 10 --------------------------------------------------------------------------------------------
def test_edit_aware_counts_equal_fresh_counts(spark, odd, none):
    enc = token_counts.load_encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = {r["doc_id"]: r for r in queries.op10_token_counts(spark, SF).collect()}
    for d in read("documents"):
        t, r = d["text"], got[d["doc_id"]]
        assert r["n_tokens"] == len(enc.encode_ordinary(t)) and r["n_pre_tokens"] == len(regex.findall(P.PATTERN, t))
        signed = spark.range(1).select(F.pmod(F.xxhash64(F.lit(d["doc_id"]).cast("long")), F.lit(40))).first()[0] if d["doc_id"] < 25 else None
        if signed is not None:
            size = len(t)
            for at, removed, added in ((size // 3, 0, f" revised {d['doc_id']}"), (size // 2, signed, ""), (int(size * 0.9), 5, f" {d['source']}.\n")):
                at = min(at, len(t))
                t = t[:at] + added + t[at + removed :]
            assert r["n_tokens_edited"] == len(enc.encode_ordinary(t)) and 0 < r["n_re_encoded"] < r["n_pre_tokens"] + 60
    assert np.mean([r["n_re_encoded"] for r in got.values()]) < 60
    edits = [{"at": 3, "removed": 2, "added": " new's"}, {"at": 10**6, "removed": 5, "added": "\n\n end"}, {"at": -4, "removed": 1, "added": ""}]

    def fresh(t):
        for e in edits:
            at = min(max(0, e["at"]), len(t))
            t = t[:at] + e["added"] + t[at + e["removed"] :]
        return len(enc.encode_ordinary(t))

    same = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in e.items()]) for e in edits])
    for r in token_counts.count_edits(odd.withColumn("edits", same), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep=["doc_id", "text"]).collect():
        assert r["n_tokens_edited"] == fresh(r["text"] or "")
    assert token_counts.count_edits(none.withColumn("edits", same), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_count_tree_on_random_edits():
    counter = token_counts.Counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = np.random.default_rng(8)
    alphabet = list("ab '\n\t  12.!é日sre ll'd")
    make = lambda n: "".join(rng.choice(alphabet, n))
    for _ in range(300):
        s = make(rng.choice([0, 1, 40, 900]))
        tree = token_counts.CountTree(s, counter)
        for _ in range(4):
            a, r, add = int(rng.integers(0, len(s) + 1)), int(rng.choice([0, 1, 20, 300])), make(rng.choice([0, 1, 30, 900]))
            tree.edit(a, r, add)
            s = s[:a] + add + s[a + r :]
            pieces = [p for leaf, _ in tree.leaves for p in leaf]
            assert pieces == counter.split.findall(s) and tree.total == sum(counter.counts(pieces)) and tree.chars[1] == len(s)


# pipeline --------------------------------------------------------------------------------------
def test_pipeline(spark):
    """Every stage against a plain version on its own input."""
    import corpus_pipeline
    from tessera.llm.common import fold

    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, SF), name)
        seen.append((docs, out))
        docs = out
    for _, out in seen[:-1]:
        assert out.columns == corpus_pipeline.COLUMNS
    text_of = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    model = langid.fit(seen[0][0], fold(5) != 0)
    kept = text_of(seen[0][1])
    for i, text in text_of(seen[0][0]).items():
        if len(text or "") < 3000:  # n-gram by n-gram is slow
            _, score = plain_language(model, text)
            assert (i in kept) == (score >= model.reject_below) or abs(score - model.reject_below) < 1e-4
    trees = quality.fit(seen[1][0], spark.read.parquet(f"{SF}/labels.parquet"), fold(3) != 1)
    kept = text_of(seen[1][1])
    for i, text in text_of(seen[1][0]).items():
        x, raw = quality.statistics(text), trees.base
        for t in range(len(trees.feature)):
            node = 0
            for _ in range(trees.depth):
                node = 2 * node + 1 + int(x[trees.feature[t, node]] > trees.threshold[t, node])
            raw += trees.leaf[t, node - (1 << trees.depth) + 1]
        assert (i in kept) == (raw >= 0) or abs(raw) < 1e-9
    quality_of = {r["doc_id"]: r["quality"] for r in read("labels")}
    assert np.mean([(i in kept) == bool(q) for i, q in quality_of.items()]) > 0.95
    before = [(r["doc_id"], r["text"]) for r in seen[2][0].collect()]
    _, comp = plain_components(before)
    assert {r["doc_id"] for r in seen[2][1].collect()} == set(comp.values())
    before, mixed = {r["doc_id"]: r for r in seen[3][0].collect()}, seen[3][1].collect()
    size, taken = Counter(), Counter()
    for r in before.values():
        size[r["source"]] += len(words(r["text"]))
    for r in mixed:
        own = before[r["doc_id"]]
        assert r["text"] in own["text"] and (r["lang"], r["source"]) == (own["lang"], own["source"]) and r["n_chars"] == len(r["text"])
        taken[r["source"]] += len(words(r["text"]))
    want = plain_targets(size)
    assert all(abs(taken[s] - want[s]) <= 64 for s in want)
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in docs.collect()) == Counter((r["doc_id"], tuple(sp.encode(r["text"], add_eos=True))) for r in mixed)
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in docs.collect())


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline

    own = [(r[0], r[1], r[2], r[3], r[4], "clash") for r in ODD] + [(None, "der die das und", "de", "c", 15, "clash"), (4, "The the of and to out", "en", "b", 20, "clash"), (8, "The the of and to in", None, None, None, None)]
    docs = spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long, score string")
    for name, stage in corpus_pipeline.STAGES:
        got = materialize(stage(spark, docs, SF), name).collect()
        assert materialize(stage(spark, docs.limit(0), SF), name).count() == 0
        if name == "near_duplicates":  # null ids stay, one row of every other id, and 8 goes with 4
            assert Counter(r["doc_id"] for r in got) == Counter({None: 2, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1})
        if name == "language":
            assert all(any(map(str.isalpha, r["text"])) for r in got)
        if name == "source_mix":
            assert all(words(r["text"]) for r in got) and {r["doc_id"] for r in got} >= {None, 4, 5, 6}
        if name == "pieces":
            assert len(got) == len(own)


def test_pipeline_leaves_its_result_only(spark):
    import corpus_pipeline
    from tessera import runtime

    at = runtime.shared_dir(spark).removeprefix("file://")
    held = lambda: {os.path.join(d, f) for d, _, names in os.walk(at) for f in names if f.endswith(".parquet")}
    before = held()
    with runtime.discarding_results(spark):
        out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
        n = out.count()
        assert n > 0 and held() - before == {p.removeprefix("file://") for p in out.inputFiles()}
    assert held() == before


def test_open_shingles_meet_neighbouring_sizes_only(spark):
    from tessera.llm.jaccard_join import _met

    rows = [(1, 7, 1, 2, 10), (2, 7, 2, 1, 11), (3, 7, 3, 1, 13), (4, 8, 4, 1, 5), (5, 8, 4, 1, 5), (6, 9, 6, 1, 1)]
    got = _met(spark.createDataFrame(rows, "doc_id long, token long, comp long, level int, bucket int")).select("doc_id", "least").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1)]


def test_batches_of_long_texts_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("abcdefgh"), 512).alias("t"))

    def sizes(batches):
        for rb in batches:
            yield pa.RecordBatch.from_pydict({"rows": [rb.num_rows], "bytes": [rb.nbytes]})

    before = spark.conf.getAll.get(key)
    try:
        for own, bound in ((None, common.BATCH_BYTES), (str(1 << 20), 1 << 20)):
            if own is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, own)
            got = common.in_batches(docs).mapInArrow(sizes, "rows long, bytes long").collect()
            assert sum(r["rows"] for r in got) == 4000
            assert len(got) > 1 and max(r["bytes"] for r in got) <= 1.1 * bound
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
