"""The prefix trie against its SQL and against a plain trie of dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, turn_trie
from tessera.llm.common import Scratch
from tests import compare

ROWS = "conv_id long, turn long, role string, text string, path string, shard int, words string"


def plain_nodes(convs):
    """convs: id -> list of (role, text)."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    out = []
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len((q[-1][1] if q else "").split()) for q in below)
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(r[: len(q)] == q and len(r) > len(q) for r in below) for q in below)
        said = ",".join(map(str, sorted(ends.get(p, []))))
        out.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), len(kids), leaves, saved, hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def table(spark, convs):
    rows = [(c, i, role, text, "x", 1, "w") for c, turns in convs.items() for i, (role, text) in enumerate(turns)]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, ROWS)


@pytest.mark.parametrize("shard_turns", [1, 7, 1 << 17])
def test_trie_equals_a_plain_one(spark, shard_turns):
    rng, convs = random.Random(shard_turns), {}
    for c in range(150):
        convs[c] = [("user", "common start of all")] * (c % 3 > 0) + [(rng.choice("ua"), rng.choice(["a b", "c", "", "a"])) for _ in range(rng.randrange(0, 5))]
    for c in range(200, 260):  # a hot conversation, its start, and one far longer
        convs[c] = [("user", "hot one"), ("assistant", "said again")][: 1 + (c % 5 > 0)]
    convs[300] = [("user", "hot one")] + [("assistant", "on and on")] * 300
    given = {c: turns for c, turns in convs.items() if turns}  # a conversation without rows is not in the table
    with Scratch(spark) as work:
        got = found(turn_trie.prefix_trie(turn_trie.conversations(table(spark, given)), work, shard_turns=shard_turns))
    assert got == plain_nodes(given)


def test_conversations_without_turns_end_at_the_root(spark):
    none = F.array().cast("array<struct<turn:long,code:string,words:long>>")
    for ids, more in (([3, 5], {}), ([12, 4], {1: [("u", "a b")]})):
        convs = spark.createDataFrame([(i,) for i in ids], "conv_id long").select("conv_id", none.alias("turns"))
        if more:
            convs = convs.unionByName(turn_trie.conversations(table(spark, more)))
        with Scratch(spark) as work:
            assert found(turn_trie.prefix_trie(convs, work, shard_turns=1)) == plain_nodes({i: [] for i in ids} | more)


def test_odd_turns(spark):
    rows = [
        (1, None, None, None, None, None, None), (1, 2, "user", "b", None, None, None), (1, 1, "user", "x" * 100_000, None, None, None),
        (2, None, "", "", None, None, None), (2, 1, "user", "x" * 100_000, None, None, None), (2, 1, "user", "x" * 100_000, None, None, None), (None, 0, "user", "lost", None, None, None),
    ]
    long = ("user", "x" * 100_000)
    with Scratch(spark) as work:
        got = found(turn_trie.prefix_trie(turn_trie.conversations(spark.createDataFrame(rows, ROWS)), work))
    assert got == plain_nodes({1: [("", ""), long, ("user", "b")], 2: [("", ""), long, long]})
    with Scratch(spark) as work:
        assert turn_trie.prefix_trie(turn_trie.conversations(spark.createDataFrame([], ROWS)), work).collect() == []


def test_role_and_text_do_not_run_together(spark):
    convs = {1: [("user", "a")], 2: [("use", "ra")], 3: [("user", "a")]}
    with Scratch(spark) as work:
        assert found(turn_trie.prefix_trie(turn_trie.conversations(table(spark, convs)), work)) == plain_nodes(convs)


def test_median_order_keeps_branches_short():
    tree, n = turn_trie.TernaryTree(), 1000
    assert sorted(turn_trie.median_order(n)) == list(range(n))
    for i in turn_trie.median_order(n):
        tree.insert([i], [1], 1, i, i)
    depth, stack = 0, [(tree.root, 1)]
    while stack:
        node, d = stack.pop()
        if node >= 0:
            depth = max(depth, d)
            stack += [(tree.low[node], d + 1), (tree.high[node], d + 1)]
    assert depth == 10


def test_op13_rebuilds_from_the_first_of_each_block(spark, tmp_path):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a b c", "d", "e f"])) for c in [*range(0, 19), *range(21, 45), 60, 61] for t in range(rng.randrange(1, 5))]
    rows += [(20, None, "user", "first"), (20, 3, None, None), (20, 0, "user", "second"), (None, 1, "user", "z")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, (role or "", text or "")))
    own = {c: [x[2] for x in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    assert found(queries.op13_prefix_trie(spark, str(tmp_path))) == plain_nodes(rebuilt)


def test_op13_equals_its_sql(spark):
    assert compare.differ(spark, "/root/testdata/sf0.01", queries.QUERIES["op13_prefix_trie"], queries.ORACLE_SQL["op13_prefix_trie"]) is None
