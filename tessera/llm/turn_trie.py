"""A prefix trie over conversations, for what a prefix cache of their turns would save.

A turn is known by the first 128 bits of a SHA-256 of its role and text, a conversation by
the row of its turns' codes. Equal conversations are combined first. The distinct ones are
dealt out by ranges of their codes, so that a common first turn, or any common start, is
spread over shards; in each shard turn codes are replaced by small ids of a local
dictionary, and the sequences go into a ternary search tree in median order, which keeps
its branches balanced. One iterative walk lists the trie's nodes, parents first, and one
pass back over that list sums members, leaves and savings.

Nodes on the border of two shards are parts of one node. Every shard knows the sequence
before its first and the one after its last, so it knows which of its nodes continue
earlier ones (these count no child and no ``- 1`` of their own) and whether its last
sequence goes on in the next shard (then it is no leaf). All sums are then plain sums, and
a grouping by node merges the parts.

Null roles and texts count as empty. Turns are ordered by number, null first, equal
numbers by code; repeated rows are turns of their own. Rows without a conv_id are part of
no conversation. Without conversations there are no nodes, not even a root. A
conversation's codes meet in one row (32 bytes a turn), whatever its texts' lengths; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, Scratch

#: Hexadecimal digits of a turn's code.
CODE = 32
NO_ENDS = hashlib.sha256(b"").hexdigest()
_IDS_IN_BLOCK = 4096


def conversations(rows: DataFrame) -> DataFrame:
    """rows: conv_id, turn, role, text. A row a conversation: conv_id, turns array<struct<turn, code, words>>."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    code = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, CODE)
    turn = F.struct(F.col("turn"), code.alias("code"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return rows.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (path_id, conv_id) as blocks of ids joined by commas."""
    for rb in batches:
        rows = []
        for path, own in groupby(zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True), key=lambda r: r[0]):
            ids = [c for _, c in own]
            for i in range(0, len(ids), _IDS_IN_BLOCK):
                part = ids[i : i + _IDS_IN_BLOCK]
                rows.append((path, part[0], len(part), ",".join(map(str, part))))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["path_id", "first", "n", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted blocks as one digest a path; only the digest's state is held between blocks."""
    path, digest, n, first = None, None, 0, 0
    names = ["path_id", "conv_id", "n_convs", "ends_sha256"]

    def made(rows):
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    for rb in batches:
        done = []
        for own, at, count, ids in zip(*(c.to_pylist() for c in rb.columns), strict=True):
            if own != path:
                if digest is not None:
                    done.append((path, first, n, digest.hexdigest()))
                path, digest, n, first = own, hashlib.sha256(), 0, at
            elif n:
                digest.update(b",")
            digest.update(ids.encode())
            n += count
        yield made(done)
    if digest is not None:
        yield made([(path, first, n, digest.hexdigest())])


def _ends(convs: DataFrame) -> DataFrame:
    """path_id -> least conv_id, number and digest of the conversations of exactly that path.

    Ids are put in order by ranges over path and id, so those of one path may lie in many
    tasks; only blocks of joined ids meet in the task that hashes them, one after another."""
    n = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = convs.select("path_id", "conv_id").repartitionByRange(n, "path_id", "conv_id").sortWithinPartitions("path_id", "conv_id")
    blocks = ranged.mapInArrow(_packed, "path_id string, first long, n long, ids string")
    dealt = blocks.repartition(n, "path_id").sortWithinPartitions("path_id", "first")
    return dealt.mapInArrow(_hashed, "path_id string, conv_id long, n_convs long, ends_sha256 string")


class TernaryTree:
    """A ternary search tree over sequences of small ids; a node is a prefix."""

    def __init__(self) -> None:
        self.root = -1
        self.token: list[int] = []
        self.low: list[int] = []
        self.next: list[int] = []
        self.high: list[int] = []
        self.words: list[int] = []
        self.members: list[int] = []
        self.least: list[int] = []
        self.end: list[int] = []

    def _new(self, token: int, words: int) -> int:
        for column, value in ((self.token, token), (self.low, -1), (self.next, -1), (self.high, -1), (self.words, words), (self.members, 0), (self.least, 1 << 63), (self.end, -1)):
            column.append(value)
        return len(self.token) - 1

    def insert(self, tokens: list[int], words: list[int], members: int, least: int, row: int) -> None:
        links, at = None, -1  # the list and place that point to what comes next
        node = self.root
        for token, n in zip(tokens, words, strict=True):
            while node >= 0 and self.token[node] != token:
                links, at = (self.low if token < self.token[node] else self.high), node
                node = links[at]
            if node < 0:
                node = self._new(token, n)
                if links is None:
                    self.root = node
                else:
                    links[at] = node
            self.members[node] += members
            self.least[node] = min(self.least[node], least)
            links, at, last = self.next, node, node
            node = self.next[node]
        if tokens:
            self.end[last] = row

    def walk(self) -> list[tuple[int, int, int]]:
        """(node, its prefix's node or -1, depth), a prefix before what extends it."""
        found, stack = [], [(self.root, -1, 1)]
        while stack:
            node, parent, depth = stack.pop()
            if node < 0:
                continue
            found.append((node, parent, depth))
            stack += [(self.low[node], parent, depth), (self.high[node], parent, depth), (self.next[node], node, depth + 1)]
        return found


def median_order(n: int) -> Iterator[int]:
    """0 .. n - 1, the middle first, then the middles of both halves, and so on."""
    stack = [(0, n)]
    while stack:
        a, b = stack.pop()
        if a < b:
            mid = (a + b) // 2
            yield mid
            stack += [(mid + 1, b), (a, mid)]


def _shared_turns(a: str | None, b: str | None) -> int:
    """How many turns both paths start with; -1 if one is missing."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b)) // CODE
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * CODE] == b[: mid * CODE]:
            low = mid
        else:
            high = mid - 1
    return low


NODES = "key string, parent_key string, parent_conv_id long, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NAMES = [c.split()[0] for c in NODES.split(", ")]
_KINDS = [pa.string() if c.endswith("string") else pa.int64() for c in NODES.split(", ")]


def _shard_nodes(shard: pa.Table, fences: pa.Table) -> pa.Table:
    """The nodes of one shard. key is set where the node is also one of a neighbour's, parent_key where the parent is."""
    if not shard.num_rows:
        return pa.Table.from_arrays([pa.array([], k) for k in _KINDS], names=_NAMES)
    shard = shard.sort_by("path")
    paths, words = shard["path"].to_pylist(), shard["words"].to_pylist()
    least, members, ends = (shard[c].to_pylist() for c in ("conv_id", "n_convs", "ends_sha256"))
    before, after = fences["before"][0].as_py(), fences["after"][0].as_py()
    codes = np.frombuffer("".join(paths).encode(), f"S{CODE}")
    ids = np.unique(codes, return_inverse=True)[1].tolist()
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).tolist()
    tree = TernaryTree()
    for i in median_order(len(paths)):
        tree.insert(ids[starts[i] : starts[i + 1]], words[i], members[i], least[i], i)
    # what continues the neighbour before lies on the first path, what goes on in the next one on the last path
    continued, goes_on = _shared_turns(before, paths[0]), _shared_turns(paths[-1], after)
    keys, continues = {}, set()
    for path, turns, tokens, deep in ((paths[0], continued, ids[: starts[1]], True), (paths[-1], goes_on, ids[starts[-2] :], False)):
        node, h = tree.root, hashlib.sha256()
        for d, token in enumerate(tokens[: max(0, turns)]):
            while tree.token[node] != token:
                node = tree.low[node] if token < tree.token[node] else tree.high[node]
            h.update(path[d * CODE : (d + 1) * CODE].encode())
            keys[node] = h.hexdigest()
            if deep:
                continues.add(node)
            node = tree.next[node]
    keys[-1] = NO_ENDS  # the root is part of every shard
    if before is not None:
        continues.add(-1)
    n_all, walked = sum(members), tree.walk()
    size = len(tree.token)
    children, leaves, saved = ([0] * (size + 1) for _ in range(3))  # the root's are last, at -1
    extended = len(paths[-1]) // CODE if goes_on == len(paths[-1]) // CODE else None
    tail = len(paths) - 1
    for node, parent, _ in reversed(walked):
        if tree.next[node] < 0 and not (extended is not None and tree.end[node] == tail):
            leaves[node] += 1
        saved[node] += tree.words[node] * (tree.members[node] - (node not in continues))
        children[parent] += node not in continues
        leaves[parent] += leaves[node]
        saved[parent] += saved[node]
    if not walked and after is None:  # nothing but turnless conversations
        leaves[-1] = 1
    own_ends = ends[0] if paths[0] == "" else None
    rows = [(keys[-1], None, None, min(least), 0, n_all, children[-1], leaves[-1], saved[-1], own_ends)]
    for node, parent, depth in walked:
        shared_parent = parent in keys
        rows.append(
            (
                keys.get(node), keys[parent] if shared_parent else None, None if shared_parent else tree.least[parent], tree.least[node], depth,
                tree.members[node], children[node], leaves[node], saved[node], ends[tree.end[node]] if tree.end[node] >= 0 else None,
            )
        )
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)], names=_NAMES)


def prefix_trie(convs: DataFrame, work: Scratch, *, shard_turns: int = 1 << 17) -> DataFrame:
    """convs: conv_id (distinct), turns array<struct<turn, code, words>>, as ``conversations`` gives them.

    A row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    ``shard_turns`` is about how many turns of distinct conversations a shard holds."""
    path = F.array_join(F.col("turns.code"), "")
    convs = convs.select("conv_id", path.alias("path"), F.sha2(path, 256).alias("path_id"), F.col("turns.words").alias("words"))
    convs = work.keep(convs, "paths")
    apart = convs.groupBy("path").agg(F.first("words").alias("words")).withColumn("path_id", F.sha2("path", 256))
    apart = work.keep(apart.join(_ends(convs), "path_id").drop("path_id"), "apart")
    turns = apart.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    shards = apart.repartitionByRange(max(1, -(-turns // shard_turns)), "path").withColumn("shard", F.spark_partition_id())
    shards = work.keep(shards, "shards")
    order = Window.orderBy("shard")  # a row a shard
    fences = shards.groupBy("shard").agg(F.min("path").alias("least"), F.max("path").alias("most"))
    fences = fences.select("shard", F.lag("most").over(order).alias("before"), F.lead("least").over(order).alias("after"))
    nodes = work.keep(shards.groupBy("shard").cogroup(fences.groupBy("shard")).applyInArrow(_shard_nodes, NODES), "nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    border = nodes.where("key is not null").groupBy("key").agg(F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *sums, F.max("ends_sha256").alias("ends_sha256"))
    border = work.keep(border, "border")
    parents = border.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("__parent"))
    inner = nodes.where("key is null")
    counts = ["n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    below = inner.where("parent_key is not null").drop("key", "parent_conv_id").unionByName(border.drop("key"))
    below = below.join(parents, "parent_key", "left").select("conv_id", "depth", F.col("__parent").alias("parent_conv_id"), *counts)
    within = inner.where("parent_key is null").select("conv_id", "depth", "parent_conv_id", *counts)
    return work.release(within.unionByName(below).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))))
