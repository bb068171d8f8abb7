"""Mixing sources to target weights over output shards.

1. *Targets.* Sources in code point order (null last) weigh ``weights`` in turn; the target
   words of a source stop at ``max_repeat`` times its size and the excess is dealt again by
   weight until nothing exceeds (one row a source goes to the driver, never documents).
2. *Blocks.* A document is a run of blocks of ``block_words`` words, the last one shorter. A
   hash permutes each source's documents, and with them its blocks; two-level prefix sums
   (hash buckets, then documents of a bucket) number the blocks exactly and add up their words
   without a task that holds a whole source. A source is taken whole as often as it fits its
   target, then up to the block at which the rest of its target is met: that fixes the exact
   number of blocks it gives.
3. *Splitting tree.* The vector of block quotas is split recursively among the shards: at
   each node the left half's vector is multivariate hypergeometric, seeded by the node. A
   task descends to its own shards only.
4. *Draws.* A shard takes the next blocks of each source's permutation, disjoint from all
   other shards', as runs of one document's blocks (a document is cut only where a shard or a
   target ends), and orders its own runs by a hash.

Rows are told apart by all their columns; rows equal in all of them are numbered. Null texts
have size 0 and are never drawn; sources of size 0 get target 0; documents of any length are
taken alike; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch, WORD, in_batches


@dataclass(frozen=True)
class Source:
    number: int
    name: str | None
    size: int
    target: float


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...], share: float, max_repeat: float) -> list[Source]:
    """Water filling: every source's target words."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = [weights[i % len(weights)] for i in range(len(order))]
    left, open_, target = share * sum(n for _, n in order), set(range(len(order))), [0.0] * len(order)
    while open_:
        total = sum(weight[i] for i in open_)
        full = {i for i in open_ if left * weight[i] / total > max_repeat * order[i][1]}
        if not full:
            for i in open_:
                target[i] = left * weight[i] / total
            break
        for i in full:
            target[i] = max_repeat * order[i][1]
        left -= sum(target[i] for i in full)
        open_ -= full
    return [Source(i, name, n, target[i]) for i, (name, n) in enumerate(order)]


def hypergeometric_weights(good: int, bad: int, take: int) -> tuple[np.ndarray, np.ndarray]:
    """Outcomes and probabilities, from the ratios of neighbouring ones, over all outcomes within 40
    standard deviations of the most likely one (what lies beyond is under the least double)."""
    n = good + bad
    low, high = max(0, take - bad), min(good, take)
    middle = min(max((good + 1) * (take + 1) // (n + 2), low), high)
    spread = 40 * (take * (good / n) * (bad / n) * (n - take) / max(1, n - 1)) ** 0.5 + 40
    low, high = max(low, int(middle - spread)), min(high, int(middle + spread))
    k = np.arange(low, high, dtype=float)
    ratio = np.log(good - k) + np.log(take - k) - np.log(k + 1) - np.log(bad - take + k + 1)
    log = np.concatenate([[0.0], np.cumsum(ratio)])
    p = np.exp(log - log.max())
    return np.arange(low, high + 1), p / p.sum()


def hypergeometric(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """Good ones among ``take`` drawn without replacement, for any numbers."""
    if good + bad < 1_000_000_000:  # what numpy's own sampler accepts
        return int(rng.hypergeometric(good, bad, take))
    outcome, p = hypergeometric_weights(good, bad, take)
    return int(outcome[min(int(np.searchsorted(np.cumsum(p), rng.random(), "right")), len(outcome) - 1)])


def split(quota: np.ndarray, left: int, right: int, seed: int, node: int) -> np.ndarray:
    """How many blocks of each source go to the left ``left`` of ``left + right`` shards."""
    total = int(quota.sum())
    take, rest, out = total * left // (left + right), total, np.zeros_like(quota)
    rng = np.random.default_rng([seed, node])
    for i, n in enumerate(quota.tolist()):  # one hypergeometric draw a source, each given those before
        if take and n:
            out[i] = hypergeometric(rng, n, rest - n, take)
            take -= int(out[i])
        rest -= n
    return out


def shard_quotas(quota: np.ndarray, first: int, last: int, shards: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, offset of each source, blocks of each source) for first <= shard < last."""

    def walk(node: int, low: int, high: int, own: np.ndarray, before: np.ndarray):
        if high <= first or low >= last:
            return
        if high - low == 1:
            yield low, before, own
            return
        mid = (low + high) // 2
        left = split(own, mid - low, high - mid, seed, node)
        yield from walk(2 * node, low, mid, left, before)
        yield from walk(2 * node + 1, mid, high, own - left, before + left)

    yield from walk(1, 0, shards, quota, np.zeros_like(quota))


def _row_id(docs: DataFrame) -> Column:
    """128 bits of all columns; every reading of the table gives a row the same."""
    columns = [F.to_json(f.name) if isinstance(f.dataType, (T.MapType, T.VariantType)) else F.col(f.name) for f in docs.schema.fields]
    nulls = F.concat(*[F.col(f.name).isNull().cast("int").cast("string") for f in docs.schema.fields])
    return F.struct(F.xxhash64(nulls, *columns).alias("a"), F.xxhash64(F.lit(17), nulls, *columns).alias("b"))


def _numbered(rows: DataFrame, count: str = "copies") -> DataFrame:
    """A row for every number from 0 under ``count``, in two steps so that no array is long."""
    rows = rows.withColumn("__k", F.explode(F.expr(f"sequence(0L, ({count} - 1) div 4096)")))
    own = F.expr(f"explode(sequence(__k * 4096, least(__k * 4096 + 4095, {count} - 1)))")
    return rows.select("*", own.alias("number")).drop("__k", count)


def mix(
    docs: DataFrame, work: Scratch, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_repeat: int = 2, block_words: int = 128,
    shard_blocks: int = 8192, bucket_rows: int = 4096, seed: int = 11,
) -> tuple[DataFrame, DataFrame, list[Source]]:
    """docs: doc_id, source, text, .... Returns (documents, draws, sources); ``work`` holds their tables.

    documents: row_id, copies (equal rows), doc_id, source, size. draws: row_id, number (of equal rows),
    copy (0, 1, ...), shard, place (order in the shard, from 1), first and blocks (the run of the
    document's blocks), words, whole (the run is the document)."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(_row_id(docs).alias("row_id"), "doc_id", "source", size.alias("size"))
    documents = work.keep(rows.groupBy("row_id", "doc_id", "source", "size").agg(F.count("*").alias("copies")), "documents")
    facts = documents.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n"), F.sum("copies").alias("rows")).collect()
    sources = targets([(r["source"], int(r["n"])) for r in facts], weights, share, max_repeat)
    buckets = {r["source"]: max(1, int(r["rows"]) // bucket_rows) for r in facts}
    # one row a source
    names = F.broadcast(spark.createDataFrame([(s.name, s.number, buckets[s.name]) for s in sources], "s_name string, s long, buckets long"))
    units = _numbered(documents.where("size > 0").join(names, F.col("source").eqNullSafe(F.col("s_name"))).drop("s_name", "doc_id", "source"))
    units = units.withColumn("u", F.pmod(F.xxhash64(F.lit(seed), "row_id", "number"), F.lit(1 << 40)))
    units = units.withColumn("bucket", F.shiftright(F.col("u") * F.col("buckets"), 40)).withColumn("n", F.expr(f"(size - 1) div {block_words} + 1")).drop("buckets")
    sums = units.groupBy("s", "bucket").agg(F.sum("n").alias("b"), F.sum("size").alias("w"))
    earlier = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("s", "bucket", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in ("b", "w")])
    inside = Window.partitionBy("s", "bucket").orderBy("u", "row_id", "number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = units.withColumn("b", F.sum("n").over(inside) - F.col("n")).withColumn("w", F.sum("size").over(inside) - F.col("size")).join(starts, ["s", "bucket"])
    placed = placed.select("row_id", "number", "s", "size", "n", (F.col("b") + F.col("b0")).alias("position"), (F.col("w") + F.col("w0")).alias("before"))
    placed = work.keep(placed, "placed")
    total = {int(r["s"]): int(r["n"]) for r in placed.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    whole = {s.number: min(max_repeat, int(s.target // s.size)) if s.size else 0 for s in sources}
    # blocks of the last, partial copy: those whose middle lies within the rest of the target
    rest = {s.number: s.target - whole[s.number] * s.size if whole[s.number] < max_repeat else -1.0 for s in sources}
    plan = [(s.number, whole[s.number], float(rest[s.number]), total.get(s.number, 0)) for s in sources]
    taken = placed.join(F.broadcast(spark.createDataFrame(plan, "s long, whole long, rest double, blocks long")), "s")
    full = F.floor((F.col("rest") - F.col("before") - block_words / 2) / block_words) + 1
    last = F.col("before") + block_words * (F.col("n") - 1) + (F.col("size") - block_words * (F.col("n") - 1)) / 2 <= F.col("rest")
    part = F.when(last, F.col("n")).otherwise(F.greatest(F.lit(0), F.least(full, F.col("n") - 1))).cast("long")
    taken = taken.withColumn("part", part)
    quota_of = {int(r["s"]): int(r["n"]) for r in taken.groupBy("s").agg(F.sum(F.col("n") * F.col("whole") + F.col("part")).alias("n")).collect()}
    quota = np.array([quota_of.get(s.number, 0) for s in sources], np.int64)
    shards = max(1, -(-int(quota.sum()) // shard_blocks))
    cell = max(1, shard_blocks // 4)
    copies = F.expr("transform(sequence(0L, whole), c -> struct(c as copy, if(c < whole, n, part) as t))")
    draws = taken.withColumn("c", F.explode(copies)).where("c.t > 0").withColumn("d", F.col("c.copy") * F.col("blocks") + F.col("position"))
    draws = draws.select("row_id", "number", "s", "size", "n", "c.copy", "d", (F.col("d") + F.col("c.t")).alias("e"))
    draws = draws.withColumn("cell", F.explode(F.expr(f"sequence(d div {cell}, (e - 1) div {cell})")))

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for low in pdf["id"].tolist():
                found = []
                for shard, offset, own in shard_quotas(quota, low, min(low + 64, shards), shards, seed):
                    for i in np.flatnonzero(own).tolist():
                        a, b = int(offset[i]), int(offset[i] + own[i])
                        found += [(shard, i, a, b, c) for c in range(a // cell, (b - 1) // cell + 1)]
                yield pd.DataFrame(found, columns=["shard", "s", "low", "high", "cell"])

    runs = spark.range(0, shards, 64).mapInPandas(leaves, "shard long, s long, low long, high long, cell long")
    a, b = F.greatest("d", "low"), F.least("e", "high")
    dealt = draws.join(runs, ["s", "cell"]).where((a < b) & (F.expr(f"greatest(d, low) div {cell}") == F.col("cell")))
    dealt = dealt.select("row_id", "number", "copy", "shard", (a - F.col("d")).alias("first"), (b - a).alias("blocks"), "n", "size")
    words = F.least(F.col("size"), (F.col("first") + F.col("blocks")) * block_words) - F.col("first") * block_words
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "shard", "row_id", "number", "copy", "first"), "row_id", "number", "copy", "first")
    place = F.row_number().over(local).alias("place")
    dealt = dealt.select("row_id", "number", "copy", "shard", place, "first", "blocks", words.alias("words"), (F.col("blocks") == F.col("n")).alias("whole"))
    return documents, work.keep(dealt, "draws"), sources


def taken_by_document(documents: DataFrame, draws: DataFrame, sources: list[Source]) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document, and the shard and place of its first run;
    documents never drawn have taken 0 and no place."""
    spark = documents.sparkSession
    facts = [(s.name, s.size, float(s.target)) for s in sources]
    names = F.broadcast(spark.createDataFrame(facts, "s_name string, source_size long, target double"))
    own = draws.groupBy("row_id", "number").agg(F.sum("words").cast("long").alias("taken"), F.min(F.struct("shard", "place")).alias("at"))
    # documents without words are in no draw
    found = _numbered(documents.where("size > 0")).join(own, ["row_id", "number"], "left").drop("number")
    bare = _numbered(documents.where("size = 0")).drop("number").withColumns({"taken": F.lit(None).cast("long"), "at": F.lit(None).cast("struct<shard:long,place:int>")})
    found = found.unionByName(bare).join(names, F.col("source").eqNullSafe(F.col("s_name")), "left")
    return found.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "at.shard", "at.place")


_WORDS = re.compile(WORD)


def cut_words(text: str, first: int, words: int) -> str:
    """``words`` words of text from the ``first``-th on, with the white space between them as it is."""
    start = end = 0
    for i, m in enumerate(_WORDS.finditer(text)):
        if i == first:
            start = m.start()
        if i == first + words - 1:
            end = m.end()
            break
    return text[start:end]


def mixed_texts(docs: DataFrame, draws: DataFrame, block_words: int = 128) -> DataFrame:
    """The mix: a row for every drawn run, in the columns of docs, shard and place; partitions hold whole
    shards, in order. A whole document's text is unchanged, another run's is cut out of it as it stands.
    Columns of docs named shard or place are replaced."""
    one = F.row_number().over(Window.partitionBy("__row").orderBy("__row"))
    texts = docs.withColumn("__row", _row_id(docs)).withColumn("__one", one).where("__one = 1").drop("__one", "shard", "place")
    runs = draws.select(F.col("row_id").alias("__row"), "shard", "place", (F.col("first") * block_words).alias("__first"), F.col("words").alias("__n"), F.col("whole").alias("__whole"))
    joined = texts.join(runs, "__row").drop("__row")
    kept = [c for c in joined.columns if c not in ("__first", "__n")]
    schema = T.StructType([joined.schema[c] for c in kept])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            text, whole = rb.column("text"), rb.column("__whole")
            at = np.flatnonzero(~whole.to_numpy(zero_copy_only=False))
            if len(at):  # few: most rows are handed on as they are
                part = rb.take(pa.array(at))
                said = [cut_words(*r) for r in zip(*[part.column(c).to_pylist() for c in ("text", "__first", "__n")], strict=True)]
                text = pc.replace_with_mask(text, pc.invert(whole), pa.array(said, text.type))
            yield pa.RecordBatch.from_arrays([text if c == "text" else rb.column(c) for c in kept], names=kept)

    mixed = in_batches(joined).mapInArrow(cut, schema)
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        mixed = mixed.withColumn("n_chars", F.when(F.col("__whole"), F.col("n_chars")).otherwise(size))
    return mixed.drop("__whole").repartition("shard").sortWithinPartitions("shard", "place")
