"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Each document is the set of its distinct word shingles. Two documents whose Jaccard
similarity reaches the threshold must share at least l of the first
``size - ceil(threshold * size) + l`` shingles of any common order, for every l. The order
here puts shingles that few documents have first (document frequencies of all shingles in
a fixed table of hashed counters, ties by hash). Every document picks its own l: the
candidates' cost for l is the summed frequency of its prefix, plus the price of verifying
at most sum / l candidates. A pair has to share the smaller l of the two in their prefixes.

Words are hashed by a keyed function (SipHash), and links are verified on the words themselves.
Equal sets fall into classes by a 128-bit fingerprint first; only class representatives
are joined. Links are wanted as components, so a star round pairs every representative
with one leader only - the one it shares most prefix shingles with - and verifies these
pairs on the texts. What remains are prefix shingles whose documents lie in several
components: there, all pairs across components are compared in blocks of bounded size, a
pair only at the shingle that is the l-th they share; pairs whose size or shingle histogram
already excludes the threshold are dropped, the others verified. No link between different
components is lost, and pairs inside one are never emitted.

Null texts and texts without words have no shingles and no links; with fewer words than a
shingle the whole sequence is one shingle; rows that share an id are one vertex, which links
what any of their texts links, and give a row each; documents of any length are read whole;
rows with a null id stay alone, without a component; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, in_batches, mix64, sub_batches
from tessera.llm.graph import components

SKETCH = 128
KEY = "shingles of words"[:16]


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: bytes are lower-cased and split at white space by ASCII rules, which are the ones wanted."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text; words are hashed by SipHash."""
    split = [words_of(t) for t in texts]
    size = [len(w) for w in split]
    flat = np.empty(sum(size), object)
    flat[:] = list(chain.from_iterable(split))
    h = pd.util.hash_array(flat, hash_key=KEY, categorize=False) if len(flat) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        whole = _joined(h, width) if len(h) >= width else h
        out, at = [], 0
        for n in size:
            out.append(np.unique(whole[at : at + n - width + 1] if n >= width else _joined(h[at : at + n], n)) if n else h[:0])
            at += n
    return out


def _joined(h: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of ``width`` hashes."""
    s = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        s = mix64(s * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - width + 1 + i])
    return s


def exact_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct numbers of every text's shingles: equal in all of ``texts`` if and only if the shingles are."""
    number: dict[bytes, int] = {}
    split = [[number.setdefault(w, len(number)) for w in words_of(t)] for t in texts]
    rows = []
    for w in split:  # a shorter text is one shingle, filled up by a number that no word has
        w = w + [-1] * (width - len(w)) if w else w
        rows.append(np.lib.stride_tricks.sliding_window_view(np.array(w, np.int64), width) if w else np.zeros((0, width), np.int64))
    if (len(number) + 1) ** width < 1 << 62:
        place = np.array([(len(number) + 1) ** i for i in range(width)], np.int64)
        return [np.unique((r + 1) @ place) for r in rows]
    name = np.unique(np.concatenate(rows), axis=0, return_inverse=True)[1].ravel()
    return [np.unique(part) for part in np.split(name, np.cumsum([len(r) for r in rows])[:-1])]


def least_overlap(size: int, percent: int) -> int:
    return -(-size * percent // 100)


def choose_prefix(tokens: np.ndarray, frequency: np.ndarray, percent: int, most: int, verify_cost: float) -> tuple[int, np.ndarray]:
    """(l, prefix) of the least estimated cost; tokens in the common order, frequency theirs."""
    n = len(tokens)
    base, need = n - least_overlap(n, percent), least_overlap(n, percent)
    best, cost = 1, math.inf
    run = np.cumsum(frequency[: base + most])
    for level in range(1, min(most, need) + 1):
        lists = float(run[min(base + level, n) - 1])
        if (c := lists + verify_cost * lists / level) < cost:
            best, cost = level, c
    return best, tokens[: base + best]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _frequencies(docs: DataFrame, width: int, cells: int) -> np.ndarray:
    """Hashed document frequencies of all shingles: a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for rb in batches:
            texts = rb.column(0).to_pylist()
            for a, b in sub_batches(texts, 1_000_000):
                sets = shingle_sets(texts[a:b], width)
                total += np.bincount((np.concatenate(sets) & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["cell", "n"])

    got = in_batches(docs).select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(cells, np.int64)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out


_PREFIX = "doc_id long, n long, fingerprint binary, level int, prefix array<long>, sketch binary"


def _prefixes(docs: DataFrame, frequency: np.ndarray, width: int, percent: int, most: int, verify_cost: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for rb in batches:
            texts = rb.column(1).to_pylist()
            for a, b in sub_batches(texts, 1_000_000):
                n, key, level, prefix, sketch = [], [], [], [], []
                for s in shingle_sets(texts[a:b], width):
                    n.append(len(s))
                    key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    if not len(s):
                        level.append(0)
                        prefix.append([])
                        sketch.append(b"")
                        continue
                    own = f[(s & np.uint64(len(f) - 1)).astype(np.int64)]
                    order = np.lexsort([s, own])
                    x, p = choose_prefix(s[order], own[order], percent, most, verify_cost)
                    level.append(x)
                    prefix.append(p.view(np.int64))
                    in_cell = np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=SKETCH)
                    sketch.append(np.minimum(in_cell, 255).astype(np.uint8).tobytes())
                kinds = (pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.binary())
                made = [pa.array(v, k) for v, k in zip((n, key, level, prefix, sketch), kinds, strict=True)]
                ids = rb.slice(a, b - a).column(0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, *made], names=["doc_id", "n", "fingerprint", "level", "prefix", "sketch"])

    return in_batches(docs).select("doc_id", "text").mapInArrow(run, _PREFIX)


def _near(a: np.ndarray, b: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Whether histograms a and b (rows) leave the threshold possible; they differ by at most the symmetric difference."""
    apart = np.abs(a - b).sum(1)
    return 100 * (total - apart) >= percent * (total + apart)


def _histograms(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), SKETCH).astype(np.int16)


def _plausible(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of pairs whose sizes and shingle histograms do not exclude the threshold."""
    facts = own.select(F.col("doc_id"), F.col("n"), F.col("sketch"))
    left = pairs.join(facts, pairs["a"] == facts["doc_id"]).select("a", "b", F.col("n").alias("x"), F.col("sketch").alias("p"))
    both = left.join(facts, left["b"] == facts["doc_id"]).where(100 * F.least("x", "n") >= percent * F.greatest("x", "n"))
    both = both.select("a", "b", (F.col("x") + F.col("n")).alias("t"), "p", F.col("sketch").alias("q"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if rb.num_rows:
                good = _near(_histograms(rb.column(3).to_pylist()), _histograms(rb.column(4).to_pylist()), rb.column(2).to_numpy(), percent)
                yield rb.filter(pa.array(good)).select(["a", "b"])

    return both.mapInArrow(keep, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int, bits: int = 20) -> DataFrame:
    """The (a, b) of pairs that reach the threshold on their texts.

    Only texts whose hashed id occurs in pairs are shuffled; that table has 2**bits cells at most."""
    spark = docs.sparkSession
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits)).cast("int")
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).select(cell.alias("c")).distinct().toArrow()["c"].to_numpy()
    wanted = np.zeros(1 << bits, bool)
    wanted[ids] = True
    shared = spark.sparkContext.broadcast(np.packbits(wanted))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.unpackbits(shared.value).astype(bool)
        for rb in batches:
            found = rb.filter(pa.array(mask[rb.column(2).to_numpy()]))
            if found.num_rows:
                yield found.select(["doc_id", "text"])

    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = in_batches(texts.withColumn("c", cell)).mapInArrow(some, "doc_id long, text string")
    left = pairs.join(texts.withColumnRenamed("text", "x"), pairs["a"] == F.col("doc_id")).select("a", "b", "x")
    full = left.join(texts.withColumnRenamed("text", "y"), F.col("b") == F.col("doc_id")).select("a", "b", "x", "y")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            x, y = rb.column(2).to_pylist(), rb.column(3).to_pylist()
            good = []
            for i, j in sub_batches([p + q for p, q in zip(x, y, strict=True)], 1_000_000):
                both = list(dict.fromkeys(x[i:j] + y[i:j]))
                seen = dict(zip(both, exact_sets(both, width), strict=True))
                good += [linked(seen[p], seen[q], percent) for p, q in zip(x[i:j], y[i:j], strict=True)]
            yield rb.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    return in_batches(full).mapInArrow(check, "a long, b long").distinct()


def _pairs_of(rows: list[tuple], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of rows of one block that may link at this shingle.

    A row: part, doc_id, component, size, level, open shingles of the prefix before this one, sketch."""
    part = np.array([r[0] for r in rows])
    comp, size, level = (np.array([r[i] for r in rows]) for i in (2, 3, 4))
    sides = np.unique(part)
    left = np.flatnonzero(part == sides[0])
    right = left if len(sides) == 1 else np.flatnonzero(part == sides[1])
    # how many shingles below the token each pair shares: a product of 0/1 matrices
    own = [r[5] for r in rows]
    names, at = np.unique(np.concatenate(own), return_inverse=True) if any(map(len, own)) else (np.zeros(0), np.zeros(0, int))
    of = np.repeat(np.arange(len(rows)), [len(o) for o in own])
    often = np.bincount(at, minlength=len(names)) > 1
    column = np.cumsum(often) - 1
    has = np.zeros((len(rows), int(often.sum())), np.float32)
    keep = often[at]
    has[of[keep], column[at[keep]]] = 1
    earlier = has[left] @ has[right].T
    small, great = np.minimum(size[left][:, None], size[right][None]), np.maximum(size[left][:, None], size[right][None])
    ok = (comp[left][:, None] != comp[right][None]) & (100 * small >= percent * great)
    ok &= earlier == np.minimum(level[left][:, None], level[right][None]) - 1
    if right is left:
        ok &= np.tri(len(left), k=-1, dtype=bool).T
    i, j = np.nonzero(ok)
    i, j = left[i], right[j]
    if len(i):
        sketch = _histograms([r[6] for r in rows])
        good = np.zeros(len(i), bool)
        for k in range(0, len(i), 4096):
            a, b = i[k : k + 4096], j[k : k + 4096]
            good[k : k + 4096] = _near(sketch[a], sketch[b], size[a] + size[b], percent)
        i, j = i[good], j[good]
    return i, j


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """rows sorted by (token, low, high) within partitions; candidate pairs of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def solve() -> tuple[list, list]:
            if len(held) < 2:
                return [], []
            i, j = _pairs_of(held, percent)
            ids = np.array([r[1] for r in held])
            return np.maximum(ids[i], ids[j]).tolist(), np.minimum(ids[i], ids[j]).tolist()

        for rb in batches:
            a, b = [], []
            token, low, high, part, doc, comp, n, level = (rb.column(c).to_pylist() for c in range(8))
            prefix, sketch = rb.column(8), rb.column(9).to_pylist()
            values, off = prefix.flatten().to_numpy(), np.concatenate([[0], np.cumsum(prefix.value_lengths().to_numpy())])
            for r in range(rb.num_rows):
                now = (token[r], low[r], high[r])
                if now != key:
                    x, y = solve()
                    a += x
                    b += y
                    held.clear()
                    key = now
                held.append((part[r], doc[r], comp[r], n[r], level[r], values[off[r] : off[r + 1]], sketch[r]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        x, y = solve()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def _met(postings: DataFrame) -> DataFrame:
    """postings: doc_id, token, comp, level, bucket. Those met by another component's document of a size that may link.

    ``bucket`` grows by one where the size grows by more than the threshold allows, so a pair lies in equal or
    neighbouring buckets. ``least`` is the least level met there. A token's window holds a row a bucket."""
    near = Window.partitionBy("token").orderBy("bucket").rangeBetween(-1, 1)
    cells = postings.groupBy("token", "bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min("level").alias("l"))
    cells = cells.select("token", "bucket", F.min("x").over(near).alias("x"), F.max("y").over(near).alias("y"), F.min("l").over(near).alias("least"))
    return postings.join(cells.where("x <> y").select("token", "bucket", "least"), ["token", "bucket"])


def _still_open(postings: DataFrame, work: Scratch) -> DataFrame:
    """postings: doc_id, token, comp, level, bucket. Those that a pair across components can still need, with ``need``.

    A pair shares at least the smaller l of the two, all in shingles met across components; so a
    document with fewer of these than ``need`` - its own l or the least l met in them - is in no pair."""
    mixed = work.keep(_met(postings), "mixed")
    need = mixed.groupBy("doc_id").agg(F.count("*").alias("m"), F.least(F.min("level"), F.min("least")).alias("need")).where("m >= need").select("doc_id", "need")
    out = work.keep(mixed.drop("least").join(need, "doc_id").select("doc_id", "token", "comp", "level", "bucket", "need"), "open")
    work.drop(mixed)
    return out


def jaccard_components(
    docs: DataFrame, *, width: int = 3, percent: int = 90, most_matches: int = 6, verify_cost: float = 8.0, cells: int = 1 << 18, block: int = 512,
) -> DataFrame:
    """docs: doc_id, text. One row a document: doc_id, n_shingles, component_id."""
    with Scratch(docs.sparkSession) as work:
        frequency = _frequencies(docs, width, cells)
        prefix = work.keep(_prefixes(docs, frequency, width, percent, most_matches, verify_cost), "prefix")
        sized = work.keep(prefix.select("doc_id", F.col("n").alias("n_shingles"), "fingerprint"), "sized")
        named = prefix.where("n > 0 and doc_id is not null")
        classes = work.keep(named.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")), "classes")
        # the representative's row; rows repeated with the same id and set are one
        own = named.join(classes, (named["fingerprint"] == classes["fingerprint"]) & (named["doc_id"] == classes["rep"]), "left_semi")
        own = work.keep(own.dropDuplicates(["doc_id", "fingerprint"]).drop("fingerprint"), "own")
        work.drop(prefix)
        # an id with several texts is one vertex: it links their classes
        ids = sized.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("fingerprint").alias("x"), F.max("fingerprint").alias("y"))
        repeated = work.keep(ids.where("n > 1 and x is not null").select("doc_id", (F.col("x") < F.col("y")).alias("several")), "repeated")
        found = work.keep(_links(own, docs, work, width, percent, block), "found")
        again = sized.where("fingerprint is not null").join(repeated.where("several").select("doc_id"), "doc_id")
        tied = again.join(classes, "fingerprint").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
        # lift to components: one label a document
        label = work.keep(components(found.union(tied)), "label")
        vertex = classes.join(label, classes["rep"] == label["v"], "left").select("fingerprint", F.coalesce("c", "rep").alias("component_id"))
        vertex = work.keep(vertex, "vertex")
        work.drop(classes, found, label)
        done = sized.where("fingerprint is not null and doc_id is not null").join(vertex, "fingerprint").select("doc_id", "n_shingles", "component_id")
        # a row without words has its id's component, if that has rows with words, else it stays alone
        bare = sized.where("fingerprint is null and doc_id is not null").select("doc_id", "n_shingles")
        worded = sized.join(repeated, "doc_id", "left_semi").join(vertex, "fingerprint").groupBy("doc_id").agg(F.min("component_id").alias("c"))
        bare = bare.join(worded, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))
        # rows without an id are in no component, and in no join
        nameless = sized.where("doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return work.release(done.union(bare).union(nameless))


def _links(own: DataFrame, docs: DataFrame, work: Scratch, width: int, percent: int, block: int) -> DataFrame:
    """Links (a, b) of representatives, enough of them to connect every component. Drops ``own``."""
    postings = own.select("doc_id", F.explode("prefix").alias("token"))
    shared = postings.groupBy("token").agg(F.count("*").alias("k"), F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest"))
    shared = work.keep(shared.where("k > 1"), "shared")
    held = work.keep(postings.join(shared.select("token", "least", "greatest"), "token"), "held")
    work.drop(shared)
    facts = work.keep(own.drop("prefix"), "facts")
    work.drop(own)
    # star rounds: one leader a document, the one it shares most prefix shingles with
    edges = None
    for leader in ("least", "greatest"):
        ask = held.where(F.col(leader) != F.col("doc_id"))
        best = ask.groupBy("doc_id", leader).count().groupBy("doc_id").agg(F.max_by(leader, F.struct("count", F.col(leader))).alias("b"))
        pairs = work.keep(best.select(F.col("doc_id").alias("a"), "b"), "pairs")
        plausible = work.keep(_plausible(pairs, facts, percent), "plausible")
        found = _verified(plausible, docs, width, percent)
        edges = work.keep(found if edges is None else found.union(edges), "edges")
        work.drop(pairs, plausible)
    label = work.keep(components(edges), "label")
    placed = facts.join(label, facts["doc_id"] == label["v"], "left").select("doc_id", "n", "level", "sketch", F.coalesce("c", "doc_id").alias("comp"))
    placed = work.keep(placed, "placed")
    work.drop(facts, label)
    bucket = F.floor(F.log("n") / math.log(100 / (percent - 0.5))).cast("int")
    open_ = held.select("doc_id", "token").join(placed.select("doc_id", "comp", "level", bucket.alias("bucket")), "doc_id")
    open_ = work.keep(open_, "open")
    work.drop(held)
    for _ in range(2):
        before, open_ = open_, _still_open(open_.drop("need"), work)
        work.drop(before)
    # of its prefix a document carries the shingles that are open: it shares no others across components
    facts_of = [F.first(c).alias(c) for c in ("need", "comp", "level", "bucket")]
    carried = work.keep(open_.groupBy("doc_id").agg(F.array_sort(F.collect_list("token")).alias("prefix"), *facts_of), "carried")
    work.drop(open_)
    # no shingle before the need-th can be the one at which a pair is compared; ``earlier`` counts those before it
    late = F.posexplode(F.slice("prefix", F.col("need"), F.size("prefix"))).alias("at", "token")
    light = carried.select("doc_id", "comp", "level", "bucket", "need", late)
    light = light.withColumn("earlier", F.col("need") - 1 + F.col("at")).drop("need", "at")
    light = work.keep(_met(light).select("doc_id", "token", "earlier"), "light")
    # a token's documents in blocks; each block meets every other, and itself, once
    sizes = light.groupBy("token").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    dealt = light.join(sizes, "token").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(4)), F.col("parts")).cast("int"))
    rows = dealt.join(placed.join(carried.select("doc_id", "prefix"), "doc_id"), "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    before = F.slice("prefix", F.lit(1), F.col("earlier")).alias("before")
    sides = [F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")]
    rows = rows.select("token", *sides, "part", "doc_id", "comp", "n", "level", before, "sketch")
    rows = rows.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high")
    candidates = work.keep(_across(rows, percent), "candidates")
    work.drop(light, carried, placed)
    return _verified(candidates, docs, width, percent).union(edges)
