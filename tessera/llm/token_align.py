"""Alignment of two tokenizers' tokens by an associative fragment monoid.

Both tokenizers end a token wherever a visible character stands before a space or a line
end; call such a place a cut. A fragment of a text's bytes is an open head up to its first
cut, the closed part up to its last cut, and an open tail; a fragment without a cut is a
head alone. Heads and tails are kept as bytes, the closed part as what follows from its
tokens: counts, groups (between offsets where tokens of both end) and links (pairs of
tokens whose bytes overlap). ``compose`` closes what a tail and a head make together. It is
associative, so byte ranges of a very long text are done by different tasks, wherever the
ranges begin, and put together by a tree of compositions.

In a closed part every distinct chunk between two cuts is tokenised and aligned once a
task: the ends of its tokens, sorted together, split its bytes into pieces of one token of
either kind each, and these pieces are its links. The table of chunks is emptied when it
outgrows ``table_limit`` characters.

A link's count is that of its pair of ids over all documents. Counts are summed in Spark;
up to ``broadcast_pairs`` distinct pairs they are sent to the tasks that read the links a
document, and over that the links are joined to them.

Null and empty texts, and texts that the pieces do not give back byte by byte, have no
tokens: all figures are 0 and the groups ''. Repeated rows are counted each; an empty table
gives no rows; texts of any length are read whole; columns named like those added are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch, in_batches, sub_batches, without

MARK = "▁"
FIGURES = ("n_a", "n_b", "n_groups", "n_links")
#: A cut lies before a space or line end, behind a byte that ends a visible character. What follows a byte
#: of a longer character is decided only where three bytes stand before it (white space has no longer ones).
_CUT = re.compile(
    rb"(?:(?<=[\x21-\x7e])|(?<=[\x00-\xff]{2}[\x80-\xff])(?<!\xc2[\x85\xa0])(?<!\xe1\x9a\x80)(?<!\xe2\x80[\x80-\x8a\xa8\xa9\xaf])(?<!\xe2\x81\x9f)(?<!\xe3\x80\x80))(?=[ \n])"
)
_SPACED = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_VISIBLE = re.compile(r"(?<=\S)(?=[ \n])")


def cuts(data: bytes) -> list[int]:
    return [m.start() for m in _CUT.finditer(data)]


def chunks_of(text: str) -> list[str]:
    """text between its cuts."""
    if not _OTHER_SPACE.search(text):
        return _SPACED.findall(text)
    return _VISIBLE.split(text)


class Tokenizers:
    """The two vocabularies: ids of chunks, and the bytes of every id."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {c: b for b, c in _byte_letters().items()}
        self.a_bytes = {i: bytes(map(byte_of.__getitem__, t)) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.b_bytes = [self._piece_bytes(i) for i in range(self.b.get_piece_size())]
        self.mark = self.b.piece_to_id(MARK)
        self.size = 1 + max(self.a_bytes)

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode()

    def cut_apart(self) -> bool:
        """Whether no token of either vocabulary crosses a cut, and texts are taken as they are but for a mark before them."""
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto.FromString(self.b.serialized_model_proto())
        rule, kind = model.normalizer_spec, model.trainer_spec
        plain = rule.add_dummy_prefix and rule.escape_whitespaces and not rule.remove_extra_whitespaces and not rule.precompiled_charsmap
        own = not any(p.type == p.USER_DEFINED for p in model.pieces) and not kind.treat_whitespace_as_suffix
        inner = any(MARK in p.piece.lstrip(MARK) or "\n" in p.piece for p in model.pieces)
        crossing = any(_CUT.search(b"   " + b) for b in self.a_bytes.values())
        return plain and own and not inner and not crossing

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        # the library puts a mark before what it is given: it stands for a chunk's own first space, or is taken off
        b = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        for i, c in enumerate(chunks):
            if c[0] != " ":
                b[i] = b[i][1:]
            elif c == " ":
                b[i] = [self.mark]
        return a, b


def _byte_letters() -> dict[int, str]:
    """A printable letter for every byte: itself where it is one, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


@dataclass
class Closed:
    """What follows from closed tokens; ``ok`` is false once tokens do not give their bytes back."""

    ok: bool = True
    figures: np.ndarray = field(default_factory=lambda: np.zeros(4, np.int64))
    groups: str = ""
    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __add__(self, other: Closed) -> Closed:
        codes, at = np.unique(np.concatenate([self.codes, other.codes]), return_inverse=True)
        times = np.bincount(at, np.concatenate([self.times, other.times]), len(codes)).astype(np.int64)
        groups = self.groups + ";" * bool(self.groups and other.groups) + other.groups
        return Closed(self.ok and other.ok, self.figures + other.figures, groups, codes, times)


class ChunkTable:
    """Distinct chunks with their figures, groups and links; a link is the code ``b * size + a``."""

    def __init__(self, tokenizers: Tokenizers, table_limit: int = 3_000_000):
        self.of, self.limit = tokenizers, table_limit
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.held = 0
        self.ok: list[bool] = []
        self.groups: list[str] = []
        self.figures = np.zeros((0, 4), np.int64)
        self.start = np.zeros(0, np.int64)
        self.links = np.zeros(0, np.int64)

    def add(self, chunks: list[str]) -> None:
        a_ids, b_ids = self.of.encode(chunks)
        a_bytes, b_bytes = self.of.a_bytes, self.of.b_bytes
        size = np.array([len(c.encode()) for c in chunks], np.int64)
        good = []
        for i, c in enumerate(chunks):
            whole = c.encode()
            good.append(b"".join(map(a_bytes.__getitem__, a_ids[i])) == whole and b"".join(map(b_bytes.__getitem__, b_ids[i])) == whole)
            if not good[i]:
                a_ids[i], b_ids[i], size[i] = [], [], 0
        flat = [np.fromiter((t for ids in every for t in ids), np.int64) for every in (a_ids, b_ids)]
        ends = [np.cumsum(np.fromiter((len(known[t]) for ids in every for t in ids), np.int64)) for every, known in ((a_ids, a_bytes), (b_ids, b_bytes))]
        pieces, common = np.union1d(*ends), np.intersect1d(*ends, assume_unique=True)
        links = flat[1][np.searchsorted(ends[1], pieces)] * self.of.size + flat[0][np.searchsorted(ends[0], pieces)]
        stop = np.cumsum(size)
        upto = [np.searchsorted(x, stop, "right") for x in (ends[0], ends[1], common, pieces)]
        counts = np.stack([np.diff(x, prepend=0) for x in upto], 1)
        said = [list(map(str, x.tolist())) for x in flat]
        to_a, to_b = (np.searchsorted(x, common, "right").tolist() for x in ends)
        every, a, b = [], 0, 0
        for i, j in zip(to_a, to_b, strict=True):
            every.append(",".join(said[0][a:i]) + "|" + ",".join(said[1][b:j]))
            a, b = i, j
        g = 0
        for i, n in enumerate(counts[:, 2].tolist()):
            self.groups.append(";".join(every[g : g + n]))
            g += n
            self.code[chunks[i]] = len(self.ok)
            self.ok.append(good[i])
        self.held += sum(map(len, chunks))
        self.figures = np.concatenate([self.figures, counts])
        self.start = np.concatenate([self.start, len(self.links) + np.cumsum(counts[:, 3]) - counts[:, 3]])
        self.links = np.concatenate([self.links, links])

    def closed(self, texts: list[str]) -> list[Closed]:
        """Each of the texts, cut at both ends."""
        if self.held > self.limit:
            self.clear()
        split = [chunks_of(t) if t else [] for t in texts]
        if new := list(dict.fromkeys(c for s in split for c in s if c not in self.code)):
            self.add(new)
        rows = [list(map(self.code.__getitem__, s)) for s in split]
        sizes = np.array([len(r) for r in rows], np.int64)
        flat = np.fromiter((c for r in rows for c in r), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(rows)), sizes)
        figures = np.zeros((len(rows), 4), np.int64)
        for k in range(4):
            figures[:, k] = np.bincount(owner, self.figures[flat, k], len(rows))
        n = self.figures[flat, 3]
        links = self.links[np.repeat(self.start[flat] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        span = int(links.max()) + 1 if len(links) else 1
        keys, times = np.unique(np.repeat(owner, n) * span + links, return_counts=True)
        at = np.searchsorted(keys // span, np.arange(len(rows) + 1))
        codes, groups, ok = keys % span, self.groups, self.ok
        return [
            Closed(all(ok[c] for c in r), figures[i], ";".join([groups[c] for c in r]), codes[at[i] : at[i + 1]], times[at[i] : at[i + 1]])
            for i, r in enumerate(rows)
        ]


@functools.lru_cache(maxsize=1)
def _table(a_path: str, b_path: str, table_limit: int) -> ChunkTable:
    """The table of a worker, which its tasks share."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ChunkTable(Tokenizers(a_path, b_path), table_limit)


#: An open head, and behind its cut (if there is one) the closed part and the tail.
Fragment = tuple[bytes, Closed | None, bytes]


def fragment(data: bytes, table: ChunkTable) -> Fragment:
    found = cuts(data)
    if not found:
        return data, None, b""
    return data[: found[0]], table.closed([data[found[0] : found[-1]].decode()])[0], data[found[-1] :]


def compose(x: Fragment, y: Fragment, table: ChunkTable) -> Fragment:
    """The fragment of x's bytes followed by y's."""
    (head, left, tail), (front, right, back) = x, y
    if left is not None and right is not None:  # a cut on either side
        return head, left + table.closed([(tail + front).decode()])[0] + right, back
    first, middle, last = fragment((head if left is None else tail) + front, table)
    if left is None and right is None:
        return first, middle, last
    if left is None:
        return (first, right, back) if middle is None else (first, middle + table.closed([last.decode()])[0] + right, back)
    return (head, left, first) if middle is None else (head, left + table.closed([first.decode()])[0] + middle, last)


def finished(x: Fragment, table: ChunkTable) -> Closed:
    """A whole text's fragment, closed at both ends."""
    head, closed, tail = x
    whole = table.closed([head.decode()])[0]
    return whole if closed is None else whole + closed + table.closed([tail.decode()])[0]


_CLOSED = "ok boolean, n_a long, n_b long, n_groups long, n_links long, groups string, codes array<long>, times array<long>"
_ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, times array<long>"
_NO_CLOSED = (None,) * 8


def _row(c: Closed | None) -> tuple:
    return _NO_CLOSED if c is None else (c.ok, *c.figures.tolist(), c.groups, c.codes, c.times)


def _closed(r: tuple) -> Closed | None:
    return None if r[0] is None else Closed(r[0], np.array(r[1:5], np.int64), r[5], np.asarray(r[6], np.int64), np.asarray(r[7], np.int64))


def _lists(parts: list[np.ndarray | None]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([0 if p is None else len(p) for p in parts])])
    flat = [p for p in parts if p is not None and len(p)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64), pa.int64()))


def _columns(rows: list[tuple], schema: str) -> list[pa.Array]:
    made = []
    for i, c in enumerate(schema.split(", ")):
        column, kind = [r[i] for r in rows], c.split()[1]
        made.append(_lists(column) if kind.startswith("array") else pa.array(column, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[kind]))
    return made


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _result(c: Closed) -> tuple:
    """A text's columns; one that is not given back has no tokens."""
    if not c.ok or not c.figures[0]:
        return (0, 0, 0, 0, "", None, None)
    return (*c.figures.tolist(), hashlib.sha256(c.groups.encode()).hexdigest(), c.codes, c.times)


def _whole(docs: DataFrame, keep: list[str], load) -> DataFrame:
    """Texts that are one fragment each."""
    out = T.StructType([*(docs.schema[c] for c in keep), *T.StructType.fromDDL(_ALIGNED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load()
        for rb in batches:
            texts = [" " + t if t else "" for t in rb.column("__text").to_pylist()]
            for a, b in sub_batches(texts, 500_000):
                rows = [_result(c) for c in table.closed(texts[a:b])]
                part = rb.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + _columns(rows, _ALIGNED), names=[*keep, *_names(_ALIGNED)])

    return in_batches(docs).select(*[docs[c] for c in keep], docs["text"].alias("__text")).mapInArrow(run, out)


_PART = f"row long, no long, head binary, {_CLOSED}, tail binary"


def _part(row: int, no: int, x: Fragment) -> tuple:
    return (row, no, x[0], *_row(x[1]), x[2])


def _by_ranges(long: DataFrame, range_bytes: int, fan: int, load, work: Scratch) -> DataFrame:
    """long: row, text. Byte ranges of every text are dealt out, done apart and composed, ``fan`` at a time."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for row, text in zip(rb.column("row").to_pylist(), rb.column("text").to_pylist(), strict=True):
                data = b" " + text.encode()
                for i in range(0, len(data), 16 * range_bytes):
                    some = [data[j : j + range_bytes] for j in range(i, min(len(data), i + 16 * range_bytes), range_bytes)]
                    first = i // range_bytes
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(some), pa.int64()), pa.array(range(first, first + len(some)), pa.int64()), pa.array(some, pa.binary())], names=["row", "no", "data"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load()
        for rb in batches:
            for row, no, data in zip(*(rb.column(c).to_pylist() for c in ("row", "no", "data")), strict=True):
                yield pa.RecordBatch.from_arrays(_columns([_part(row, no, fragment(data, table))], _PART), names=_names(_PART))

    def composed(batches: pa.Table) -> pa.Table:
        table, whole = load(), None
        rows = batches.sort_by("no")
        for r in rows.to_pylist():
            x = r["head"], _closed(tuple(r[c] for c in _names(_CLOSED))), r["tail"]
            whole = x if whole is None else compose(whole, x, table)
        return pa.Table.from_arrays(_columns([_part(rows["row"][0].as_py(), rows["no"][0].as_py() // fan, whole)], _PART), names=_names(_PART))

    n = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = in_batches(long).mapInArrow(ranges, "row long, no long, data binary").repartition(n, "row", "no")
    found = work.keep(dealt.mapInArrow(parts, _PART), "ranges")
    most = found.agg(F.max("no")).first()[0] or 0
    while most > 0:
        found = work.keep(found.groupBy("row", F.floor(F.col("no") / fan)).applyInArrow(composed, _PART), "composed")
        most //= fan

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load()
        for rb in batches:
            for r in rb.to_pylist():
                x = r["head"], _closed(tuple(r[c] for c in _names(_CLOSED))), r["tail"]
                row = _result(finished(x, table))
                yield pa.RecordBatch.from_arrays([pa.array([r["row"]], pa.int64()), *_columns([row], _ALIGNED)], names=["row", *_names(_ALIGNED)])

    return found.mapInArrow(ended, f"row long, {_ALIGNED}")


def _best_by_table(aligned: DataFrame, counts: DataFrame, keep: list[str]) -> DataFrame:
    """n_best and count_sum from a table of all counts, which every task gets."""
    spark = aligned.sparkSession
    held = counts.toArrow().sort_by("code")
    sent = spark.sparkContext.broadcast(tuple(held[c].to_numpy(zero_copy_only=False) for c in ("code", "n", "best")))
    more = ("n_best", "count_sum")
    out = T.StructType([*(aligned.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, best = sent.value
        for rb in batches:
            lists, times = rb.column("codes"), rb.column("times").flatten().to_numpy(zero_copy_only=False)
            at = np.searchsorted(code, lists.flatten().to_numpy(zero_copy_only=False))
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            made = []
            for values in (times * best[at], times * n[at]):
                upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
                made.append(pa.array(upto[ends] - upto[ends - sizes], pa.int64()))
            yield pa.RecordBatch.from_arrays([rb.column(c) for c in keep] + made, names=[*keep, *more])

    return in_batches(aligned).mapInArrow(run, out)


def _best_by_join(aligned: DataFrame, counts: DataFrame, keep: list[str]) -> DataFrame:
    """The same by a join of all links to their counts."""
    links = aligned.select("__row", F.inline(F.arrays_zip("codes", "times")))
    sums = links.join(counts, F.col("codes") == F.col("code")).groupBy("__row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    joined = aligned.drop("codes", "times").join(sums, "__row", "left")
    return joined.select(*keep, F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"))


def align(docs: DataFrame, a_path: str, b_path: str, work: Scratch, *, keep: list[str] | None = None, long_chars: int = 1 << 16, range_bytes: int = 1 << 15, fan: int = 8, broadcast_pairs: int = 3_000_000, table_limit: int = 3_000_000) -> DataFrame:
    """docs: text. Adds n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 to the columns of ``keep``.

    Texts of more than ``long_chars`` characters are done by ranges of ``range_bytes`` bytes."""
    more = [*FIGURES, "n_best", "count_sum", "groups_sha256"]
    own = without(keep if keep is not None else [c for c in docs.columns if c != "text"], tuple(more))
    tokenizers = Tokenizers(a_path, b_path)
    if not tokenizers.cut_apart():
        raise ValueError("tokens of these vocabularies may cross spaces; their texts cannot be cut into chunks")
    load = functools.partial(_table, a_path, b_path, table_limit)
    # names of the input cannot clash with those used on the way
    docs = docs.select(*[docs[c].alias(f"__in{i}") for i, c in enumerate(own)], "text")
    inner = [f"__in{i}" for i in range(len(own))]
    is_long = F.length("text") > long_chars
    short = _whole(docs.where(~F.coalesce(is_long, F.lit(False))), inner, load)
    long = work.keep(docs.where(is_long).withColumn("row", F.monotonically_increasing_id()), "long")
    done = _by_ranges(long.select("row", "text"), range_bytes, fan, load, work)
    aligned = work.keep(short.unionByName(long.drop("text").join(done, "row").drop("row")), "aligned")
    links = aligned.select(F.inline(F.arrays_zip("codes", "times")))
    counts = work.keep(links.groupBy(F.col("codes").alias("code")).agg(F.sum("times").alias("n")), "pairs")
    target = F.floor(F.col("code") / tokenizers.size)
    most = counts.groupBy(target.alias("b")).agg(F.max("n").alias("most"))
    counts = work.keep(counts.join(most, target == F.col("b")).select("code", "n", (F.col("n") == F.col("most")).alias("best")), "counts")
    figures = [*inner, *FIGURES, "groups_sha256"]
    if counts.count() <= broadcast_pairs:
        found = _best_by_table(aligned, counts, figures)
    else:
        aligned = work.keep(aligned.withColumn("__row", F.monotonically_increasing_id()), "rows")
        found = _best_by_join(aligned, counts, figures)
    return work.release(found.select(*[F.col(f"__in{i}").alias(c) for i, c in enumerate(own)], *more))
