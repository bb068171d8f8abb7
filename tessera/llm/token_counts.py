"""Edit-aware token counts: a segment tree over each document's pre-tokens.

A byte-level vocabulary splits a text by a pattern into pre-tokens and encodes each alone,
so a document's count is a sum over its pre-tokens. The tree keeps pre-tokens in leaves of
up to ``LEAF`` pieces and, above them, the characters and tokens of every subtree. An edit
finds its leaf by descending on characters, splits again only from the last boundary that
the edit cannot reach back over until a boundary of the old splitting is met again past the
edit, re-encodes those pre-tokens, and updates the sums on the paths above the leaves it
touched. The pattern looks at most ``CONTEXT`` characters past a pre-token's end.

Distinct pre-tokens are encoded once a task (a bounded table). Null texts count as empty;
null edits are passed over and edits out of range are clipped to the text; texts of any
length are read whole; repeated rows give repeated results; an empty table gives none;
columns of the input named like those added are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import in_batches, without

LEAF = 32
CONTEXT = 4


def load_encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Counter:
    """Tokens of a pre-token, remembered for up to ``limit`` distinct ones."""

    def __init__(self, path: str, pattern: str, limit: int = 500_000):
        self.encoding, self.split, self.limit = load_encoding(path, pattern), regex.compile(pattern), limit
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        if new := {p for p in pieces if p not in known}:
            if len(known) > self.limit:
                known.clear()
                new = set(pieces)
            for p in new:
                known[p] = len(self.encoding.encode_ordinary(p))
        return [known[p] for p in pieces]


class CountTree:
    """Pre-tokens of one text in leaves, with the sums of characters and tokens of every subtree."""

    def __init__(self, text: str, counter: Counter):
        self.counter = counter
        pieces = counter.split.findall(text)
        counts = counter.counts(pieces)
        self.leaves = [(pieces[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(pieces), LEAF)] or [([], [])]
        self.re_encoded = 0
        self._build()

    def _build(self) -> None:
        self.width = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.leaves += [([], []) for _ in range(self.width - len(self.leaves))]
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (p, c) in enumerate(self.leaves):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(map(len, p)), sum(c)
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one if at is the end), and the leaf's first character."""
        i, before = 1, 0
        while i < self.width:
            i *= 2
            if at >= before + self.chars[i] and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        return i - self.width, before

    def _set(self, leaf: int, pieces: list[str], counts: list[int]) -> None:
        self.leaves[leaf] = (pieces, counts)
        i = self.width + leaf
        self.chars[i], self.tokens[i] = sum(map(len, pieces)), sum(counts)
        while i > 1:
            i //= 2
            self._sum(i)

    def edit(self, at: int, removed: int, added: str) -> None:
        """Replaces ``removed`` characters from ``at`` on by ``added``."""
        size = self.chars[1]
        at = min(max(0, at), size)
        end = min(size, at + max(0, removed))
        first, start = self.find(max(0, at - CONTEXT))
        # boundaries before the edit hold where the pattern cannot see the edit
        keep, where = 0, start
        for p in self.leaves[first][0]:
            if where + len(p) + CONTEXT > at:
                break
            where += len(p)
            keep += 1
        head = list(self.leaves[first][0][:keep])
        head_counts = list(self.leaves[first][1][:keep])
        old = list(self.leaves[first][0][keep:])
        text, last, new = "".join(old), first, []
        shift, scanned, reach = len(added) - (end - at), where, where + len(text)
        while True:
            while reach < size and reach < end + CONTEXT:
                last += 1
                old += self.leaves[last][0]
                text = text + "".join(self.leaves[last][0])
                reach = where + len(text)
            bounds, p = {}, where
            for k, piece in enumerate(old):
                bounds.setdefault(p, k)
                p += len(piece)
            bounds[p] = len(old)
            edited = text[: at - where] + added + text[end - where :]
            new, pos, resumed = [], 0, None
            for m in self.counter.split.finditer(edited):
                # what ends near the end of the region may depend on text beyond it
                if reach < size and m.end() + CONTEXT > len(edited):
                    break
                new.append(m[0])
                pos = m.end()
                back = where + pos - shift
                if back >= end and pos >= at - where + len(added) and back in bounds:
                    resumed = bounds[back]
                    break
            if resumed is not None or reach >= size:
                break
            last += 1
            old += self.leaves[last][0]
            text += "".join(self.leaves[last][0])
            reach = where + len(text)
        rest = old[resumed:] if resumed is not None else []
        known = dict(zip(rest, self.counter.counts(rest), strict=True)) if rest else {}
        self.re_encoded += len(new)
        pieces = head + new + rest
        counts = head_counts + self.counter.counts(new) + [known[p] for p in rest]
        slots = last - first + 1
        each = -(-len(pieces) // slots) if pieces else 0
        if each > 4 * LEAF:  # too full: deal everything out again
            everything = [x for leaf in (*self.leaves[:first], (pieces, counts), *self.leaves[last + 1 :]) for x in zip(*leaf, strict=True)]
            self.leaves = [([p for p, _ in everything[i : i + LEAF]], [c for _, c in everything[i : i + LEAF]]) for i in range(0, len(everything), LEAF)]
            self._build()
            return
        for k in range(slots):
            self._set(first + k, pieces[k * each : (k + 1) * each], counts[k * each : (k + 1) * each])


def count_edits(docs: DataFrame, vocabulary: str, pattern: str, *, keep: list[str] | None = None) -> DataFrame:
    """docs: text, edits array<struct<at int, removed int, added string>> applied in order.

    Adds n_tokens, n_tokens_edited, n_pre_tokens (of the text) and n_re_encoded (pre-tokens
    encoded again for all edits) to the columns of ``keep``."""
    more = ("n_tokens", "n_tokens_edited", "n_pre_tokens", "n_re_encoded")
    keep = without(keep if keep is not None else [c for c in docs.columns if c not in ("text", "edits")], more)
    out = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary, pattern)
        for rb in batches:
            rows = []
            for text, edits in zip(rb.column("__text").to_pylist(), rb.column("__edits").to_pylist(), strict=True):
                tree = CountTree(text or "", counter)
                before, pieces = tree.total, sum(len(p) for p, _ in tree.leaves)
                for e in edits or []:
                    if e is not None:
                        tree.edit(e["at"] or 0, e["removed"] or 0, e["added"] or "")
                rows.append((before, tree.total, pieces, tree.re_encoded))
            made = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([rb.column(c) for c in keep] + made, names=[*keep, *more])

    return in_batches(docs).select(*[docs[c] for c in keep], docs["text"].alias("__text"), docs["edits"].alias("__edits")).mapInArrow(run, out)
