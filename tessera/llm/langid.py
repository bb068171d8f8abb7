"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is lower-cased and reduced to its letters with one space between words. Its byte
n-grams of 2 to 4 bytes (a space only as first or last byte, so they stay within a word and
mark its ends) are hashed into ``buckets`` rows of an embedding table; the rows' mean goes
through a linear softmax. Both tables are trained by mini-batch gradient descent in numpy.
A held-back part of the sample sets the softmax temperature and the score under which a
prediction is rejected: ``reject_share`` of that part, and never more than a score of 0.5.

The model is fitted on a bounded sample (``sample_docs`` documents, chosen by a hash of
their id from all labelled ones; an id met more than once counts once); prediction reads
every whole text, in slices of bounded size. Null texts and texts without a letter (Unicode
category L) give ``und``, score 0, rejected. With nothing to learn from, everything is
``und``. Repeated rows and rows with null ids are predicted alike; of equal probabilities the
first language in code point order is predicted; an empty table gives no rows; columns of
the input named like those added are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import byte_buffer, in_batches, sample_share, sub_batches, without

_NOT_LETTERS = re.compile(r"[\W\d_]+")
SIZES = (2, 3, 4)
UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    embedding: np.ndarray
    softmax: np.ndarray
    temperature: float
    reject_below: float


def letters(text: str | None) -> str:
    return _NOT_LETTERS.sub(" ", f" {text.lower()} ") if text else " "


def subwords(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all n-grams of the texts, and each text's bounds in them (per n one run)."""
    buf, off = byte_buffer(texts)
    space = buf == 32
    ids, bounds = [], []
    for n in SIZES:
        m = len(buf) - n + 1
        if m <= 0:
            ids.append(np.zeros(0, np.int64))
            bounds.append(np.zeros(len(off), np.int64))
            continue
        h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for i in range(n):
            h = (h ^ buf[i : m + i]) * np.uint32(16777619)
        h ^= h >> np.uint32(15)
        ok = np.ones(m, bool)
        for i in range(1, n - 1):
            ok &= ~space[i : m + i]
        if n == 2:
            ok &= ~(space[:m] & space[1 : m + 1])
        for e in off[1:-1]:  # n-grams that run from one text into the next
            ok[max(0, e - n + 1) : e] = False
        ids.append((h[ok] & np.uint32(buckets - 1)).astype(np.int64))
        seen = np.concatenate([[0], np.cumsum(ok)])
        bounds.append(seen[np.minimum(off, m)])
    return ids, bounds


def mean_rows(table: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each text the mean of its n-grams' rows of table, and the number of n-grams."""
    total, count = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), np.int64)
    columns = [np.ascontiguousarray(table[:, c]) for c in range(table.shape[1])]
    for ids, bound in zip(*subwords(texts, len(table)), strict=True):
        for c, col in enumerate(columns):
            run = np.concatenate([[0.0], np.cumsum(col[ids], dtype=np.float64)])
            total[:, c] += run[bound[1:]] - run[bound[:-1]]
        count += np.diff(bound)
    return total / np.maximum(count, 1)[:, None], count


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], buckets: int, dim: int, epochs: int, rate: float, reject_share: float, seed: int = 7) -> Model | None:
    """rows: language, buckets, their weights (summing to 1)."""
    rows = [r for r in rows if len(r[1])]
    langs = sorted({r[0] for r in rows})
    if not rows:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    cut = len(rows) // 5 if len(rows) >= 50 else 0
    held, own = order[:cut], order[cut:]
    label = np.array([langs.index(r[0]) for r in rows])
    emb = rng.normal(0, 1 / dim, (buckets, dim))
    w = rng.normal(0, 1 / np.sqrt(dim), (dim, len(langs)))
    share = np.bincount(label, minlength=len(langs)) / len(rows)
    weight = 1 / np.maximum(share * len(langs), 0.05)  # rare languages count alike

    def hidden(which):
        idx, val = np.concatenate([rows[i][1] for i in which]), np.concatenate([rows[i][2] for i in which]).astype(float)
        at = np.cumsum([0] + [len(rows[i][1]) for i in which[:-1]])
        return idx, val, at, np.add.reduceat(emb[idx] * val[:, None], at, axis=0)

    steps, done, size = epochs * max(1, len(own) // 16), 0, 16
    for _ in range(epochs):
        for k in range(0, len(own), size):
            which = own[k : k + size] if len(own) > k else own
            idx, val, _, h = hidden(which)
            p = softmax(h @ w)
            p[np.arange(len(which)), label[which]] -= 1
            p *= weight[label[which]][:, None] / len(which)
            lr = rate * max(0.05, 1 - done / steps)
            back = p @ w.T
            w -= lr * (h.T @ p)
            of = np.repeat(np.arange(len(which)), [len(rows[i][1]) for i in which])
            np.add.at(emb, idx, -lr * len(which) * val[:, None] * back[of])
            done += 1
    temperature, floor = 1.0, 0.0
    if len(held):
        # in slices, as in training: a row for every n-gram of all held-back texts would fill the driver
        logits, y = np.concatenate([hidden(held[k : k + size])[3] for k in range(0, len(held), size)]) @ w, label[held]
        grid = np.geomspace(0.05, 5, 40)
        loss = [-np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
        floor = float(min(0.5, np.quantile(softmax(logits / temperature).max(1), reject_share)))
    return Model(langs, emb, w, temperature, floor)


def packed(idx: np.ndarray, count: np.ndarray) -> bytes:
    """Ascending bucket numbers and how often each occurs, small enough for a sample of them to go to the driver."""
    return zlib.compress(np.concatenate([np.diff(idx, prepend=0), count]).astype("<u4").tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bucket numbers and their weights (summing to 1) of packed()."""
    step, count = np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64).reshape(2, -1)
    return np.cumsum(step).astype(np.int32), (count / max(1, int(count.sum()))).astype(np.float32)


def _compared(a: tuple[str, np.ndarray, np.ndarray], b: tuple[str, np.ndarray, np.ndarray]) -> int:
    """Order of two samples; their bytes are made only while they are compared."""
    if a[0] != b[0]:
        return -1 if a[0] < b[0] else 1
    for x, y in zip(a[1:], b[1:], strict=True):
        p, q = (v.tobytes() if v.dtype == np.int32 else v.astype(float).tobytes() for v in (x, y))
        if p != q:
            return -1 if p < q else 1
    return 0


def fit(
    docs: DataFrame, usable: Column, *, sample_docs: int = 2000, buckets: int = 1 << 15, dim: int = 16, epochs: int = 8, rate: float = 2.0, reject_share: float = 0.001
) -> Model | None:
    """Learns from text and lang of the ``usable`` rows with non-null lang and text."""
    own = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    chosen = sample_share(own.select("doc_id", "lang", "text"), sample_docs, "doc_id").select("lang", "text", "__order")
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            found = [packed(*np.unique(np.concatenate(subwords([letters(t)], buckets)[0]), return_counts=True)) for t in rb.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(found, pa.binary()), rb.column(2)], names=["lang", "found", "__order"])

    got = in_batches(chosen).mapInArrow(features, "lang string, found binary, __order long").orderBy("__order", "lang").limit(sample_docs).toArrow()
    rows = [(a, *unpacked(x.as_py())) for a, x in zip(got["lang"].to_pylist(), got["found"], strict=True)]
    rows.sort(key=cmp_to_key(_compared))
    return train(rows, buckets, dim, epochs, rate, reject_share)


def predict(docs: DataFrame, model: Model | None, *, keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, score (calibrated probability of it) and rejected to the columns of ``keep``."""
    added = ("lang_pred", "score", "rejected")
    keep = without(keep if keep is not None else docs.columns, added)
    names = [f"k{i}" for i in range(len(keep))]
    own = [T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, keep, strict=True)]
    out = T.StructType(own + [T.StructField(c, t) for c, t in zip(added, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if m is not None:
            direct = m.embedding.shape[1] >= len(m.langs)
            lookup = (m.embedding @ m.softmax if direct else m.embedding).astype(np.float32)
        for rb in batches:
            texts = rb.column("__text").to_pylist()
            for a, b in sub_batches(texts):
                clean = [letters(t) for t in texts[a:b]]
                some = np.array([any(map(str.isalpha, c)) for c in clean])  # the first character tells, as a rule
                lang, score = np.array([UNKNOWN] * (b - a), object), np.zeros(b - a)
                if m is not None:
                    mean, _ = mean_rows(lookup, clean)
                    p = softmax((mean if direct else mean @ m.softmax) / m.temperature)
                    lang[some], score[some] = np.array(m.langs, object)[p.argmax(1)][some], np.clip(p.max(1), 0, 1)[some]
                low = ~some | (score < (m.reject_below if m else 0))
                part = rb.slice(a, b - a)
                made = [pa.array(lang, pa.string()), pa.array(score), pa.array(low)]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + made, names=[*names, *added])

    found = in_batches(docs).select(*[docs[c].alias(n) for n, c in zip(names, keep, strict=True)], docs["text"].alias("__text")).mapInArrow(run, out)
    return found.toDF(*keep, *added)
