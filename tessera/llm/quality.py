"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every whole text is turned into a short vector of statistics (lengths, character classes,
repetition of words, word pairs and lines, compressibility). Complete binary trees of fixed
depth are grown level by level on histograms of quantile bins for the logistic loss; the
ensemble is flattened into three arrays (feature, threshold, leaf value), and scoring walks
all trees of a batch at once with numpy gathers.

The model is fitted on a bounded sample (``sample_docs`` labelled rows, chosen by a hash of
their id); scoring covers all rows and whole texts of any length. Null and empty texts get
the statistics of an empty text and so a score like any other. Labels that are null are
skipped; an id with several labels counts once with their maximum, one with several texts
with the least. With nothing to learn from, every score is 0.5. Of equally good splits the
first statistic and least threshold is taken; repeated rows are scored alike; an empty table
gives no rows; a column of the input named ``score`` is replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import in_batches, sample_share, without

_UPPER, _DIGIT, _OTHER = re.compile(r"[^\W\d_a-zß-öø-ÿ]"), re.compile(r"\d"), re.compile(r"[^\w\s]|_")


@dataclass
class Trees:
    depth: int
    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes
    leaf: np.ndarray  # trees x leaves


def statistics(text: str | None) -> list[float]:
    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [np.log1p(chars), 0.0] + [0.0] * 18
    count, length = Counter(words), [len(w) for w in words]
    lines = [x for x in text.split("\n") if x.strip()]
    raw = text.encode("utf-8", "replace")
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:]))) / max(1, n - 1)
    line_count = Counter(lines)
    ends = Counter(w[-1] for w in words)
    return [
        np.log1p(chars), np.log1p(n), sum(length) / n, max(length), len(count) / n, max(count.values()) / n, repeats / n, pairs,
        sum(1 for _ in _UPPER.finditer(text)) / chars, len(_DIGIT.findall(text)) / chars, len(_OTHER.findall(text)) / chars,
        np.log1p(len(lines)), 1 - len(line_count) / len(lines), n / len(lines), sum(x <= 3 for x in length) / n,
        sum(w[0].isupper() for w in words) / n, sum(not w[0].isalnum() and len(w) == 1 for w in words) / n,
        (ends["."] + ends["!"] + ends["?"]) / n, sum(v for k, v in ends.items() if not k.isalnum() and k not in ".,") / n,
        len(zlib.compress(raw, 1)) / len(raw),
    ]


def train(x: np.ndarray, y: np.ndarray, *, trees: int, depth: int, bins: int, rate: float, l2: float, least: int = 8) -> Trees:
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)  # bin b: x <= edges[b]
    flat = binned + np.arange(width) * bins
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    raw = np.full(n, np.log(mean / (1 - mean)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    base = float(raw[0])
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            wide, first = 1 << level, (1 << level) - 1
            at = ((node[:, None] * width * bins) + flat).ravel()
            shape = (wide, width, bins)
            hist = [np.bincount(at, np.repeat(v, width), wide * width * bins).reshape(shape).cumsum(2) for v in (g, h, np.ones(n))]
            total = [v[:, :, -1:] for v in hist]
            gain = hist[0] ** 2 / (hist[1] + l2) + (total[0] - hist[0]) ** 2 / (total[1] - hist[1] + l2) - total[0] ** 2 / (total[1] + l2)
            gain[(hist[2] < least) | (total[2] - hist[2] < least)] = 0
            gain[:, :, -1] = 0
            best = gain.reshape(wide, -1).argmax(1)
            f, b = best // bins, best % bins
            for k in range(wide):
                feature[t, first + k] = f[k]
                if gain[k, f[k], b[k]] > 1e-9 and b[k] < len(edges[f[k]]):
                    threshold[t, first + k] = edges[f[k]][b[k]]
            node = node * 2 + (x[np.arange(n), f[node]] > threshold[t, first + node])
        gs, hs = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        leaf[t] = -rate * gs / (hs + l2)
        raw += leaf[t][node]
    return Trees(depth, base, feature, threshold, leaf)


def score(model: Trees | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    count = len(model.feature)
    node, tree, row = np.zeros((len(x), count), np.int64), np.arange(count), np.arange(len(x))[:, None]
    for level in range(model.depth):
        at = node + ((1 << level) - 1)
        node = node * 2 + (x[row, model.feature[tree, at]] > model.threshold[tree, at])
    return 1 / (1 + np.exp(-(model.base + model.leaf[tree, node].sum(1))))


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column, *, sample_docs: int = 12_000, trees: int = 60, depth: int = 4, bins: int = 48, rate: float = 0.2, l2: float = 2.0
) -> Trees | None:
    """labels: doc_id, quality (0 or 1). ``usable`` is a condition on doc_id."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("__y"))
    known = known.where(usable).groupBy("doc_id").agg(F.max("__y").alias("__y"))
    chosen = sample_share(known, sample_docs, "doc_id").orderBy("__order", "doc_id").limit(sample_docs).drop("__order")
    # bounded by sample_docs, so its ids may be sent to every task
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    own = own.groupBy("doc_id").agg(F.min(F.struct("__y", "text")).alias("r")).select("r.*")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            x = [statistics(t) for t in rb.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    got = in_batches(own).mapInArrow(features, "y int, x array<double>").toArrow()
    if not got.num_rows:
        return None
    y, x = np.asarray(got["y"].to_numpy(), float), got["x"].combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
    order = np.lexsort([*x.T, y])  # the order rows arrive in must not matter
    return train(x[order], y[order], trees=trees, depth=depth, bins=bins, rate=rate, l2=l2)


def predict(docs: DataFrame, model: Trees | None, *, keep: list[str] | None = None) -> DataFrame:
    """Adds score (0 to 1) to the columns of ``keep``."""
    keep = without(keep if keep is not None else docs.columns, ("score",))
    names = [f"k{i}" for i in range(len(keep))]
    own = [T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, keep, strict=True)]
    out = T.StructType([*own, T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            x = np.array([statistics(t) for t in rb.column("__text").to_pylist()], float).reshape(rb.num_rows, -1)
            s = score(shared.value, x) if rb.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([rb.column(n) for n in names] + [pa.array(s)], names=[*names, "score"])

    rows = docs.select(*[docs[c].alias(n) for n, c in zip(names, keep, strict=True)], docs["text"].alias("__text"))
    return in_batches(rows).mapInArrow(run, out).toDF(*keep, "score")
