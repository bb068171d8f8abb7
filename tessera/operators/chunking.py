"""Chunks of documents, and their ids."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import stored

SEPARATORS = ("\n\n", "\n", " ")


def pieces(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Parts of at most ``size`` characters, cut after the first separator that helps; together the text."""
    if len(text) <= size:
        return [text] if text else []
    if not separators:
        return [text[i : i + size] for i in range(0, len(text), size)]
    first, rest = separators[0], separators[1:]
    parts = text.split(first)
    return [p for i, x in enumerate(parts) for p in pieces(x + (first if i < len(parts) - 1 else ""), size, rest)]


def chunks_of(text: str, size: int, overlap: int) -> list[str]:
    """Consecutive chunks of at most ``size``; each begins with up to ``overlap`` characters of the one before, at a part's start."""
    out: list[str] = []
    held: list[str] = []
    length = fresh = 0
    for p in pieces(text, size):
        if length + len(p) > size and fresh:
            out.append("".join(held))
            while held and (length > overlap or length + len(p) > size):
                length -= len(held.pop(0))
            fresh = 0
        held.append(p)
        length += len(p)
        fresh += len(p)
    if fresh:
        out.append("".join(held))
    return out


def split(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """docs: doc_id, text. (doc_id, pos, text), without a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, i, c) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for i, c in enumerate(chunks_of(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "pos", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, pos int, text string")


def split_fixed(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Chunks of fixed width, as expressions."""
    last = F.greatest(F.lit(0), F.ceil((F.length("text") - overlap) / F.lit(size - overlap)).cast("int") - 1)
    rows = docs.where(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("pos"))
    return rows.select("doc_id", "pos", F.substring("text", F.col("pos") * (size - overlap) + 1, F.lit(size)).alias("text"))


def number(chunks: DataFrame, start: int = 0, order: list[str] | None = None) -> DataFrame:
    """Consecutive chunk ids in order, from ``start``: counts of range partitions first, then
    numbers within a partition, so no window spans the table. chunks: doc_id, pos, ..."""
    order = order or ["doc_id", "pos"]
    dealt = chunks.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    dealt = dealt.withColumn("__p", F.shiftright("__m", 33)).withColumn("__i", F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)))
    dealt = stored(dealt, "dealt")  # partition numbers must be the same in both uses
    counts = dealt.groupBy("__p").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row a partition
    return dealt.join(F.broadcast(counts.select("__p", before.alias("__b"))), "__p").withColumn("chunk_id", F.col("__b") + F.col("__i") + start).drop("__m", "__p", "__i", "__b")
