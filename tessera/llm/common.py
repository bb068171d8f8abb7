"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import Scratch as Scratch
from tessera.runtime import discarding_results as discarding_results
from tessera.runtime import materialize as materialize

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(modulus: int, col: str = "doc_id"):
    """crc32(doc_id as text) mod modulus; null ids get null."""
    return F.pmod(F.crc32(F.col(col).cast("string")), F.lit(modulus))


def sample_share(df: DataFrame, want: int, key: str, seed: int = 17) -> DataFrame:
    """About ``want`` ids of df, chosen by a hash of ``key``, a row each (the least of several), all if there are
    fewer. ``__order`` sorts them for a ``limit`` that makes the bound exact.

    Ids are counted by a sketch over all rows; the choice is made row by row and copies of a
    chosen id are combined before they are shuffled, so no task holds more than its own rows."""
    total = df.agg(F.approx_count_distinct(key, 0.02)).first()[0]
    grain = 1 << 30
    keep = grain if total <= want else int(grain * want / total)
    order = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(grain))
    others = [c for c in df.columns if c != key]
    rows = df.where(order < keep).groupBy(key).agg(F.min(F.struct(*others)).alias("__least"))
    return rows.select(key, "__least.*", order.alias("__order"))


#: Bytes in a batch between the JVM and a Python worker; either side holds a few of them at a time.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_batches(df: DataFrame) -> DataFrame:
    """df, for a Python function over long texts: Arrow batches end at BATCH_BYTES (or after one row), not only
    at a number of rows, so that memory does not depend on how long texts are. A bound that the session sets is
    kept; where there is none, this one holds for the session from here on."""
    conf = df.sparkSession.conf
    if _BATCH not in conf.getAll:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def without(columns: list[str], added: tuple[str, ...]) -> list[str]:
    """The columns that an operator hands on: one of a name that it adds is replaced."""
    return [c for c in columns if c not in added]


def sub_batches(texts: list, limit: int = 1_000_000):
    """Slices (start, end) of texts, each of at most ``limit`` characters or of one text."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def byte_buffer(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes in one array, and the offsets of each text in it."""
    parts = [t.encode("utf-8", "replace") for t in texts]
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return np.frombuffer(b"".join(parts), np.uint8), offsets


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
