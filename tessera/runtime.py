"""Session helpers: the package on executors, and tables in the folder that all of them share."""

from __future__ import annotations

import itertools
import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Executor, Future
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once an application, for jobs with Python functions."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary one if driver and tasks are one
    process, as in tests; on a cluster an error, since executors would each write to their own disk."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-"))
    return f"file://{_own_dir[0]}"


#: Spark then removes a query's shuffle files when the query ends, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
#: Session -> (writes under way, the setting before the first of them).
_writing: dict[int, tuple[int, str | None]] = {}


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """Sets _CLEANUP while any write of the session is under way, whatever threads they run in."""
    with _lock:
        count, before = _writing.get(id(spark), (0, spark.conf.get(_CLEANUP, None)))
        _writing[id(spark)] = count + 1, before
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            count, before = _writing.pop(id(spark))
            if count > 1:
                _writing[id(spark)] = count - 1, before
            elif before is None:
                spark.conf.unset(_CLEANUP)
            else:
                spark.conf.set(_CLEANUP, before)


def write(df: DataFrame, path: str, mode: str = "error", by: list[str] | None = None) -> None:
    """df as files; the shuffle files that it took are gone afterwards."""
    with _cleaning(df.sparkSession):
        df.write.mode(mode).option("compression", "zstd").parquet(path, partitionBy=by)


def _write(df: DataFrame, path: str) -> DataFrame:
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(rows: int, each: int = 1_000_000, most: int = 16) -> int:
    """Into how many slices to cut a job over so many rows, so that its shuffle files never lie on disk all at once."""
    return max(1, min(most, rows // each))


def in_slice(keys: list[str], number: int, count: int) -> Column:
    """Whether a row is in a slice; rows of the same keys are in the same one."""
    return F.lit(True) if count == 1 else F.pmod(F.xxhash64(*keys), F.lit(count)) == number


def _at(spark: SparkSession, path: str):
    """A path and its file system, wherever it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def delete(spark: SparkSession, path: str) -> None:
    at, files = _at(spark, path)
    files.delete(at, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    at, files = _at(spark, path)
    return [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []


def write_once(spark: SparkSession, path: str) -> None:
    """An empty file; an error if there is one already."""
    at, files = _at(spark, path)
    files.create(at, False).close()


#: Paths of tables that operators' results still read, for the innermost discarding_results of this thread.
_results: ContextVar[list[str] | None] = ContextVar("results", default=None)


def _result(path: str) -> str:
    if (held := _results.get()) is not None:
        held.append(path)
    return path


@contextmanager
def discarding_results(spark: SparkSession) -> Iterator[None]:
    """Deletes, on leaving, what operators called inside (by this thread) have written for their results, and the
    paths that ``scratch`` gave: these must be read by then. Other threads' results stay."""
    held: list[str] = []
    token = _results.set(held)
    try:
        yield
    finally:
        _results.reset(token)
        for path in held:
            delete(spark, path)


def submit(pool: Executor, job: Callable[[], DataFrame]) -> Future[DataFrame]:
    """job() in a thread of the pool, for tables that do not wait for each other. What it writes as results belongs
    to the ``discarding_results`` of the thread that asks for it."""
    return pool.submit(copy_context().run, job)


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut, and the files outlive executors.

    The table is a result: it stays until ``discarding_results`` or the owner of the folder deletes it."""
    return _write(df, _result(f"{shared_dir(df.sparkSession)}/tessera-{uuid.uuid4().hex}/{name}"))


class Scratch:
    """Tables of one run in the shared folder. Each may be dropped once no later step reads it; on leaving
    the ``with`` block, by its end or by an error, all others go but the one released as the result."""

    def __init__(self, spark: SparkSession):
        self._spark, self._root, self._numbers = spark, f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}", itertools.count(1)
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.drop(*[t for t, _ in self._paths.values()])

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self._root}/{name}-{next(self._numbers)}"
        out = _write(df, path)
        self._paths[id(out)] = (out, path)
        return out

    def gather(self, parts: Iterable[DataFrame], name: str) -> DataFrame:
        """The rows of all parts as one table. They are written one after another, so that on disk there are
        never more than the shuffle files of one of them."""
        path, schema = f"{self._root}/{name}-{next(self._numbers)}", None
        for part in parts:
            write(part, path, "append")
            schema = part.schema
        out = self._spark.read.schema(schema).parquet(path)
        self._paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables of keep(); what is still to be computed must not read them."""
        for t in tables:
            delete(self._spark, self._paths.pop(id(t))[1])

    def release(self, df: DataFrame, name: str = "result") -> DataFrame:
        """df as a table that outlives the run; written now unless it is one already."""
        out = df if id(df) in self._paths else self.keep(df, name)
        _result(self._paths.pop(id(out))[1])
        return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which ``discarding_results`` or the owner of the folder deletes."""
    return _result(f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}/{name}")


#: df written to the shared folder and read back, which cuts its lineage.
stored = materialize
