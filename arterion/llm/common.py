"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that count as blank: space and \x09-\x0D, which is also what bytes.split() and bytes.strip() take.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column = "text") -> Column:
    """The text, a null as an empty one."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
    found = tempfile.mkdtemp(prefix="arterion-")
    spark.sparkContext.setCheckpointDir(found)
    return found


#: What this worker process keeps from task to task, by what it was made of.
_KEPT: dict[Hashable, object] = {}


def kept(made_of: Hashable, make: Callable[[], object]) -> object:
    """``make()``, kept by the worker for as long as its tasks are those of tidied(..., keeps=True)."""
    if made_of not in _KEPT:
        _KEPT.clear()  # one thing at a time
        _KEPT[made_of] = make()
    return _KEPT[made_of]


def _trim() -> None:
    """Gives back to the system what the pools of this process have free."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def let_go() -> None:
    """Drops what kept() holds.  By a name of this module, as a function that is sent to a worker has globals of its own."""
    if _KEPT:
        _KEPT.clear()
        _trim()


def tidied(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` for mapInArrow(), giving memory back at the end of each task: workers live on between tasks, and what
    their pools keep of one stage would be missing in the next.  What kept() holds goes as well when a task begins
    that doesn't use it (``keeps``): the same workers serve all operators of a session."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            let_go()
        try:
            yield from work(batches)
        finally:
            _trim()

    return run


#: Settings under which intermediate tables are written: a query's shuffle files go as soon as it ends, not when the
#: driver next collects its garbage; and batches for Python are bounded in bytes, as texts may be of any length.
_LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """The session's settings with those of _LEAN, for as long as this lasts."""
    before = {k: spark.conf.get(k, None) for k in _LEAN}
    for k, v in _LEAN.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def trim_driver(spark: SparkSession) -> str:
    """Has the driver's JVM give back to the system what its native pools have free, as jcmd's System.trim_native_heap
    does; its answer, empty if this JVM has no such command.  By reflection, as py4j reaches exported classes alone."""
    from py4j.protocol import Py4JError

    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    kinds, given = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    try:
        for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = jvm.java.lang.Class.forName(name)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        return jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, given) or ""
    except Py4JError:
        return ""


def tidy_driver(spark: SparkSession) -> None:
    """Lets the driver go of the plans of earlier tables, each of which holds its whole lineage until both garbage
    collectors have seen it, and of native memory: compiling code for many plans leaves well over 100 MB of it free in
    the pools of the JVM's threads, which no later stage of a session may need."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim_driver(spark)


class Scratch:
    """Intermediate tables in the shared folder, which survive the loss of any executor; each can be deleted once it
    isn't read any more, and close() deletes all but the named ones."""

    #: After so many tables, of all of these objects together, the driver is tidied.
    TIDY = 2
    made = 0

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, what: str) -> DataFrame:
        """``df`` written and read again."""
        path = f"{shared_dir(self.spark)}/arterion/{what}-{uuid.uuid4().hex}"
        with lean(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        Scratch.made += 1
        if Scratch.made % self.TIDY == 0:
            tidy_driver(self.spark)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for x in tables:
            path, _ = self.paths.pop(id(x), (None, None))
            if path:
                at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def close(self, *but: DataFrame) -> None:
        self.drop(*[x for _, x in list(self.paths.values()) if all(x is not y for y in but)])


_RESULTS: list[Scratch] = []


@atexit.register
def _clear() -> None:
    """Deletes the stashed results of this process, if its session still runs."""
    for scratch in _RESULTS:
        with suppress(Exception):  # at exit nobody could act upon it
            scratch.close()


def stash(spark: SparkSession, df: DataFrame, what: str, scratch: Scratch | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again; the tables of ``scratch`` go.  The result itself is deleted
    when the process ends."""
    _RESULTS.append(Scratch(spark))
    out = _RESULTS[-1].keep(df, what)
    if scratch:
        scratch.close()
    return out


#: Keys that hold more than this part of all rows are hot, so that there are at most HOT_KEYS of them.
HOT_KEYS = 1000
#: Ids (of about 16 bytes) that are broadcast at most.
MOST_IDS = 1 << 20


def join_hot(rows: DataFrame, small: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined by column ``key`` with ``small``, which has each key once; ``how``: inner, left or left_semi.

    Keys that hold over 1 / HOT_KEYS of the rows, which are fewer than HOT_KEYS, are joined by a broadcast of their few
    rows of ``small``, so that no task gets all rows of a hot key; the others by shuffle.  Both tables are read twice, so
    they should be tables of Scratch.  ``counts`` (key, n): rows of each key, or fewer, if they are known.
    """
    least = max(1, rows.count() // HOT_KEYS)
    if counts is None:
        counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hot = [(r[key],) for r in counts.where(F.col("n") > least).select(key).collect()]  # fewer than HOT_KEYS
    if not hot:
        return rows.join(small, key, how)
    is_hot = F.broadcast(rows.sparkSession.createDataFrame(hot, rows.select(key).schema))
    some = F.broadcast(small.join(is_hot, key, "left_semi"))
    near = rows.join(is_hot, key, "left_semi").join(some, key, how)
    return near.unionByName(rows.join(is_hot, key, "left_anti").join(small, key, how))


def among(rows: DataFrame, ids: DataFrame, key: str, how: str, most: int = MOST_IDS) -> DataFrame:
    """``rows`` whose ``key`` is (left_semi), or isn't (left_anti), in the one column of ``ids``, a null like a value.

    Only ids move: they are broadcast if they are counted to be at most ``most``; beyond that rows are shuffled too.
    """
    name = "_id_" + uuid.uuid4().hex  # no column of ``rows`` has this name
    ids = ids.select(F.col(ids.columns[0]).alias(name)).distinct()
    small = ids.count() <= most
    return rows.join(F.broadcast(ids) if small else ids.hint("shuffle_hash"), F.col(key).eqNullSafe(F.col(name)), how)


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased and nothing else; texts of ASCII alone take the fast way."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def sql_literal(text: str) -> str:
    """``text`` as a SQL literal for DuckDB."""
    return "'" + text.replace("'", "''") + "'"
