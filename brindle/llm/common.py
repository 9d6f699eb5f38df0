"""Helpers that the operators share: the shared folder, kept tables, words, reading."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in Java, RE2 and Python syntax alike: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir. Where it is unset, one of our own on a local master, as in tests;
    on a cluster that is an error, as executors don't see each other's disks."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="brindle-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: later steps neither recompute it nor
    depend on the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def forget(*kept: DataFrame) -> None:
    """Removes the files of tables that keep made, when all that reads them has been written itself."""
    for df in kept:
        if at := df.__dict__.pop("_kept_at", None):
            context = df.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a table of keys (a long or two each) that are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 500_000


def beside(keys: DataFrame) -> DataFrame:
    """A kept table of keys, to be broadcast if it has at most MOST_BROADCAST rows (so that what it is joined to stays where it is), else as it is."""
    return F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys


#: Rows that go to a Python worker at once: texts may be long, and a worker's memory is small.
BATCH_ROWS = 512


def batched(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches set to at most BATCH_ROWS rows."""
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


#: Characters of text that a worker turns into one frame of results.
SLICE_CHARS = 1 << 19


def sliced(batches: Iterator[pd.DataFrame], column: str = "text", chars: int = SLICE_CHARS) -> Iterator[pd.DataFrame]:
    """The batches' rows in frames of about so many characters of a column, of one row at least."""
    for x in batches:
        begin, total = 0, 0
        for i, t in enumerate(x[column]):
            n = len(t) if t else 0
            if i > begin and total + n > chars:
                yield x.iloc[begin:i]
                begin, total = i, 0
            total += n
        if len(x) > begin:
            yield x.iloc[begin:]


_HELD: dict[str, Any] = {}
_THRESHOLD = gc.get_threshold()


def held(key: str, make: Callable[[], Any]) -> Any:
    """What make() gives, remembered by this Python worker for its next tasks, until one of another operator begins (let_go)."""
    if key not in _HELD:
        let_go()
        _HELD[key] = make()
        gc.freeze()
        gc.set_threshold(200_000)  # tables of tuples hold no cycles; looking for them takes a quarter of the time
    return _HELD[key]


def let_go() -> None:
    """Gives back what held remembers: a worker goes on to tasks of later stages, which need the memory themselves."""
    if _HELD:
        _HELD.clear()
        gc.unfreeze()
        gc.set_threshold(*_THRESHOLD)
        _trim()


def _trim() -> None:
    """Hands free memory back to the system; the allocators would keep much of it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for mapInPandas or mapInArrow: after a task an idle worker keeps little memory beside what held remembers."""

    def begun(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            _trim()

    return begun


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 with A-Z lower-cased; bytes.split cuts at ASCII white space, bytes.lower maps A-Z only."""
    return text.encode().lower().split() if text else []


def unit_interval(*keys: Column | str) -> Column:
    """A number in (0, 1) that depends on the keys alone, the same in every run and partitioning."""
    return (F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") + F.lit(0.5)) / F.lit(float(2**53))
