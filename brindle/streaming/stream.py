"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ordering import running, stored
from ..operators.pairing import ranked


def ingest(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str) -> int:
    """Appends what is new in a folder of Parquet files to out; files once taken are not taken again. The number of batches that ran."""
    source = spark.readStream.schema(schema).parquet(folder)
    q = source.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return len(q.recentProgress)


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", key: str = "event_type") -> DataFrame:
    """Count and sum of value by window and key; works on a stream (with a watermark) and on a table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str = "10 minutes", key: str = "event_type") -> DataFrame:
    """Count by overlapping windows and key, of a stream or a table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sessions(events: DataFrame, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Count by sessions of a key: stretches of rows less than gap apart, of a stream or a table."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), "n")


def pool(events: DataFrame, key: str, item: str, size: int = 50) -> DataFrame:
    """A bounded pool for each key of a stream: the first items pass and fill it; later an item passes, or takes the place of
    one that passes instead, as a hash of item and ordinal decides. key, item_in and item_out of each row."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, seen = state.get if state.exists else ([], 0)
        held = list(held)
        for x in batches:
            out = []
            for v in x[item]:
                seen += 1
                h = (int(v) * 2654435761 + seen * 40503) % 2**32
                if len(held) < size:
                    held.append(int(v))
                    out.append(v)
                elif h & 1:
                    at = (h >> 1) % size
                    out.append(held[at])
                    held[at] = int(v)
                else:
                    out.append(v)
            yield pd.DataFrame({key: [k[0]] * len(x), "item_in": x[item].to_numpy(), "item_out": out})
        state.update((held, seen))

    return events.groupBy(key).applyInPandasWithState(step, f"{key} string, item_in long, item_out long", "held array<long>, seen long", "append", GroupStateTimeout.NoTimeout)


def every_nth(df: DataFrame, order: str, n: int) -> DataFrame:
    """A log line each n steps."""
    return df.where(F.pmod(F.col(order), F.lit(n)) == 0)


@contextmanager
def settings(spark: SparkSession, **wanted: str) -> Iterator[None]:
    """Session settings (their dots as __) while the block runs; what stood before stands again after it."""
    names = {k.replace("__", "."): v for k, v in wanted.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def finished(query: StreamingQuery) -> list[dict[str, Any]]:
    """Waits for the end of a query that stops by itself; the progress of its batches that had rows. A failure in it is raised."""
    query.awaitTermination()
    return [p for p in query.recentProgress if p["numInputRows"]]


def stream_files(spark: SparkSession, path: str, schema: str | T.StructType, files_a_batch: int = 1000) -> DataFrame:
    """The rows of Parquet files as a stream, so many files at most in a batch; files once taken under a checkpoint are not taken again."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def write_batches(rows: DataFrame, path: str, checkpoint: str, by: tuple[str, ...] = (), prepare: Callable[[DataFrame, int], DataFrame] | None = None, after: Callable[[DataFrame, int], None] | None = None) -> list[dict[str, Any]]:
    """Writes what is new in a stream to Parquet, each row once even if the writing stops at any place and begins again.

    A batch is written to partitions batch=<its number>, which replace what a stopped try left there: Spark gives a batch whose end
    was not noted in the checkpoint the same rows and number again. by: more columns to partition by. prepare: makes the rows to
    write of a batch and its number. after: called with each batch and its number when it stands; a batch that is tried again calls
    it again. Returns the batches' progress."""

    def put(batch: DataFrame, number: int) -> None:
        numbered = (prepare(batch, number) if prepare else batch).withColumn("batch", F.lit(number).cast("long"))
        numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", *by).parquet(path)
        if after:
            after(batch, number)

    return finished(rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def closed_windows(events: DataFrame, path: str, checkpoint: str, late: str = "10 minutes", width: str = "1 hour", key: str = "event_type") -> list[dict[str, Any]]:
    """Appends the windows of a stream (windowed) to Parquet when the watermark has passed their end, so none changes later. A row whose window the
    watermark of the batches before had closed is dropped. The watermark and open windows are in the checkpoint: a later run closes them."""
    rows = windowed(events, late, width, key)
    return finished(rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())


def marks_crossed(counts: DataFrame, every: int) -> DataFrame:
    """Of rows (batch, n), in order of batch: batch, seen (rows up to its end) and mark, each multiple of every that the batch crossed,
    so that something is done after each so many rows however batches are cut. A table of a row a batch."""
    w = Window.partitionBy().orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = counts.withColumn("seen", F.sum("n").over(w))
    first, last = F.floor((F.col("seen") - F.col("n")) / every) + 1, F.floor(F.col("seen") / every)
    return seen.where(last >= first).select("batch", "seen", F.explode(F.sequence(first, last)).alias("mark")).withColumn("mark", F.col("mark") * every)


def place_in_pool(item: Column, nth: Column, size: int) -> Column:
    """The place that the nth item (from 1) takes in a pool: the next free one, later one that a hash of item and nth draws, or none (null).

    The hash is (item * 2654435761 + nth * 40503) mod 2 ** 32, the product in two parts that stay within a long."""
    low, whole = F.lit(0xFFFF), F.lit(2**32)
    a, (high_part, low_part) = F.pmod(item, whole), divmod(2654435761, 2**16)
    product = a * low_part + (a * high_part).bitwiseAND(low) * 2**16
    h = F.pmod(product + F.pmod(nth, whole) * 40503, whole)
    return F.when(nth <= size, nth - 1).when(h.bitwiseAND(1) == 1, F.pmod(F.shiftright(h, 1), F.lit(size))).cast("int")


def pool_by_place(rows: DataFrame, key: str, item: str, path: str, checkpoint: str, places: str, size: int = 50) -> list[dict[str, Any]]:
    """What pool gives, of keys with any number of rows: writes key, <item>_in and <item>_out of each row of a stream to Parquet by batch (write_batches).

    A batch's rows of a key are numbered in the order of their items by ranges (ranked), and what a place held before a row comes from the
    rows before it in that place, by ranges as well (running), so no task holds a key. What each place holds after a batch, and how many rows
    each key has had, is written to places/batch=<its number>, a row a key and place; the next batch goes on from there, and a batch that is tried again
    begins with what the one before it left."""
    kind = dict(rows.dtypes)[key]
    same = F.col(key).eqNullSafe(F.col("_of"))
    state = f"`{key}` {kind}, _place int, _nth long, `{item}` long"  # _place -1: rows so far

    def prepare(batch: DataFrame, number: int) -> DataFrame:
        spark = batch.sparkSession
        before = spark.read.schema(state).parquet(f"{places}/batch={number - 1}") if number else spark.createDataFrame([], state)
        seen = before.where("_place = -1").select(F.col(key).alias("_of"), F.col("_nth").alias("_seen"))
        numbered = ranked(batch.select(key, F.col(item).cast("long").alias(item)), "_at", key, item, hot=True)
        nth = F.coalesce("_seen", F.lit(0)) + F.coalesce("_at", F.lit(0)) + 1
        placed = stored(numbered.join(seen, same, "left").select(key, nth.cast("long").alias("_nth"), item).withColumn("_place", place_in_pool(F.col(item), F.col("_nth"), size)))
        held = before.where("_place >= 0").withColumn("_old", F.lit(True))
        line = stored(placed.where("_place is not null").withColumn("_old", F.lit(False)).unionByName(held).withColumn("_own", F.struct("_nth", item)))
        counts = placed.groupBy(key).agg(F.max("_nth").alias("_nth")).unionByName(seen.select(F.col("_of").alias(key), F.col("_seen").alias("_nth")))
        after = line.groupBy(key, "_place").agg(F.max("_own").alias("_own")).select(key, "_place", "_own._nth", F.col(f"_own.{item}").alias(item))
        so_far = counts.groupBy(key).agg(F.max("_nth").alias("_nth")).select(key, F.lit(-1).alias("_place"), "_nth", F.lit(None).cast("long").alias(item))
        after.unionByName(so_far).write.mode("overwrite").parquet(f"{places}/batch={number}")
        swapped = running(line, [key, "_place"], ["_nth"], {"_past": ("max", "_own")}).where("not _old")
        out = F.when(F.col("_nth") <= size, F.col(item)).otherwise(F.col(f"_past.{item}"))
        passed = placed.where("_place is null").select(key, F.col(item).alias(f"{item}_in"), F.col(item).alias(f"{item}_out"))
        return passed.unionByName(swapped.select(key, F.col(item).alias(f"{item}_in"), out.alias(f"{item}_out")))

    return write_batches(rows, path, checkpoint, prepare=prepare)
