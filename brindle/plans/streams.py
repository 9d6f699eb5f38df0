"""Queries that run as streams: the events arrive in parts, each part is a run that ends when it has taken all that is there."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables as S
from ..streaming import stream
from .catalogue import query, table

#: Parts that the events arrive in.
PARTS = 4


def arriving(rows: DataFrame, part: Column, at: str) -> Iterator[int]:
    """Adds the rows of one part after another to a folder of Parquet files."""
    for number in range(PARTS):
        rows.where(part == number).write.mode("append").parquet(at)
        yield number


def by_day(ts: str = "ts") -> Column:
    return F.least(F.floor((F.dayofmonth(ts) - 1) / 8), F.lit(PARTS - 1)).cast("int")


def late_part() -> Column:
    """The part of a row's day; every seventh row comes a part later."""
    return F.least(by_day() + F.when(F.pmod("event_id", F.lit(7)) == 0, 1).otherwise(0), F.lit(PARTS - 1))


DAY = "least((day(ts) - 1) // 8, 3)"
LATE = f"WITH e AS (SELECT *, least({DAY} + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END, 3) AS part FROM events)"


@query("closed_windows", LATE + """, m AS (SELECT part, max(max(ts)) OVER (ORDER BY part) - INTERVAL '10 minutes' AS mark FROM e GROUP BY part),
w AS (SELECT e.*, time_bucket(INTERVAL '1 hour', ts) AS start, b.mark AS before FROM e LEFT JOIN m b ON b.part = e.part - 1)
SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w
WHERE (before IS NULL OR start + INTERVAL '1 hour' > before) AND start + INTERVAL '1 hour' <= (SELECT max(mark) FROM m) GROUP BY 1, 2""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of an hour over a stream in which every seventh row comes late: rows of closed windows are dropped, open windows are not told."""
    e, at, out, mark = table(spark, sf, "events"), S.scratch(spark, "arrived"), S.scratch(spark, "closed"), S.scratch(spark, "mark")
    for _ in arriving(e, late_part(), at):
        arrived = stream.stream_files(spark, at, e.schema)
        stream.closed_windows(arrived.withColumn("ts", F.col("ts").cast("timestamp")), out, mark)
    found = spark.read.schema("start timestamp, event_type string, n long, total double").parquet(out)
    return found.withColumns({"start": F.col("start").cast("timestamp_ntz"), "total": F.round("total", 4)})


@query("resumed_batches", f"SELECT event_id, value, {DAY} AS batch FROM events")
def _(spark, sf):
    """Each row once, under the number of the batch that brought it."""
    e, at, out, mark = table(spark, sf, "events"), S.scratch(spark, "arrived"), S.scratch(spark, "batches"), S.scratch(spark, "mark")
    for _ in arriving(e, by_day(), at):
        stream.write_batches(stream.stream_files(spark, at, e.schema), out, mark)
    return spark.read.parquet(out).select("event_id", "value", F.col("batch").cast("int").alias("batch"))


@query("marks_crossed", f"""WITH c AS (SELECT {DAY} AS batch, count(*) AS n FROM events GROUP BY 1), s AS (SELECT batch, n, sum(n) OVER (ORDER BY batch) AS seen FROM c)
SELECT batch, CAST(seen AS BIGINT) AS seen, CAST(unnest(range(CAST((seen - n) // 500 + 1 AS BIGINT), CAST(seen // 500 + 1 AS BIGINT))) * 500 AS BIGINT) AS mark FROM s""")
def _(spark, sf):
    """The batch in which each 500th row came, of rows as batches brought them."""
    e, at, out, mark = table(spark, sf, "events"), S.scratch(spark, "arrived"), S.scratch(spark, "batches"), S.scratch(spark, "mark")
    for _ in arriving(e, by_day(), at):
        stream.write_batches(stream.stream_files(spark, at, e.schema), out, mark)
    counts = spark.read.parquet(out).groupBy("batch").agg(F.count("*").alias("n"))
    return stream.marks_crossed(counts, 500).select(F.col("batch").cast("int").alias("batch"), "seen", "mark")


@query("pool_by_place", """WITH e AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS nth FROM events),
h AS (SELECT *, (CAST(event_id AS HUGEINT) * 2654435761 + nth * 40503) % 4294967296 AS h FROM e),
p AS (SELECT *, CASE WHEN nth <= 50 THEN nth - 1 WHEN h % 2 = 1 THEN (h // 2) % 50 END AS place FROM h)
SELECT event_type, event_id AS event_id_in, CASE WHEN place IS NULL OR nth <= 50 THEN event_id ELSE lag(event_id) OVER (PARTITION BY event_type, place ORDER BY nth) END AS event_id_out FROM p""")
def _(spark, sf):
    """The pool of each type over a stream in parts: what its places hold is written with each batch, and the next run goes on from there."""
    e, at, out, mark = table(spark, sf, "events"), S.scratch(spark, "arrived"), S.scratch(spark, "pooled"), S.scratch(spark, "mark")
    for _ in arriving(e, by_day(), at):
        rows = stream.stream_files(spark, at, e.schema).select("event_type", "event_id")
        stream.pool_by_place(rows, "event_type", "event_id", out, mark, f"{out}-places")
    return spark.read.parquet(out).drop("batch")
