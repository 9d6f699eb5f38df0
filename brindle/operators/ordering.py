"""Places and running sums over all rows of a table in one order, without a task that holds all rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, one of our own on a local master, as in tests; on a cluster that is an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(at or tempfile.mkdtemp(prefix="brindle-"))
    return context.getCheckpointDir().rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and read from the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def in_order(df: DataFrame, order: list[Column | str], place: str, weight: str | None = None) -> DataFrame:
    """Adds place, from 0, and with a weight column also until and total: the sums of weight up to and with the row, and of all rows.

    Rows are dealt to ranges of the order and stored, as the ranges are drawn from a sample and must not be drawn twice. A
    range's rows are counted by a window of its own; what lies before it comes from a table of one row a range, so broadcast.
    """
    dealt = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    summed = F.coalesce(F.sum(weight), F.lit(0.0)) if weight else F.lit(0.0)
    ranges = dealt.groupBy("_range").agg(F.count("*").alias("_rows"), summed.alias("_sum"))
    past = Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_range", F.coalesce(F.sum("_rows").over(past), F.lit(0)).alias("_rows_before"), F.coalesce(F.sum("_sum").over(past), F.lit(0.0)).alias("_sum_before"), F.sum("_sum").over(Window.partitionBy()).alias("_total"))
    within = Window.partitionBy("_range").orderBy(*order)
    found = dealt.withColumn("_nth", F.row_number().over(within))
    extra = [(F.col("_rows_before") + F.col("_nth") - 1).cast("long").alias(place)]
    if weight:
        found = found.withColumn("_until", F.sum(weight).over(within.rowsBetween(Window.unboundedPreceding, 0)))
        extra += [(F.col("_sum_before") + F.col("_until")).alias("until"), F.col("_total").alias("total")]
    return found.join(F.broadcast(ranges), "_range").select(*df.columns, *extra)


#: Aggregates of rows before a row: over rows, over the aggregates of parts, and of two parts that may be null.
RUNNING = {
    "max": (F.max, F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, F.min, lambda a, b: F.least(a, b)),
    "sum": (F.sum, F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "count": (F.count, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
}


def running(df: DataFrame, by: list[str], order: list[Column | str], wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds columns of wanted (name: kind of RUNNING, column): the aggregate of the rows before a row in its group, null where there is none.

    Rows are dealt to ranges of groups and order and stored. A group may go through many ranges: each range aggregates its own part,
    and what lies before it comes from a table of one row a range (only a range's first group began before it), so broadcast."""
    dealt = stored(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    parts = dealt.groupBy(*by, "_range").agg(*[RUNNING[kind][0](c).alias(f"_{name}") for name, (kind, c) in wanted.items()], F.lit(True).alias("_there"))
    past = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(F.col("_range").alias("_of"), *[F.col(b).alias(f"_by_{b}") for b in by], *[RUNNING[kind][1](f"_{name}").over(past).alias(f"_{name}") for name, (kind, _) in wanted.items()], F.max("_there").over(past).alias("_there"))
    same = F.col("_range") == F.col("_of")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    within = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumns({f"_here_{name}": RUNNING[kind][0](c).over(within) for name, (kind, c) in wanted.items()})
    found = local.join(F.broadcast(before.where("_there")), same, "left")
    return found.select(*df.columns, *[RUNNING[kind][2](F.col(f"_{name}"), F.col(f"_here_{name}")).alias(name) for name, (kind, _) in wanted.items()])
