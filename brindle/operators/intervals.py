"""Joins of points with stretches of a line: the stretch that begins last before a point, and all stretches that hold it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import in_order, stored

#: Values of 13 hexadecimal digits.
DRAWN = float(16**13)


def last_before(points: DataFrame, at: str, begins: DataFrame, low: str) -> DataFrame:
    """points with the other columns of the row of begins whose low is the greatest that is at most their own value; nulls if there is none.

    Both sides are dealt to ranges of one order, so many points within one stretch are spread over ranges as any others are. A range
    looks for a point's row in itself; what began before the range comes from a table of one row a range, so broadcast. Of rows that
    begin at one place the greatest counts."""
    held = [c for c in begins.columns if c != low]
    row, point = F.struct(*[F.col(c) for c in held]), F.struct(*[F.col(c) for c in points.columns])
    kinds = {"_row": begins.select(row.alias("x")).schema[0].dataType, "_point": points.select(point.alias("x")).schema[0].dataType}
    left = begins.where(F.col(low).isNotNull()).select(F.col(low).cast("double").alias("_at"), F.lit(0).alias("_kind"), row.alias("_row"), F.lit(None).cast(kinds["_point"]).alias("_point"), F.lit(0).cast("long").alias("_hash"))
    right = points.select(F.col(at).cast("double").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(kinds["_row"]).alias("_row"), point.alias("_point"), F.xxhash64(*points.columns).alias("_hash"))
    dealt = stored(left.unionByName(right).repartitionByRange("_at", "_kind", "_hash").withColumn("_range", F.spark_partition_id()))
    ends = dealt.groupBy("_range").agg(F.max_by("_row", F.when(F.col("_kind") == 0, F.struct("_at", "_row"))).alias("_end"))
    past = Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.broadcast(ends.select("_range", F.last("_end", ignorenulls=True).over(past).alias("_carried")))
    within = Window.partitionBy("_range").orderBy("_at", "_kind", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = dealt.withColumn("_found", F.last("_row", ignorenulls=True).over(within)).where("_kind = 1").join(carried, "_range")
    x = F.coalesce("_found", "_carried")
    return found.select("_point.*", *[F.when(F.col("_at").isNotNull(), x[c]).alias(c) for c in held])


def unit_draw(seed: int, *key: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys' text forms alone, in every engine with MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *key)), 1, 13), 16, 10).cast("long") / F.lit(DRAWN)


def draws_with_replacement(weighted: DataFrame, key: str, weight: str, draws: int, seed: int) -> DataFrame:
    """draw (from 0) and key: for each draw a row, taken in proportion to its weight, however often it was taken before.

    The rows' weights are laid end to end in order of key; each draw is a point on that line, by a hash of seed and draw. Rows of no
    weight are never drawn; with no weight at all there are no draws."""
    t = in_order(weighted.where(F.col(weight) > 0).select(key, F.col(weight).cast("double").alias("_w")), [key], "_place", "_w")
    line = t.select((F.col("until") - F.col("_w")).alias("_low"), key)
    whole = F.broadcast(t.agg(F.max("total").alias("_total")).where("_total > 0"))  # one row
    points = weighted.sparkSession.range(draws).withColumnRenamed("id", "draw").crossJoin(whole).select("draw", (unit_draw(seed, F.col("draw")) * F.col("_total")).alias("_u"))
    return last_before(points, "_u", line, "_low").select("draw", key)


#: Rows of a side that meet in one unit, and pairs that a task makes.
STRIP, PAIRS_IN_TASK = 4096, 20_000_000


def holding(points: DataFrame, at: str, stretches: DataFrame, low: str, high: str, cells: int = 1000) -> DataFrame:
    """Each point with each stretch that holds it, low <= at < high; stretches may overlap.

    The stretches' line is cut into cells of one width. A stretch is dealt to each cell that it reaches into, a point to its own, and
    they meet by cell, so no point is held against stretches of other cells. A stretch and a point share one cell at most. A cell's rows are
    cut into strips, which meet two by two wherever they are, and there are as many tasks as the pairs need, so none of them grows with the tables."""
    line = F.broadcast(stretches.agg(F.min(low).cast("double").alias("_from"), F.max(high).cast("double").alias("_to")))  # one row
    cell = lambda c: F.least(F.floor((c - F.col("_from")) / F.greatest(F.col("_to") - F.col("_from"), F.lit(1e-300)) * cells), F.lit(cells - 1))
    spread = stretches.where(F.col(low) < F.col(high)).crossJoin(line).withColumn("_cell", F.explode(F.sequence(cell(F.col(low)), cell(F.col(high))))).drop("_from", "_to")
    placed = points.crossJoin(line).where((F.col(at) >= F.col("_from")) & (F.col(at) < F.col("_to"))).withColumn("_cell", cell(F.col(at))).drop("_from", "_to")
    sizes = stored(placed.groupBy("_cell").agg(F.count("*").alias("_p")).join(spread.groupBy("_cell").agg(F.count("*").alias("_s")), "_cell"))
    pairs = sizes.agg(F.sum(F.col("_p").cast("double") * F.col("_s"))).first()[0] or 0
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / PAIRS_IN_TASK))
    strips = F.broadcast(sizes.select("_cell", F.ceil(F.col("_p") / STRIP).alias("_ps"), F.ceil(F.col("_s") / STRIP).alias("_ss")))  # a row a cell
    unit = ["_cell", "_i", "_j"]
    some = lambda rows, n: F.pmod(F.xxhash64(*rows.columns), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = placed.join(strips, "_cell").withColumn("_i", some(points, "_ps")).withColumn("_j", each("_ss")).drop("_ps", "_ss").repartition(tasks, *unit)
    right = spread.join(strips, "_cell").withColumn("_j", some(stretches, "_ss")).withColumn("_i", each("_ps")).drop("_ps", "_ss").repartition(tasks, *unit)
    return left.join(right, unit).where((F.col(low) <= F.col(at)) & (F.col(at) < F.col(high))).drop(*unit)
