"""Sampling weights, caps on a group's share, and draws by weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import in_order


def balance_weights(df: DataFrame, label: str, power: float, cap: float | None = None) -> DataFrame:
    """label, n, weight = (1 / n)^power, at most cap times the smallest, and share, the part of the draws that it expects."""
    t = df.groupBy(label).agg(F.count("*").alias("n")).withColumn("weight", F.pow(1 / F.col("n"), F.lit(power)))
    if cap:
        t = t.withColumn("weight", F.least("weight", F.min("weight").over(Window.partitionBy()) * cap))
    return t.withColumn("share", F.col("n") * F.col("weight") / F.sum(F.col("n") * F.col("weight")).over(Window.partitionBy()))


def cap_shares(groups: DataFrame, group: str, weight: str, cap: float) -> DataFrame:
    """group, share: shares of weight, none above cap; what is cut goes to the rest in proportion. All alike if the cap can't be met.

    The closed form: with the groups in falling order of weight, the first m stop at the cap, for the least m that leaves none above.
    """
    t = in_order(groups.select(group, weight), [F.desc(weight), F.col(group)], "_k", weight).withColumn("rest", F.col("total") - F.col("until") + F.col(weight))
    fits = F.col(weight) / F.col("rest") * (1 - F.col("_k") * cap) <= cap + 1e-12
    first = F.broadcast(t.agg(F.min(F.when(fits, F.struct("_k", "rest"))).alias("m"), F.count("*").alias("n")))  # one row
    share = F.when(F.col("n") * cap < 1, 1 / F.col("n")).when(F.col("_k") < F.col("m._k"), F.lit(cap)).otherwise(F.col(weight) / F.col("m.rest") * (1 - F.col("m._k") * cap))
    return t.crossJoin(first).select(group, share.alias("share"))


def even_draws(weighted: DataFrame, key: str, weight: str, draws: int) -> DataFrame:
    """key, times: how many of the points (i + 0.5) / draws fall into the key's stretch of the summed weights."""
    t = in_order(weighted, [key], "_place", weight).withColumnsRenamed({"until": "hi"})
    edge = lambda c: F.ceil(c / F.col("total") * draws - 0.5)
    return t.select(key, (edge(F.col("hi")) - edge(F.col("hi") - F.col(weight))).cast("long").alias("times"))


def grid_crops(df: DataFrame, key: str, shape: tuple[int, int, int], step: int, repeats: int, seed: int = 0) -> DataFrame:
    """key, x, y, z: for each key `repeats` distinct starts of a fixed grid, drawn by a hash of seed, key and start. A row makes its own starts, so nothing is shuffled."""
    axes = [F.transform(F.sequence(F.lit(0), F.lit(n - step), F.lit(step)), lambda v: v.cast("long")) for n in shape]
    starts = F.flatten(F.transform(axes[0], lambda x: F.flatten(F.transform(axes[1], lambda y: F.transform(axes[2], lambda z: F.struct(F.md5(F.concat_ws(":", F.lit(seed), F.col(key), x, y, z)).alias("h"), x.alias("x"), y.alias("y"), z.alias("z")))))))
    return df.select(key, F.explode(F.slice(F.array_sort(starts), 1, repeats)).alias("s")).select(key, "s.x", "s.y", "s.z")


def stable_seed(*parts) -> Column:
    """A number below 2^32 that depends on the parts' text forms alone, the same in every run, partitioning and language."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def shuffled_places(df: DataFrame, key: str, name: str) -> DataFrame:
    """Adds name, the place from 0 of each row in the order of its key's MD5 (repeats of a key after one another).

    Counted in 65,536 cells of MD5: a window over the cells' counts, then one within each cell, so no task holds all rows.
    """
    t = df.withColumn("_md", F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))).withColumn("_cell", F.substring("_md", 1, 4))
    sums = t.groupBy("_cell").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.partitionBy().orderBy("_cell")) - F.col("_n"))
    within = F.row_number().over(Window.partitionBy("_cell").orderBy("_md", key))
    placed = t.withColumn("_within", within).join(F.broadcast(sums), "_cell")  # 65,536 rows at most
    return placed.withColumn(name, F.col("_before") + F.col("_within") - 1).select(*df.columns, name)


def random_pairs(left: DataFrame, right: DataFrame, a: str, b: str, seed: int) -> DataFrame:
    """a, b: each row of left with a row of right, drawn uniformly by a hash of seed and a. No rows if right has none."""
    places = shuffled_places(right.select(b), b, "_place")
    n = right.agg(F.count("*").alias("_n"))  # one row
    drawn = left.select(a).crossJoin(F.broadcast(n)).where("_n > 0").withColumn("_place", F.pmod(stable_seed(F.lit(seed), F.col(a)), F.col("_n")))
    return drawn.join(places, "_place").select(a, b)
