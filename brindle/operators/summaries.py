"""Pooled, paired and binned summaries of per-volume metric rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import finite, with_interval
from .ordering import in_order, running, stored


#: Rows with an age that a table by age needs.
LEAST_AGED = 6
#: Share of the rows on each side of a quantile's place that may hold it, and the accuracy of the estimate that tells where they begin and end.
NEAR, ACCURACY = 3e-4, 10_000


def blocks(df: DataFrame, subgroup: str) -> DataFrame:
    """Each row under ALL and, where there is more than one subgroup, under its own: column block."""
    n = df.agg(F.countDistinct(subgroup).alias("_kinds"))
    both = df.crossJoin(F.broadcast(n))  # one row
    return both.withColumn("block", F.explode(F.when(F.col("_kinds") > 1, F.array(F.lit("ALL"), F.col(subgroup))).otherwise(F.array(F.lit("ALL"))))).drop("_kinds")


def in_blocks(df: DataFrame, subgroup: str, keys: list[str], *aggs: Column) -> DataFrame:
    """block, keys and the aggregates: of all rows under ALL and, where there is more than one subgroup, of each subgroup, from one pass
    over the rows (grouping sets). For few keys and subgroups: their rows are counted in one task."""
    sets = df.groupingSets([[*keys, subgroup], list(keys)], *keys, subgroup).agg(F.grouping(subgroup).alias("_all"), *aggs)
    kinds = F.size(F.collect_set(F.when(F.col("_all") == 0, F.col(subgroup))).over(Window.partitionBy()))  # a row a group
    kept = sets.withColumn("_kinds", kinds).where("_all = 1 or _kinds > 1")
    named = F.when(F.col("_all") == 1, "ALL").otherwise(F.col(subgroup))
    return kept.withColumn("block", named).select("block", *keys, *[c for c in sets.columns if c not in (*keys, subgroup, "_all")])


def long_metrics(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, metric, value: finite values only."""
    return df.unpivot(keys, metrics, "metric", "value").withColumn("value", finite(F.col("value"))).where("value is not null")


def quantiles_of_counts(counts: DataFrame, keys: list[str], value: str, times: str, share: float = 0.5, name: str = "median", whole: str | None = None) -> DataFrame:
    """keys and the exact quantile of values that come so many times each, between two neighbours in proportion, for few groups of any size.

    counts: a row for each group and value. The times are summed up by ranges of the order of groups and values (see in_order), so no
    task holds a group, and rows that tie are one row; the one or two values at the quantile's place are picked. whole: a column with the
    size of the group, where its greatest values are left out of counts."""
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    rows = counts.select(key.alias("_g"), F.col(value).cast("double").alias("_v"), F.col(times).alias("_c"), *([F.col(whole).alias("_whole")] if whole else [])).where("_v is not null")
    placed = in_order(rows, ["_g", "_v"], "_k", "_c").withColumn("_from", F.col("until") - F.col("_c"))
    groups = placed.groupBy("_g").agg((F.max("_whole") if whole else F.sum("_c")).alias("_n"), F.min("_from").alias("_begin")).select(F.col("_g").alias("_of"), "_begin", ((F.col("_n") - 1) * F.lit(float(share))).alias("_at"))
    holds = lambda c: (F.col("_from") - F.col("_begin") <= c) & (c < F.col("until") - F.col("_begin"))
    near = placed.join(F.broadcast(groups), F.col("_g").eqNullSafe(F.col("_of"))).where(holds(F.floor("_at")) | holds(F.ceil("_at")))  # a row a group
    two = near.groupBy("_g").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.max(F.col("_at") - F.floor("_at")).alias("part"))
    return two.select(*[F.col(f"_g.{k}").alias(k) for k in keys], F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((1 - F.col("part")) * F.col("lo") + F.col("part") * F.col("hi")).alias(name))


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value and times: how often each value comes in each group, counted before anything is shuffled."""
    return df.groupBy(*keys, F.col(value).cast("double").alias(value)).agg(F.count("*").alias("times"))


def quantiles(df: DataFrame, keys: list[str], value: str, share: float = 0.5, name: str = "median") -> DataFrame:
    """keys and the exact quantile of the values that aren't null, for few groups of any size (quantiles_of_counts). Groups without a value are left out."""
    return quantiles_of_counts(value_counts(df, keys, value), keys, value, "times", share, name)


def with_quantile(groups: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """groups with the column of quantiles; keys may be null."""
    named = found.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in found.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return groups.join(F.broadcast(named), same, "left").drop(*[f"_{k}" for k in keys])  # a row a group


def described(value: str, sd: str) -> list[Column]:
    spread = F.stddev_samp(value) if sd == "samp" else F.stddev_pop(value)
    return [F.count(value).alias("n"), F.avg(value).alias("mean"), spread.alias("sd"), F.min(value).alias("low"), F.max(value).alias("high")]


def describe(df: DataFrame, keys: list[str], value: str = "value", sd: str = "samp") -> DataFrame:
    """n, mean, sd, median, low and high of the values by a few groups."""
    groups = df.groupBy(*keys).agg(*described(value, sd))
    return with_quantile(groups, quantiles(df, keys, value), keys).select(*keys, "n", "mean", "sd", "median", "low", "high")


def describe_blocks(df: DataFrame, subgroup: str, keys: list[str], value: str = "value", sd: str = "samp") -> DataFrame:
    """What describe gives, by block (in_blocks) and keys, few of them.

    The first pass estimates values on both sides of each median. The second one counts the rows below them and the values between, which
    alone are put in order. Should an estimate miss the median's place, all values are put in order."""
    by = ["block", *keys]
    around = F.percentile_approx(F.col(value).cast("double"), F.array(F.lit(0.5 - NEAR), F.lit(0.5 + NEAR)), F.lit(ACCURACY))
    groups = stored(in_blocks(df, subgroup, keys, *described(value, sd), around.alias("_around")))
    near = stored(_near_medians(df, subgroup, keys, value, groups))
    at = (F.max("_whole") - 1) * F.lit(0.5)
    below, until = F.coalesce(F.sum(F.when(F.col("_below"), F.col("times"))), F.lit(0)), F.sum("times")
    held = near.groupBy(*by).agg(((below <= F.floor(at)) & (F.ceil(at) < until)).alias("_held")).where("_held")
    if held.count() == groups.where("n > 0").count():
        found = quantiles_of_counts(near, by, value, "times", whole="_whole")
    else:
        several = F.broadcast(groups.agg((F.countDistinct("block") > 1).alias("_several")))  # one row
        sets = value_counts(df, [*keys, subgroup], value).groupingSets([[*keys, value, subgroup], [*keys, value]], *keys, value, subgroup).agg(F.grouping(subgroup).alias("_all"), F.sum("times").alias("times"))
        kept = sets.crossJoin(several).where("_all = 1 or _several").withColumn("block", F.when(F.col("_all") == 1, "ALL").otherwise(F.col(subgroup)))
        found = quantiles_of_counts(kept, by, value, "times")
    return with_quantile(groups, found, by).select(*by, "n", "mean", "sd", "median", "low", "high")


def _near_medians(df: DataFrame, subgroup: str, keys: list[str], value: str, groups: DataFrame) -> DataFrame:
    """block, keys, value, _below, times and _whole (rows of the group): counts of values within _around of groups, and of all below it as -infinity."""
    sides = F.broadcast(groups.where("n > 0").select(*[F.col(c).alias(f"_of_{c}") for c in ("block", *keys)], F.col("n").alias("_whole"), F.get("_around", 0).alias("_from"), F.get("_around", 1).alias("_to")))  # a row a group
    rows = df.select(*keys, F.col(value).cast("double").alias(value), F.explode(F.array(F.lit("ALL"), F.col(subgroup).cast("string"))).alias("block")).where(F.col(value).isNotNull())
    same = F.lit(True)
    for c in ("block", *keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    both = rows.join(sides, same).where(F.col(value) <= F.col("_to")).withColumn("_below", F.col(value) < F.col("_from"))
    cut = both.withColumn(value, F.when(F.col("_below"), F.lit(float("-inf"))).otherwise(F.col(value)))
    return cut.groupBy("block", *keys, value, "_below").agg(F.count("*").alias("times"), F.max("_whole").alias("_whole"))


def cv_summary(df: DataFrame, subgroup: str, metrics: list[str]) -> DataFrame:
    return with_interval(describe_blocks(long_metrics(df, [subgroup], metrics), subgroup, ["metric"]))


def paired(df: DataFrame, subgroup: str, a: Column, b: Column) -> DataFrame:
    """n, mean, sd, hw of a - b by block where both are finite, and whether the interval includes zero."""
    d = df.withColumn("_d", finite(a) - finite(b)).where("_d is not null")
    t = with_interval(in_blocks(d, subgroup, [], F.count("_d").alias("n"), F.avg("_d").alias("mean"), F.stddev_samp("_d").alias("sd")))
    return t.withColumn("includes_zero", F.coalesce((F.col("mean") - F.col("hw") <= 0) & (F.col("mean") + F.col("hw") > 0), F.lit(False)))


def by_age(df: DataFrame, subgroup: str, age: str, edges: list[float], a: Column, b: Column, least: int = LEAST_AGED) -> DataFrame:
    """bin, block, n, pred, delta (a - b), sd and hw of the rows where both and the age are finite; no table at all of fewer than least such rows."""
    rows = df.withColumn("_d", finite(a) - finite(b)).withColumn("bin", in_bins(finite(F.col(age)), edges)).where("_d is not null and bin is not null")
    t = in_blocks(rows, subgroup, ["bin"], F.count("*").alias("n"), F.avg(a).alias("pred"), F.avg("_d").alias("delta"), F.stddev_samp("_d").alias("sd"))
    aged = F.sum(F.when(F.col("block") == "ALL", F.col("n"))).over(Window.partitionBy())  # a row a bin and block
    return with_interval(t.withColumn("_aged", aged).where(F.col("_aged") >= least).drop("_aged"))


def in_bins(value: Column, edges: list[float]) -> Column:
    """The number of the half-open bin, the last one closed; null outside."""
    out = F.lit(None).cast("int")
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        out = F.when((value >= a) & ((value < b) | ((value == b) & F.lit(i == len(edges) - 2))), F.lit(i)).otherwise(out)
    return out


def flag_low(df: DataFrame, db: str, hf: str, db_above: float, ratio: float) -> DataFrame:
    """Flag LOW: measured db at db_above or more, where any row has one; else hf below ratio times the median."""
    whole = df.agg((F.count(finite(F.col(db))) > 0).alias("_measured")).join(F.broadcast(quantiles(df, [], hf, name="_median")), how="left")  # one row each
    low = F.when(F.col("_measured"), finite(F.col(db)) >= db_above).otherwise(F.col(hf) < ratio * F.greatest("_median", F.lit(1e-12)))
    return df.crossJoin(F.broadcast(whole)).withColumn("flag", F.when(low, "LOW").otherwise("")).drop("_median", "_measured")  # one row


def audit(flagged: DataFrame, by: str, hf: str, db: str) -> DataFrame:
    """by, n, median, low and high of hf, the count of flags LOW, and db_n, db_median, db_low and db_high of the finite measured values."""
    rows = flagged.withColumn("_db", finite(F.col(db)))
    t = rows.groupBy(by).agg(F.count("*").alias("n"), F.min(hf).alias("low"), F.max(hf).alias("high"), F.count_if(F.col("flag") == "LOW").alias("flagged"), F.count("_db").alias("db_n"), F.min("_db").alias("db_low"), F.max("_db").alias("db_high"))
    t = with_quantile(t, quantiles(rows, [by], hf), [by])
    return with_quantile(t, quantiles(rows, [by], "_db", name="db_median"), [by]).select(by, "n", "median", "low", "high", "flagged", "db_n", "db_median", "db_low", "db_high")


def best_so_far(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """is_best: the value is above all before it, in groups of any size."""
    found = running(df, [by], order, {"_best": ("max", value)})
    return found.withColumn("is_best", F.coalesce(F.col(value) > F.col("_best"), F.lit(True))).drop("_best")


def power_edge(df: DataFrame, by: str, freq: str, power: str, level: float = 0.99, least: int = 3) -> DataFrame:
    """cumulative_edge of a spectrum: its first bin, the mean's, does not count; NaN where there are fewer bins than least or no power."""
    bins = df.groupBy(by).agg(F.count("*").alias("_n"), F.min(freq).alias("_first"))
    rows = df.select(by, freq, power).join(bins.where(F.col("_n") >= least).drop("_n"), by)
    edges = cumulative_edge(rows.withColumn(power, F.when(F.col(freq) > F.col("_first"), F.col(power)).otherwise(0.0)).drop("_first"), by, freq, power, level)
    return bins.select(by).join(edges, by, "left").select(by, F.coalesce("edge", F.lit(float("nan"))).alias("edge"))


def cumulative_edge(df: DataFrame, by: str, freq: str, power: str, level: float = 0.99) -> DataFrame:
    """by, edge: the frequency, between two bins in proportion, where the summed share of power reaches level, in groups of any size. A
    group without power has no row."""
    totals = df.groupBy(by).agg(F.sum(power).alias("_all")).where("_all > 0")
    t = running(df.select(by, freq, power), [by], [freq], {"_past": ("sum", power), "_pf": ("max", freq)}).join(totals, by)
    t = t.withColumn("_pc", F.col("_past") / F.col("_all")).withColumn("_c", (F.coalesce("_past", F.lit(0.0)) + F.coalesce(power, F.lit(0.0))) / F.col("_all")).where(f"_c >= {level}")
    first = t.groupBy(by).agg(F.min_by(F.struct("_c", "_pc", "_pf", freq), freq).alias("x"))
    cut = F.col(f"x.{freq}") - F.col("x._pf")
    return first.select(by, F.when(F.col("x._pc").isNull(), F.col(f"x.{freq}")).otherwise(F.col("x._pf") + cut * (level - F.col("x._pc")) / (F.col("x._c") - F.col("x._pc"))).alias("edge"))
