"""Queries over metric rows: line items stand for volumes, prices before and after discount for two methods' scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.stats import NORMAL, finite, t_values_sql, with_interval
from ..operators import summaries as S
from ..operators.ordering import in_order
from .catalogue import query, table

ROWS = "m AS (SELECT l_orderkey, l_linenumber, l_returnflag AS subgroup, l_orderkey % 5 AS fold, l_suppkey AS supplier, l_extendedprice / 1000 AS pred, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice * (1 - l_discount) / 1000 END AS sinc, l_quantity AS age FROM lineitem)"
BLOCKS = ", b AS (SELECT 'ALL' AS block, * FROM m UNION ALL SELECT subgroup, * FROM m)"
T = f" LEFT JOIN {t_values_sql()} ON n - 1 = df"
HW = f"CASE WHEN n > 1 THEN coalesce(crit, {NORMAL}) * sd / sqrt(n) END"


def rows(spark, sf):
    price, cut = F.col("l_extendedprice"), F.col("l_discount")
    sinc = F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(price * (1 - cut) / 1000)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("subgroup"), F.pmod("l_orderkey", F.lit(5)).alias("fold"), F.col("l_suppkey").alias("supplier"), (price / 1000).alias("pred"), sinc.alias("sinc"), F.col("l_quantity").alias("age"))


def rounded(df, *names, digits=5):
    return df.withColumns({c: F.round(c, digits) for c in names})


@query("finite_filter", "WITH " + ROWS + " SELECT count(*) AS n, count(sinc) AS finite FROM m")
def _(spark, sf):
    return rows(spark, sf).agg(F.count("*").alias("n"), F.count(finite(F.col("sinc"))).alias("finite"))


@query("ci95", "WITH " + ROWS + ", g AS (SELECT supplier, count(sinc) AS n, avg(sinc) AS mean, stddev_samp(sinc) AS sd FROM m GROUP BY 1) SELECT supplier, n, round(mean, 5) AS mean, round(sd, 5) AS sd, round(" + HW + ", 5) AS hw FROM g" + T)
def _(spark, sf):
    """Of each supplier's rows: groups of some hundred, so Student's t counts."""
    g = rows(spark, sf).withColumn("v", finite(F.col("sinc"))).groupBy("supplier").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    return rounded(with_interval(g), "mean", "sd", "hw")


@query("ci95_all", "WITH " + ROWS + ", g AS (SELECT fold, subgroup, count(sinc) AS n, avg(sinc) AS mean, stddev_samp(sinc) AS sd FROM m GROUP BY 1, 2) SELECT fold, subgroup, n, round(mean, 5) AS mean, round(sd, 5) AS sd, round(" + HW + ", 5) AS hw FROM g" + T)
def _(spark, sf):
    g = rows(spark, sf).withColumn("v", finite(F.col("sinc"))).groupBy("fold", "subgroup").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    return rounded(with_interval(g), "mean", "sd", "hw")


@query("paired_delta", "WITH " + ROWS + ", g AS (SELECT fold, count(*) AS n, avg(pred - sinc) AS mean, stddev_samp(pred - sinc) AS sd FROM m WHERE sinc IS NOT NULL GROUP BY 1) SELECT fold, n, round(mean, 5) AS mean, round(" + HW + ", 6) AS hw FROM g" + T)
def _(spark, sf):
    d = rows(spark, sf).withColumn("d", finite(F.col("pred")) - finite(F.col("sinc"))).where("d is not null")
    g = with_interval(d.groupBy("fold").agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd")))
    return g.select("fold", "n", F.round("mean", 5).alias("mean"), F.round("hw", 6).alias("hw"))


@query("cv_summary", "WITH " + ROWS + BLOCKS + ", u AS (SELECT block, 'pred' AS metric, pred AS v FROM b UNION ALL SELECT block, 'sinc', sinc FROM b WHERE sinc IS NOT NULL), g AS (SELECT block, metric, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd, quantile_cont(v, 0.5) AS median, min(v) AS low, max(v) AS high FROM u GROUP BY 1, 2) SELECT block, metric, n, round(mean, 5) AS mean, round(sd, 5) AS sd, round(median, 7) AS median, round(low, 5) AS low, round(high, 5) AS high, round(" + HW + ", 5) AS hw FROM g" + T)
def _(spark, sf):
    t = S.cv_summary(rows(spark, sf), "subgroup", ["pred", "sinc"])
    return rounded(rounded(t, "mean", "sd", "low", "high", "hw"), "median", digits=7)


@query("eval_summary", "WITH " + ROWS + BLOCKS + " SELECT block, count(*) AS n, round(avg(pred), 5) AS mean, round(stddev_pop(pred), 5) AS sd, round(quantile_cont(pred, 0.5), 7) AS median FROM b GROUP BY 1")
def _(spark, sf):
    t = S.describe_blocks(rows(spark, sf), "subgroup", [], "pred", "pop")
    return rounded(rounded(t.select("block", "n", "mean", "sd", "median"), "mean", "sd"), "median", digits=7)


@query("eval_low_headroom", "WITH " + ROWS + ", f AS (SELECT *, sinc > 60 AS low FROM m) SELECT block, count(*) AS n, round(avg(pred), 5) AS mean FROM (SELECT 'ALL' AS block, * FROM f UNION ALL SELECT subgroup, * FROM f UNION ALL SELECT 'LOW_HEADROOM', * FROM f WHERE low UNION ALL SELECT 'HEADROOM', * FROM f WHERE NOT coalesce(low, false)) GROUP BY 1")
def _(spark, sf):
    """Besides the blocks: the rows that were marked to have little to gain, and the rest, where any is marked."""
    r = rows(spark, sf).withColumn("low", F.coalesce(finite(F.col("sinc")) > 60, F.lit(False)))
    marked = r.withColumn("block", F.when(F.col("low"), "LOW_HEADROOM").otherwise("HEADROOM")).where(F.lit(not r.where("low").isEmpty()))
    every = S.blocks(r, "subgroup").unionByName(marked)
    return every.groupBy("block").agg(F.count("*").alias("n"), F.round(F.avg("pred"), 5).alias("mean"))


@query("age_table_wanted", "WITH " + ROWS + " SELECT fold, count(age) FILTER (age > 45) AS aged, count(age) FILTER (age > 45) >= 6 AS wanted FROM m GROUP BY 1")
def _(spark, sf):
    """A table by age is made of six aged rows or more."""
    return rows(spark, sf).groupBy("fold").agg(F.count_if(F.col("age") > 45).alias("aged")).withColumn("wanted", F.col("aged") >= S.LEAST_AGED)


@query("cv_paired", "WITH " + ROWS + BLOCKS + ", g AS (SELECT block, count(*) AS n, avg(pred - sinc) AS mean, stddev_samp(pred - sinc) AS sd FROM b WHERE sinc IS NOT NULL GROUP BY 1) SELECT block, n, round(mean, 5) AS mean, round(" + HW + ", 6) AS hw, mean - " + HW + " <= 0 AND mean + " + HW + " > 0 AS includes_zero FROM g" + T)
def _(spark, sf):
    t = S.paired(rows(spark, sf), "subgroup", F.col("pred"), F.col("sinc"))
    return t.select("block", "n", F.round("mean", 5).alias("mean"), F.round("hw", 6).alias("hw"), "includes_zero")


@query("age_bins_fixed", "WITH " + ROWS + " SELECT CASE WHEN age < 10 THEN 0 WHEN age < 25 THEN 1 WHEN age <= 50 THEN 2 END AS bin, count(*) AS n FROM m GROUP BY 1")
def _(spark, sf):
    return rows(spark, sf).groupBy(S.in_bins(F.col("age"), [0, 10, 25, 50]).alias("bin")).agg(F.count("*").alias("n"))


@query("cv_by_age", "WITH " + ROWS + BLOCKS + ", g AS (SELECT CASE WHEN age < 10 THEN 0 WHEN age < 25 THEN 1 ELSE 2 END AS bin, block, count(*) AS n, avg(pred) AS pred, avg(pred - sinc) AS mean, stddev_samp(pred - sinc) AS sd FROM b WHERE sinc IS NOT NULL GROUP BY 1, 2) SELECT bin, block, n, round(pred, 5) AS pred, round(mean, 5) AS delta, round(" + HW + ", 6) AS hw FROM g" + T)
def _(spark, sf):
    g = S.by_age(rows(spark, sf), "subgroup", "age", [0, 10, 25, 50], F.col("pred"), F.col("sinc"))
    return g.select("bin", "block", "n", F.round("pred", 5).alias("pred"), F.round("delta", 5).alias("delta"), F.round("hw", 6).alias("hw"))


@query("fold_spread", "WITH " + ROWS + " SELECT fold, count(*) AS n, round(avg(pred), 5) AS mean FROM m GROUP BY 1")
def _(spark, sf):
    return rows(spark, sf).groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg("pred"), 5).alias("mean"))


@query("win_count", "WITH " + ROWS + BLOCKS + " SELECT block, count(*) AS n, round(min(pred - sinc), 5) AS least, round(max(pred - sinc), 5) AS most, count(*) FILTER (pred - sinc > 1) AS wins FROM b WHERE sinc IS NOT NULL GROUP BY 1")
def _(spark, sf):
    d = rows(spark, sf).withColumn("d", F.col("pred") - finite(F.col("sinc"))).where("d is not null")
    return S.blocks(d, "subgroup").groupBy("block").agg(F.count("*").alias("n"), F.round(F.min("d"), 5).alias("least"), F.round(F.max("d"), 5).alias("most"), F.count_if(F.col("d") > 1).alias("wins"))


@query("dup_across_folds", "SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT l_suppkey % 4) AS folds FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf):
    x = table(spark, sf, "lineitem").withColumn("f", F.pmod("l_suppkey", F.lit(4)))
    return x.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.size(F.collect_set("f")).cast("long").alias("folds")).where("n > 1")


@query("audit_by_weighting", "SELECT l_returnflag AS weighting, count(*) AS n, quantile_cont(l_discount, 0.5) AS mid, min(l_discount) AS low, max(l_discount) AS high, count(*) FILTER (l_discount < 0.02) AS flagged FROM lineitem GROUP BY 1")
def _(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("weighting"), "l_discount")
    g = x.groupBy("weighting").agg(F.count("*").alias("n"), F.min("l_discount").alias("low"), F.max("l_discount").alias("high"), F.count_if(F.col("l_discount") < 0.02).alias("flagged"))
    return S.with_quantile(g, S.quantiles(x, ["weighting"], "l_discount", name="mid"), ["weighting"])


@query("audit_measured", "WITH x AS (SELECT l_returnflag AS weighting, l_discount AS hf, CASE WHEN l_linenumber % 3 > 0 THEN l_quantity END AS db FROM lineitem) SELECT weighting, count(*) AS n, quantile_cont(hf, 0.5) AS median, min(hf) AS low, max(hf) AS high, count(*) FILTER (db >= 39) AS flagged, count(db) AS db_n, quantile_cont(db, 0.5) AS db_median, min(db) AS db_low, max(db) AS db_high FROM x GROUP BY 1")
def _(spark, sf):
    """Quantities of some lines stand for measured decibels, by which they are flagged."""
    db = F.when(F.col("l_linenumber") % 3 > 0, F.col("l_quantity")).otherwise(F.lit(float("nan")))
    x = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("weighting"), F.col("l_discount").alias("hf"), db.alias("db"))
    return S.audit(S.flag_low(x, "db", "hf", 39.0, 0.5), "weighting", "hf", "db")


@query("headroom_spread", "SELECT quantile_cont(p_retailprice, 0.5) AS median, round(max(p_retailprice) / greatest(min(p_retailprice), 1e-12), 6) AS spread, max(p_retailprice) / greatest(min(p_retailprice), 1e-12) > 3 AS wide FROM part")
def _(spark, sf):
    ratio = F.max("p_retailprice") / F.greatest(F.min("p_retailprice"), F.lit(1e-12))
    p = table(spark, sf, "part")
    return p.agg(F.round(ratio, 6).alias("spread"), (ratio > 3).alias("wide")).join(F.broadcast(S.quantiles(p, [], "p_retailprice")), how="left")  # one row each


@query("flag_low_headroom", "SELECT s_suppkey, CASE WHEN s_acctbal < 0.5 * greatest((SELECT quantile_cont(s_acctbal, 0.5) FROM supplier), 1e-12) THEN 'LOW' ELSE '' END AS flag FROM supplier")
def _(spark, sf):
    s = table(spark, sf, "supplier").withColumn("db", F.lit(float("nan")))
    return S.flag_low(s, "db", "s_acctbal", 39.0, 0.5).select("s_suppkey", "flag")


@query("flag_measured", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 AND s_acctbal / 200 >= 39 THEN 'LOW' ELSE '' END AS flag FROM supplier")
def _(spark, sf):
    """Where any row has a measured value, those that have one are flagged by it and the others are not."""
    s = table(spark, sf, "supplier").withColumn("db", F.when(F.pmod("s_suppkey", F.lit(3)) > 0, F.col("s_acctbal") / 200).otherwise(F.lit(float("nan"))))
    return S.flag_low(s, "db", "s_acctbal", 39.0, 0.5).select("s_suppkey", "flag")


@query("anisotropy_flag", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax <= l_discount AND l_tax <= l_quantity THEN 'x' WHEN l_discount <= l_quantity THEN 'y' ELSE 'z' END AS axis, round(greatest(l_tax, l_discount, l_quantity) / least(l_tax, l_discount, l_quantity), 6) AS ratio FROM lineitem WHERE least(l_tax, l_discount, l_quantity) > 0 AND greatest(l_tax, l_discount, l_quantity) / least(l_tax, l_discount, l_quantity) >= 1.5")
def _(spark, sf):
    a = F.array("l_tax", "l_discount", "l_quantity")
    ratio = F.array_max(a) / F.array_min(a)
    axis = F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.array_position(a, F.array_min(a)).cast("int"))
    return table(spark, sf, "lineitem").where((F.array_min(a) > 0) & (F.array_max(a) / F.greatest(F.array_min(a), F.lit(1e-300)) >= 1.5)).select("l_orderkey", "l_linenumber", axis.alias("axis"), F.round(ratio, 6).alias("ratio"))


@query("audit_sorted", "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC NULLS LAST, s_suppkey) AS place FROM supplier")
def _(spark, sf):
    worst_first = [finite(F.col("s_acctbal")).desc_nulls_last(), F.col("s_suppkey")]
    return in_order(table(spark, sf, "supplier"), worst_first, "place").select("s_suppkey", (F.col("place") + 1).alias("place"))


@query("arg_best", "SELECT c_nationkey, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS most, arg_min(c_custkey, (c_acctbal, c_custkey)) AS least FROM customer GROUP BY 1")
def _(spark, sf):
    """The first customer of the best balance and of the least."""
    first = lambda sign: F.struct("c_acctbal", sign * F.col("c_custkey"))
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.max_by("c_custkey", first(-1)).alias("most"), F.min_by("c_custkey", first(1)).alias("least"))


@query("share_of_total", "SELECT event_type, round(sum(value) / (SELECT sum(value) FROM events), 7) AS share FROM events GROUP BY 1")
def _(spark, sf):
    g = table(spark, sf, "events").groupBy("event_type").agg(F.sum("value").alias("v"))
    return g.select("event_type", F.round(F.col("v") / F.sum("v").over(Window.partitionBy()), 7).alias("share"))


@query("best_so_far", "SELECT event_id, coalesce(value > max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM events")
def _(spark, sf):
    return S.best_so_far(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", "is_best")


@query("cum_fraction_f99", "WITH c AS (SELECT user_id, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY event_id) / sum(value) OVER (PARTITION BY user_id) AS c FROM events WHERE value > 0), l AS (SELECT *, lag(c) OVER (PARTITION BY user_id ORDER BY event_id) AS pc, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS pf FROM c), f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM l WHERE c >= 0.9) SELECT user_id, round(CASE WHEN pc IS NULL THEN event_id ELSE pf + (event_id - pf) * (0.9 - pc) / (c - pc) END, 3) AS edge FROM f WHERE r = 1")
def _(spark, sf):
    return S.cumulative_edge(table(spark, sf, "events").where("value > 0"), "user_id", "event_id", "value", 0.9).select("user_id", F.round("edge", 3).alias("edge"))


@query("power_edge", "WITH r AS (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) AS n, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN 0 ELSE value END AS p FROM events WHERE value > 0 AND (user_id % 3 > 0 OR event_id % 40 = 0)), c AS (SELECT user_id, event_id, sum(p) OVER (PARTITION BY user_id ORDER BY event_id) / sum(p) OVER (PARTITION BY user_id) AS c FROM r WHERE n >= 3), l AS (SELECT *, lag(c) OVER (PARTITION BY user_id ORDER BY event_id) AS pc, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS pf FROM c), f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM l WHERE c >= 0.9) SELECT user_id, round(coalesce(pf + (event_id - pf) * (0.9 - pc) / (c - pc), -1), 3) AS edge FROM (SELECT DISTINCT user_id FROM r) u LEFT JOIN (SELECT * FROM f WHERE k = 1) g USING (user_id)")
def _(spark, sf):
    """Users stand for spectra, events for bins; -1 where there is no edge."""
    e = table(spark, sf, "events").where("value > 0 and (user_id % 3 > 0 or event_id % 40 = 0)")
    return S.power_edge(e, "user_id", "event_id", "value", 0.9).select("user_id", F.round(F.nanvl("edge", F.lit(-1.0)), 3).alias("edge"))


@query("epoch_losses", "SELECT CAST(user_id AS BIGINT) % 10 AS epoch, count(*) AS n, round(avg(value), 6) AS loss FROM events GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "events").groupBy(F.pmod("user_id", F.lit(10)).alias("epoch")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("loss"))


@query("lr_schedule", "SELECT e.i AS epoch, 1 - greatest(0, e.i + 1 + 1 - 50) / 51.0 AS factor, 10.0 / 150 * e.i AS lambda FROM range(100) e(i)")
def _(spark, sf):
    e = spark.range(100).withColumnRenamed("id", "epoch")
    return e.select("epoch", (1 - F.greatest(F.lit(0), F.col("epoch") + 2 - 50) / 51.0).alias("factor"), (10.0 / 150 * F.col("epoch")).alias("lambda"))


@query("read_rows_typed", "SELECT event_id, TRY_CAST(CASE event_id % 4 WHEN 0 THEN 'abc' WHEN 1 THEN '' ELSE CAST(user_id AS VARCHAR) END AS DOUBLE) AS metric, CASE event_id % 3 WHEN 0 THEN 'unknown' ELSE event_type END AS subgroup FROM events")
def _(spark, sf):
    k = F.col("event_id")
    raw = table(spark, sf, "events").select("event_id", F.when(k % 4 == 0, "abc").when(k % 4 == 1, "").otherwise(F.col("user_id").cast("string")).alias("metric"), F.when(k % 3 == 0, "").otherwise(F.col("event_type")).alias("subgroup"))
    return raw.select("event_id", finite(F.col("metric").try_cast("double")).alias("metric"), F.coalesce(F.nullif("subgroup", F.lit("")), F.lit("unknown")).alias("subgroup"))
