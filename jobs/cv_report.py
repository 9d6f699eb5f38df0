"""Cross-validation report: deals subjects to folds, scores their volumes and reports gains with 95 % intervals.

    python -m jobs.cv_report --data TABLES --out FOLDER [--config jobs/cv_report.json]

Reads orders (a volume each, of a customer, the subject) and lineitem (measurements of volumes) from the folder TABLES. Writes
under FOLDER, so that a rerun replaces what it wrote and gives the same:

- scores, by fold: stem, subject, subgroup, age, pred, base. All volumes of a subject are in one fold, by a hash of seed and subject
- report, by section: paired gains by block, summaries of both scores, gains by age (withheld below six aged volumes), means by fold,
  and the count of subjects in more than one fold, which fails the job if there is any
- report_csv: the same as one CSV folder a section, numbers with a fixed count of decimals
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import names as N
from brindle.operators import pairing, sampling
from brindle.operators import summaries as S
from brindle.sources import tables as T

from .common import log, main, read, written

NUMBERS = ("mean", "sd", "median", "low", "high", "hw")
COLUMNS = ("section", "block", "metric", "n", *NUMBERS)


def fold_of(subject: Column, seed: int, folds: int) -> Column:
    return F.pmod(sampling.stable_seed(F.lit(seed), subject), F.lit(folds)).cast("int")


def scores(orders: DataFrame, lines: DataFrame, config: dict[str, Any]) -> DataFrame:
    """fold, stem, subject, subgroup, age, pred, base: the volumes that have measurements, each once."""
    price = F.col("l_extendedprice")
    measured = lines.groupBy("l_orderkey").agg((F.sum(price) / 1000).alias("pred"), (F.sum(price * (1 - F.col("l_discount"))) / 1000).alias("base"))
    age = (F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate") - 1
    volumes = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.concat_ws("_", "o_custkey", "o_orderkey", age, F.lower("o_orderstatus")).alias("stem"))
    stem = F.col("stem")
    named = volumes.where(N.fault(stem).isNull()).select("l_orderkey", "stem", N.group_key(stem, "subject").alias("subject"), N.subgroup(N.field(stem, 3)).alias("subgroup"), N.age_number(N.field(stem, 2)).alias("age"))
    return named.join(measured, "l_orderkey").select("stem", "subject", "subgroup", "age", "pred", "base", fold_of(F.col("subject"), config["seed"], config["folds"]).alias("fold"))


def section(name: str, rows: DataFrame, block: Column, metric: Column) -> DataFrame:
    """Rows of a part of the report in the columns that all parts have."""
    held = [F.col(c).cast("double").alias(c) if c in rows.columns else F.lit(None).cast("double").alias(c) for c in NUMBERS]
    return rows.select(F.lit(name).alias("section"), block.cast("string").alias("block"), metric.cast("string").alias("metric"), F.col("n").cast("long").alias("n"), *held)


def report(scored: DataFrame, config: dict[str, Any]) -> DataFrame:
    pred, base, block = F.col("pred"), F.col("base"), F.col("block")
    gains = S.paired(scored, "subgroup", pred, base)
    aged = S.by_age(scored, "subgroup", "age", config["age_edges"], pred, base)
    folds = scored.groupBy("fold").agg(F.count("*").alias("n"), F.avg(pred - base).alias("mean"))
    leaks = pairing.leaks(scored, "subject", "fold").agg(F.count("*").alias("n"))
    parts = [
        section("paired", gains, block, F.lit("gain")),
        section("summary", S.cv_summary(scored, "subgroup", ["pred", "base"]), block, F.col("metric")),
        section("age", aged.withColumnRenamed("delta", "mean"), block, F.concat(F.lit("bin "), "bin")),
        section("fold", folds, F.concat(F.lit("fold "), "fold"), F.lit("gain")),
        section("leaks", leaks, F.lit("ALL"), F.lit("subjects")),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


def run(spark: SparkSession, data: str, out: str, config: dict[str, Any]) -> DataFrame:
    """The report, as it was written."""
    orders = read(spark, f"{data}/orders.parquet", "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    lines = read(spark, f"{data}/lineitem.parquet", "l_orderkey", "l_extendedprice", "l_discount")
    scored = written(scores(orders, lines, config), f"{out}/scores", ["fold"])
    found = written(report(scored, config), f"{out}/report", ["section"])
    T.write_metrics(found, f"{out}/report_csv", ["block", "metric", "n"], list(NUMBERS), by="section", decimals=config["decimals"])
    log.info("wrote %s/report_csv", out)
    leaking = found.where("section = 'leaks'").first()["n"]
    if leaking:
        raise ValueError(f"{leaking} subjects are in more than one fold")
    return found


if __name__ == "__main__":
    main("cv_report", run, "jobs/cv_report.json", "data", "out")
