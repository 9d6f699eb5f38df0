"""Quantiles over value counts, blocks by grouping sets, the table by age, and settings of streams."""

import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import summaries as S


def test_quantiles_against_numpy(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), r.choice([1.0, 1.0, 1.0, 2.5, -3.0, None, r.random()])) for _ in range(500)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for share in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = {x["g"]: x["q"] for x in S.quantiles(df, ["g"], "v", share, "q").collect()}
        want = {g: np.quantile([v for h, v in rows if h == g and v is not None], share) for g in ("a", "b", None, "one")}
        assert got == pytest.approx(want)
        assert S.quantiles(df, [], "v", share, "q").first()["q"] == pytest.approx(np.quantile([v for _, v in rows if v is not None], share))


def test_ties_are_one_row(spark, monkeypatch):
    """One value in nine tenths of the rows: what is put in order are distinct values, whatever their times."""
    df = spark.range(20_000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 10 > 0, 7.0).otherwise(F.col("id") % 100).cast("double").alias("v"))
    seen, real = [], S.in_order
    monkeypatch.setattr(S, "in_order", lambda rows, *a: (seen.append(rows.count()), real(rows, *a))[1])
    got = {r["g"]: r["median"] for r in S.quantiles(df, ["g"], "v").collect()}
    rows = df.collect()
    assert seen[0] <= 2 * 11
    assert got == {g: median([x["v"] for x in rows if x["g"] == g]) for g in (0, 1)}


def test_blocks(spark):
    rows = [("a", 1.0, 2.0), ("b", 3.0, 1.0), (None, 5.0, 4.0), ("a", None, 1.0)]
    df = spark.createDataFrame(rows, "s string, x double, y double")
    got = {(r["block"], r["n"]) for r in S.in_blocks(df, "s", [], F.count("x").alias("n")).collect()}
    assert got == {("ALL", 3), ("a", 1), ("b", 1), (None, 1)}
    assert [r["block"] for r in S.in_blocks(df.where("s = 'a'"), "s", [], F.count("x").alias("n")).collect()] == ["ALL"]
    assert S.in_blocks(df.limit(0), "s", [], F.count("x").alias("n")).collect() == []
    long = S.cv_summary(df, "s", ["x", "y"]).collect()
    assert {(r["block"], r["metric"]): r["median"] for r in long}[("ALL", "y")] == 1.5


def test_table_by_age_needs_six_aged_rows(spark):
    rows = [(s, float(a), 2.0, 1.0) for s, a in zip("ababa", (1, 2, 3, 11, 12))] + [("a", float("nan"), 2.0, 1.0), ("a", 5.0, 2.0, float("nan"))]
    df = spark.createDataFrame(rows, "s string, age double, pred double, base double")
    table = lambda d: S.by_age(d, "s", "age", [0, 10, 20], F.col("pred"), F.col("base"))
    assert table(df).collect() == []
    one_more = df.union(spark.createDataFrame([("b", 4.0, 9.0, 1.0)], df.schema))
    assert {(r["bin"], r["block"]): r["n"] for r in table(one_more).collect()} == {(0, "ALL"): 4, (0, "a"): 2, (0, "b"): 2, (1, "ALL"): 2, (1, "a"): 1, (1, "b"): 1}
