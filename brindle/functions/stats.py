"""Finite values, Student's t and intervals."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Degrees of freedom with an own critical value; beyond, the normal one is used.
MOST_DF, NORMAL = 1000, 1.96


def finite(c: Column) -> Column:
    """Null for NaN and the infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def _t_tail(t: float, df: int) -> float:
    """P(|T| > t) by the continued fraction of the incomplete beta function."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - math.log(a) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_fraction(1 - x, b, a) * math.exp(b * math.log1p(-x) + a * math.log(x) - math.log(b) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)))
    return front * _beta_fraction(x, a, b)


def _beta_fraction(x: float, a: float, b: float) -> float:
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-30)
    h = d
    for m in range(1, 300):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + n * d) or 1e-30)
            c = (1 + n / c) or 1e-30
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


@lru_cache(maxsize=None)
def t_critical(df: int) -> float:
    """The two-sided 95 % value of Student's t."""
    low, high = 1.0, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if _t_tail(mid, df) > 0.05 else (low, mid)
    return round(low, 9)


def t_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d, t_critical(d)) for d in range(1, MOST_DF + 1)], "df long, crit double")


def t_values_sql() -> str:
    return "(VALUES " + ",".join(f"({d},{t_critical(d)!r})" for d in range(1, MOST_DF + 1)) + ") t(df, crit)"


def with_interval(df: DataFrame) -> DataFrame:
    """Adds hw, the half-width of the 95 % interval of the mean, to a table with n and sd; null for n < 2."""
    t = F.broadcast(t_table(df.sparkSession))  # MOST_DF rows
    hw = F.when(F.col("n") > 1, F.coalesce("crit", F.lit(NORMAL)) * F.col("sd") / F.sqrt("n"))
    return df.join(t, F.col("n") - 1 == F.col("df"), "left").withColumn("hw", hw).drop("df", "crit")
