"""What the jobs share: their command line, config and log."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def written(df: DataFrame, path: str, by: list[str]) -> DataFrame:
    """Writes Parquet partitioned by some columns and reads it back; partitions that are written again are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    found = df.sparkSession.read.schema(df.select(*[c for c in df.columns if c not in by], *by).schema).parquet(path)
    log.info("wrote %s: %d rows, by %s", path, found.count(), ", ".join(by))
    return found


def read(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Columns of a table of Parquet files."""
    df = spark.read.parquet(path).select(*columns)
    log.info("read %s: %d rows", path, df.count())
    return df


def main(name: str, run: Callable[..., Any], config: str, *paths: str) -> None:
    """Runs a job from the command line, in a session of its own: --config, and a path for each of paths."""
    p = argparse.ArgumentParser(prog=f"python -m jobs.{name}")
    p.add_argument("--config", default=config)
    for x in paths:
        p.add_argument(f"--{x}", required=True)
    given = vars(p.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    with open(given.pop("config")) as f:
        settings = json.load(f)
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, **given, config=settings)
    finally:
        spark.stop()
