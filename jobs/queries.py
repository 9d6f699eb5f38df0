"""The jobs as queries: each runs twice into one new folder and tells what stands there then."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.stats import NORMAL, t_values_sql
from brindle.sources.tables import scratch

from . import cv_report, intake


def config_of(name: str) -> dict:
    return json.loads((Path(__file__).parent / f"{name}.json").read_text())


def job1_cv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "cv-report")
    for _ in range(2):
        cv_report.run(spark, sf_dir, out, config_of("cv_report"))
    found = spark.read.parquet(f"{out}/report")
    return found.select("section", "block", "metric", "n", *[F.round(c, 4).alias(c) for c in cv_report.NUMBERS])


def job2_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "intake")  # a pattern, as the table may be a file or a folder, and a stream reads what a pattern matches
    for _ in range(2):
        intake.run(spark, f"{sf_dir}/documents.parque[t]", out, f"{out}/checkpoint", config_of("intake"))
    sums = spark.read.parquet(f"{out}/summary")
    return intake.manifest_of(spark, out).join(sums, ["split", "subgroup"]).select("doc_id", "source", "subgroup", "text_key", "n_words", "split", "documents", "texts", "words")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_cv_report": job1_cv_report, "job2_intake": job2_intake}

HW = f"CASE WHEN n > 1 THEN coalesce(crit, {NORMAL}) * sd / sqrt(n) END"
SQL: dict[str, str] = {
    "job1_cv_report": f"""
WITH l AS (SELECT l_orderkey, sum(l_extendedprice) / 1000 AS pred, sum(l_extendedprice * (1 - l_discount)) / 1000 AS base FROM lineitem GROUP BY 1),
s AS (SELECT pred, base, pred - base AS gain, lower(o_orderstatus) AS subgroup, (year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1 AS age, o_custkey AS subject,
 CAST('0x' || substr(md5('7:' || o_custkey), 1, 8) AS BIGINT) % 5 AS fold FROM orders JOIN l ON l_orderkey = o_orderkey),
b AS (SELECT 'ALL' AS block, * FROM s UNION ALL SELECT subgroup, * FROM s),
u AS (SELECT 'paired' AS section, block, 'gain' AS metric, gain AS v FROM b UNION ALL SELECT 'summary', block, 'pred', pred FROM b UNION ALL SELECT 'summary', block, 'base', base FROM b
 UNION ALL SELECT 'age', block, 'bin ' || CASE WHEN age < 24 THEN 0 WHEN age < 48 THEN 1 ELSE 2 END, gain FROM b WHERE age BETWEEN 0 AND 96
 UNION ALL SELECT 'fold', 'fold ' || fold, 'gain', gain FROM s),
g AS (SELECT section, block, metric, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd, quantile_cont(v, 0.5) AS median, min(v) AS low, max(v) AS high FROM u GROUP BY 1, 2, 3),
r AS (SELECT section, block, metric, n, round(mean, 4) AS mean, CASE WHEN section <> 'fold' THEN round(sd, 4) END AS sd, CASE WHEN section = 'summary' THEN round(median, 4) END AS median,
 CASE WHEN section = 'summary' THEN round(low, 4) END AS low, CASE WHEN section = 'summary' THEN round(high, 4) END AS high, CASE WHEN section <> 'fold' THEN round({HW}, 4) END AS hw FROM g LEFT JOIN {t_values_sql()} ON n - 1 = df)
SELECT * FROM r UNION ALL SELECT 'leaks', 'ALL', 'subjects', (SELECT count(*) FROM (SELECT subject FROM s GROUP BY 1 HAVING count(DISTINCT fold) > 1)), NULL, NULL, NULL, NULL, NULL, NULL""",
    "job2_intake": r"""
WITH d AS (SELECT doc_id, source, coalesce(nullif(lower(lang), ''), 'unknown') AS subgroup, sha256(coalesce(text, '')) AS text_key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_words FROM documents),
k AS (SELECT *, CAST('0x' || substr(md5('11:' || text_key), 1, 8) AS BIGINT) % 100 AS draw FROM d),
m AS (SELECT doc_id, source, subgroup, text_key, n_words, CASE WHEN draw < 80 THEN 'train' WHEN draw < 90 THEN 'val' ELSE 'test' END AS split FROM k),
s AS (SELECT split, subgroup, count(*) AS documents, count(DISTINCT text_key) AS texts, CAST(sum(n_words) AS BIGINT) AS words FROM m GROUP BY 1, 2)
SELECT m.doc_id, m.source, m.subgroup, m.text_key, m.n_words, m.split, s.documents, s.texts, s.words FROM m JOIN s ON s.split = m.split AND s.subgroup = m.subgroup""",
}
