"""Quality by importance resampling (Xie et al., "Data Selection for Language Models via Importance Resampling", 2023).

A generative model of hashed n-grams is estimated from target texts and one from all raw texts. A document's
weight is the ratio of its likelihoods; documents are sampled by weight without replacement through Gumbel top-k: the k largest sums of
log weight and Gumbel noise.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, beside, keep, let_go, table, tidy, unit_interval

#: Hash buckets of unigrams and bigrams; most labelled rows that the target model is estimated from, by hash of doc_id.
BUCKETS, MOST_TARGET = 10_000, 20_000
#: A document counts as wanted where raw text explains it better by a log likelihood ratio below this.
TOLERANCE = 3.0
#: n-grams of raw text that the target model starts from: a small target sample deviates little from raw text.
PRIOR = 20.0 * BUCKETS
MOST_TOKENS = 200_000

_TOKEN = re.compile(r"\w+|[^\w\s]+")


class NGrams:
    """Bucket numbers of a text's unigrams and bigrams: runs of word characters and of other visible characters."""

    def __init__(self) -> None:
        self.known = _Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int64)
        if len(self.known) > MOST_TOKENS:
            self.known.clear()
        h = np.array(list(map(self.known.__getitem__, _TOKEN.findall(text.lower()))), dtype=np.int64)
        return np.concatenate([h % BUCKETS, (h[:-1] * 1_000_003 + h[1:] * 8_191 + 1) % BUCKETS])


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        self[token] = value = zlib.crc32(token.encode())
        return value


def log_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log(target / raw probability) of each bucket, one added to each raw count.

    The raw model counts all rows of docs (doc_id, text); the target model those with quality 1 in labels, at most
    MOST_TARGET of them, besides PRIOR n-grams as raw text has them. Without target rows all ratios are 0.
    """
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_TARGET)
    marked = docs.select("doc_id", "text").join(F.broadcast(good.withColumn("wanted", F.lit(True))), "doc_id", "left")  # MOST_TARGET rows at most

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        grams, raw, target = NGrams(), np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for x in batches:
            for text, wanted in zip(x["text"], x["wanted"]):
                n = np.bincount(grams(text), minlength=BUCKETS)
                raw += n
                if wanted is True:
                    target += n
        yield pd.DataFrame({"bucket": np.arange(BUCKETS), "raw": raw, "target": target})

    counts = batched(marked).mapInPandas(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # BUCKETS rows
    raw, target = np.ones(BUCKETS), np.zeros(BUCKETS)
    raw[counts["bucket"]] += counts["raw"]
    target[counts["bucket"]] += counts["target"]
    raw /= raw.sum()
    if not target.sum():
        return np.zeros(BUCKETS)
    target += PRIOR * raw
    return np.log(target / target.sum()) - np.log(raw)


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 1024) -> float | None:
    """The k-th largest value, by counting in ever narrower bins; None if there are fewer or k is 0."""
    n, low, high = df.agg(F.count(column), F.min(column), F.max(column)).first()
    if k < 1 or n < k:
        return None
    above = 0
    while low < high:
        width = (high - low) / bins
        if low + width <= low or width <= 0:
            break
        number = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        inside = df.where(F.col(column).between(low, high)).groupBy(number.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for r in sorted(inside.collect(), key=lambda r: -r["low"]):  # bins rows at most
            if above + r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            above += r["n"]
    return high


def resample(docs: DataFrame, ratios: np.ndarray, k: int | None = None) -> DataFrame:
    """doc_id, log_weight, sample_key, selected for each row of docs (doc_id, text): the k with the largest key are selected.

    The key is the log weight plus Gumbel noise that depends on doc_id alone, so reruns agree. k is, unless given, the number of documents whose
    log weight is above -TOLERANCE. Null and empty texts have no n-gram and the log weight 0. Rows that
    tie with the k-th are selected too, such as repeats of its doc_id. An empty table gives no rows.
    """

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        grams = NGrams()
        for x in batches:
            yield pd.DataFrame({"doc_id": x["doc_id"], "log_weight": np.array([ratios[grams(t)].sum() for t in x["text"]], dtype=float)})

    weighed = batched(docs.select("doc_id", "text")).mapInPandas(run, "doc_id long, log_weight double")
    noise = -F.log(-F.log(unit_interval("doc_id", F.lit(20240607))))
    keyed = keep(weighed.withColumn("sample_key", F.col("log_weight") + noise), "weights")
    k = keyed.where(F.col("log_weight") > -TOLERANCE).count() if k is None else k
    least = kth_largest(keyed, "sample_key", k)
    if least is None:
        return keyed.withColumn("selected", F.lit(k > 0))
    return keyed.withColumn("selected", F.col("sample_key") >= F.lit(least))


def keep_selected(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """The rows of docs, all columns, that resample selects; a row with a null doc_id goes by the doc_ids that are null."""
    gone = keep(resample(docs, log_ratios(docs, labels), k).where("not selected").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.join(beside(gone), docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return resample(docs, log_ratios(docs, table(spark, sf_dir, "labels")))
