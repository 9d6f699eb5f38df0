"""Intake of texts: takes the documents of new files, groups copies, deals groups to splits, and keeps a manifest and its summary.

    python -m jobs.intake --data DOCUMENTS --out FOLDER --checkpoint FOLDER [--config jobs/intake.json]

DOCUMENTS is a folder of Parquet files of doc_id, text, lang, source that grows, or a pattern of such paths; each run takes the files that no run before
took, as Spark's file stream notes in the checkpoint. Writes under FOLDER

- manifest, by batch and split: doc_id, source, subgroup (the language), text_key (SHA-256 of the text), n_words. Copies of a text share
  a key, and a hash of seed and key gives the split, so copies are in one split however late they come. A doc_id that an earlier batch
  brought is not taken again; of equal ids in a batch the one of the least key is. A null id counts as its text's key, a null text as empty
- summary, by split: documents, distinct texts and words by subgroup, of the whole manifest; the job fails if a text is in two splits

A run that stops anywhere may be started again: the batch that it left is written anew to its own partitions. A run without new files
changes nothing.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import names as N
from brindle.operators import pairing, sampling
from brindle.streaming import stream

from .common import log, main, written

MANIFEST = "doc_id long, source string, subgroup string, text_key string, n_words long, batch long, split string"


def split_of(key: Column, seed: int, shares: dict[str, int]) -> Column:
    """The split of a key: shares are per cent, in their order."""
    if sum(shares.values()) != 100:
        raise ValueError("shares are per cent and add up to 100")
    at, until, out = F.pmod(sampling.stable_seed(F.lit(seed), key), F.lit(100)), 0, F
    for name, share in shares.items():
        until += share
        out = out.when(at < until, F.lit(name))
    return out


def entries(docs: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Documents as the manifest has them; texts are not carried on."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", "source", N.subgroup(F.col("lang")).alias("subgroup"), F.sha2(text, 256).alias("text_key"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"))
    return keyed.withColumn("split", split_of(F.col("text_key"), config["seed"], config["shares"]))


def manifest_of(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{out}/manifest")


def summary(manifest: DataFrame) -> DataFrame:
    """split, subgroup, documents, texts, words: copies are counted together first, so no task gathers the texts of a split."""
    texts = manifest.groupBy("split", "subgroup", "text_key").agg(F.count("*").alias("copies"), F.sum("n_words").alias("words"))
    return texts.groupBy("split", "subgroup").agg(F.sum("copies").alias("documents"), F.count("*").alias("texts"), F.sum("words").alias("words"))


def run(spark: SparkSession, data: str, out: str, checkpoint: str, config: dict[str, Any]) -> DataFrame:
    """The manifest as it stands after the run."""
    spark.createDataFrame([], MANIFEST).write.mode("append").partitionBy("batch", "split").parquet(f"{out}/manifest")  # so that it can be read before it has rows

    def new_entries(batch: DataFrame, number: int) -> DataFrame:
        key = F.coalesce(F.col("doc_id").cast("string"), "text_key").alias("key")
        one = batch.groupBy(key, "doc_id").agg(F.min(F.struct("text_key", "source", "subgroup", "n_words", "split")).alias("x")).select("key", "doc_id", "x.*")
        return pairing.unpaired(one, manifest_of(spark, out).where(F.col("batch") < number).select(key), "key").drop("key")

    found = stream.stream_files(spark, data, spark.read.parquet(data).schema, config["files_a_batch"])
    batches = stream.write_batches(entries(found, config), f"{out}/manifest", checkpoint, ("split",), prepare=new_entries)
    log.info("read %s: %d new rows in %d batches", data, sum(b["numInputRows"] for b in batches), len(batches))
    manifest = manifest_of(spark, out)
    log.info("manifest %s: %d rows", out, manifest.count())
    written(summary(manifest), f"{out}/summary", ["split"])
    leaking = pairing.leaks(manifest, "text_key", "split").count()
    if leaking:
        raise ValueError(f"{leaking} texts are in more than one split")
    return manifest


if __name__ == "__main__":
    main("intake", run, "jobs/intake.json", "data", "out", "checkpoint")
