"""Nested JSON documents of folds, manifests and scan sidecars, as rows; a broken one is a row that says so and ends nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import strip_ext

BROKEN = "_broken"
FOLDS = f"folds array<struct<fold: string, train: array<string>, val: array<string>, test: array<string>>>, {BROKEN} string"
MANIFEST = f"splits map<string, array<struct<assigned_name: string, stem: string>>>, {BROKEN} string"
SIDECAR = f"AcquisitionMatrixPE double, ReconMatrixPE double, {BROKEN} string"


def read_documents(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """A row for each document, a file each (lines: a line each), with file, its path, and status: ok, or unreadable with nulls."""
    reader = spark.read.schema(schema).option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN)
    found = reader.json(path).withColumn("file", F.col("_metadata.file_path"))
    return found.withColumn("status", F.when(F.col(BROKEN).isNull(), "ok").otherwise("unreadable")).drop(BROKEN)


def fold_rows(documents: DataFrame) -> DataFrame:
    """file, fold, split, stem of documents read with FOLDS."""
    each = documents.select("file", F.explode("folds").alias("f"))
    parts = F.array(*[F.struct(F.lit(s).alias("split"), F.col(f"f.{s}").alias("stems")) for s in ("train", "val", "test")])
    return each.select("file", "f.fold", F.explode(parts).alias("p")).select("file", "fold", "p.split", F.explode("p.stems").alias("stem"))


def manifest_rows(documents: DataFrame) -> DataFrame:
    """file, split, assigned_name (without extension) and stem (where none is told, the name) of documents read with MANIFEST."""
    each = documents.select("file", F.explode("splits").alias("split", "entries")).select("file", "split", F.explode("entries").alias("e"))
    name = strip_ext(F.coalesce(F.col("e.assigned_name"), F.lit("")))
    return each.select("file", "split", name.alias("assigned_name"), F.coalesce(F.col("e.stem"), name).alias("stem"))


def name_map(manifest: DataFrame, split: str | None = None) -> DataFrame:
    """assigned_name, stem, ambiguous: of one split, or where the manifest lacks it of all together. Numbers begin anew in every split, so then
    a name that several rows have is ambiguous, and the stem of the last split by name is told."""
    known = F.broadcast(manifest.agg(F.coalesce(F.bool_or(F.col("split") == F.lit(split)), F.lit(False)).alias("_known")))  # one row
    taken = manifest.crossJoin(known).where(~F.col("_known") | (F.col("split") == F.lit(split)))
    return taken.groupBy("assigned_name").agg(F.max_by("stem", F.struct("split", "stem")).alias("stem"), ((F.count("*") > 1) & ~F.max("_known")).alias("ambiguous"))


def sidecar_doubts(acquired: Column, rebuilt: Column, status: Column) -> Column:
    """What a sidecar says against a plan to crop zero-filled k-space: unreadable, silent, not_zero_filled, or null for nothing."""
    silent = F.coalesce(acquired, F.lit(0.0)) * F.coalesce(rebuilt, F.lit(0.0)) == 0
    return F.when(status != "ok", "unreadable").when(silent, "silent").when(rebuilt <= acquired, "not_zero_filled")
