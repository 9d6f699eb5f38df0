"""Sinks and scans of metric tables, folds, logs and lists, and the index of a folder's volumes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import natural_key
from ..operators.ordering import shared_folder
from .volume import list_files


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_metrics(df: DataFrame, path: str, lead: list[str], metrics: list[str], by: str | None = None, decimals: int | None = None) -> None:
    """CSV with a header: the lead columns first, then the metrics, with so many decimals if that is told; a folder of its own for each value of by."""
    told = [F.col(m) if decimals is None else with_decimals(F.col(m), decimals).alias(m) for m in metrics]
    ordered = df.select(*([F.col(by).alias("fold_dir")] if by else []), *lead, *told)
    writer = ordered.write.mode("overwrite").option("header", True).option("nanValue", "nan")
    (writer.partitionBy("fold_dir") if by else writer).csv(path)


def with_decimals(c: Column, decimals: int) -> Column:
    """A number as text with so many decimals, half rounded up; nan and the infinities as words, null as null."""
    d = c.cast("double")
    return F.when(F.isnan(d), "nan").when(d == float("inf"), "inf").when(d == float("-inf"), "-inf").when(d.isNotNull(), F.format_string(f"%.{decimals}f", d))


def picked(df: DataFrame, lead: list[str], left_out: tuple[str, ...] = ("_src",)) -> DataFrame:
    """The lead columns that df has, in their order, then the others by name."""
    first = [c for c in lead if c in df.columns]
    return df.select(*first, *sorted(c for c in df.columns if c not in first and c not in left_out))


def write_folds(assigned: DataFrame, path: str) -> None:
    """Lines of JSON (split, stem) in a folder for each fold, by split and stem, of rows (fold, split, stem); no row or task holds a fold."""
    lines = assigned.select("fold", "split", "stem").repartitionByRange("fold", "split", "stem").sortWithinPartitions("fold", "split", "stem")
    lines.write.mode("overwrite").partitionBy("fold").json(path)


def read_fold_lines(spark: SparkSession, path: str) -> DataFrame:
    """fold, split, stem of what write_folds wrote."""
    return spark.read.schema("split string, stem string, fold string").json(path).select("fold", "split", "stem")


def append_log(df: DataFrame, path: str) -> None:
    """Adds rows to a log of JSON lines; what is there stays."""
    df.write.mode("append").json(path)


def discover(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Paths of the files of a name one folder below root; if there is none, of those at any depth."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root).select("path")
    below = F.size(F.split("path", "/")) - F.size(F.split(F.lit(root.rstrip("/").split(":")[-1].replace("//", "/")), "/"))
    deep = found.withColumn("depth", below)
    near = F.broadcast(deep.agg(F.count_if(F.col("depth") == 2).alias("near")))  # one row
    return deep.crossJoin(near).where((F.col("near") == 0) | (F.col("depth") == 2)).select("path")


def index_names(files: DataFrame) -> DataFrame:
    """stem, path, copies: of files (path, stem) one path a stem, the last by path; copies tells how many there are."""
    return files.groupBy("stem").agg(F.max("path").alias("path"), F.count("*").alias("copies"))


def index_dir(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """index_names of a folder's volumes."""
    return index_names(list_files(spark, folder, recursive))


def natural(df: DataFrame, column: str = "stem") -> DataFrame:
    return df.orderBy(natural_key(F.col(column)), column)


def resolved(stem: Column, fold: Column, mode: str, root: str) -> Column:
    """Where a volume of a mode lies: root/mode/stem.nii.gz, for predictions root/fold/mode/stem.nii.gz."""
    parts = [F.lit(root), *([fold] if mode == "prediction" else []), F.lit(mode), F.concat(stem, F.lit(".nii.gz"))]
    return F.concat_ws("/", *parts)


def resolved_triples(stem: Column, fold: Column, root: str) -> Column:
    """The three paths of a volume: prediction, input and target."""
    return F.struct(*[resolved(stem, fold, mode, root).alias(mode) for mode in ("prediction", "input", "target")])


def whole_triples(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted (stem, paths as resolved_triples gives) with missing: the first of prediction, input, target whose path is not in files
    (path), null if all three are there."""
    each = wanted.select("stem", F.explode(F.array(*[F.struct(F.lit(k).alias("nth"), F.lit(m).alias("mode"), F.col(f"paths.{m}").alias("path")) for k, m in enumerate(("prediction", "input", "target"))])).alias("p")).select("stem", "p.*")
    lost = each.join(files.select("path").distinct(), "path", "left_anti").groupBy("stem").agg(F.min_by("mode", "nth").alias("missing"))
    return wanted.join(lost, "stem", "left")


def exemplars(df: DataFrame, by: str, name: str, n: int) -> DataFrame:
    """by, rows, first (array): how many rows a group has and its first n distinct names; a task passes on n a group, not all."""
    merge = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("some")))), 1, n)
    part = df.groupBy(by, F.pmod(F.xxhash64(name), F.lit(64)).alias("cell"), name).agg(F.count("*").alias("c"))
    w = Window.partitionBy(by, "cell").orderBy(name)
    cells = part.withColumn("k", F.row_number().over(w)).groupBy(by, "cell").agg(F.sum("c").alias("rows"), F.collect_list(F.when(F.col("k") <= n, F.col(name))).alias("some"))
    return cells.groupBy(by).agg(F.sum("rows").alias("rows"), merge.alias("first"))


def stamped(assigned: DataFrame, level: str, leaks: DataFrame) -> DataFrame:
    """One row that states how a split was made safe: its level, rows, groups and how many groups leak."""
    made = assigned.agg(F.count("*").alias("rows"), F.countDistinct("group").alias("groups"))
    return made.crossJoin(F.broadcast(leaks.agg(F.count("*").alias("leaks")))).select(F.lit(level).alias("level"), "rows", "groups", "leaks", (F.col("leaks") == 0).alias("safe"))  # one row
