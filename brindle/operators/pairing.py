"""Pairing and reconciling inputs with targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import product
from .ordering import in_order, running


def pair_inner(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key)


def unpaired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left whose key is nowhere in right."""
    return left.join(right, key, "left_anti")


def ranked(df: DataFrame, name: str, by: str | None, *order, few: bool = False, hot: bool = False) -> DataFrame:
    """Adds name, the place from 0 in the given order, within the groups of by (None: of all rows, see in_order).

    few: there are few groups, so of any size: rows are placed in the order of all groups, less what lies before their own
    (a table of one row a group, broadcast), and no task holds a group. hot: there are many groups, some of which may be large: the
    rows before a row are counted by ranges (see running)."""
    if by is None:
        return in_order(df, list(order), name)
    if few:
        placed = in_order(df, [by, *order], "_place")
        begins = F.broadcast(placed.groupBy(by).agg(F.min("_place").alias("_begin")))
        return placed.join(begins, placed[by].eqNullSafe(begins[by])).drop(begins[by]).withColumn(name, F.col("_place") - F.col("_begin")).select(*df.columns, name)
    if hot:
        return running(df.withColumn("_one", F.lit(1)), [by], list(order), {name: ("count", "_one")}).drop("_one")
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1).cast("long"))


def pair_by_place(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Full outer join on place; ok tells whether both names are there and equal."""
    return left.join(right, keys, "full_outer").withColumn("ok", F.coalesce(F.col(a) == F.col(b), F.lit(False)))


def resolve(names: DataFrame, manifest: DataFrame) -> DataFrame:
    """The stem that a manifest (split, assigned_name, stem) gives a name of its split, else the name itself."""
    return names.join(manifest, ["split", "assigned_name"], "left").withColumn("stem", F.coalesce("stem", "assigned_name"))


def flagged(df: DataFrame, marks: DataFrame, key: str, name: str) -> DataFrame:
    """Adds a 0/1 column: whether the key is in marks."""
    return df.join(marks.select(key).distinct().withColumn("_m", F.lit(1)), key, "left").withColumn(name, F.coalesce("_m", F.lit(0))).drop("_m")


def first_missing(inputs: DataFrame, targets: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """For each prediction: the first of target and input that its key lacks, null if both are there."""
    t, i = targets.select(key).distinct().withColumn("_t", F.lit(True)), inputs.select(key).distinct().withColumn("_i", F.lit(True))
    both = predictions.join(t, key, "left").join(i, key, "left")
    return both.withColumn("missing", F.when(F.col("_i").isNull(), "input").when(F.col("_t").isNull(), "target")).drop("_t", "_i")


#: Endings of the names of a norm's running statistics, which a model need not define.
BUFFERS = ("running_mean", "running_var", "num_batches_tracked")


def reconcile_shapes(have: DataFrame, want: DataFrame, prefix: str = "module.", left_out: tuple[str, ...] = ()) -> DataFrame:
    """Full outer match of (name, shape) tables: loaded, shape_mismatch, unexpected or missing. A prefix goes if all names have it;
    of have, names with an ending of left_out (such as BUFFERS) do not count."""
    every = have.agg(F.bool_and(F.col("name").startswith(prefix)).alias("_all"))
    bare = have.crossJoin(F.broadcast(every)).select(F.when(F.col("_all"), F.substring("name", F.lit(len(prefix) + 1), F.length("name"))).otherwise(F.col("name")).alias("name"), F.col("shape").alias("have_shape"))  # one row is broadcast
    for ending in left_out:
        bare = bare.where(~F.col("name").endswith(ending))
    both = bare.join(want.select("name", F.col("shape").alias("want_shape")), "name", "full_outer")
    status = F.when(F.col("want_shape").isNull(), "unexpected").when(F.col("have_shape").isNull(), "missing").when(F.col("have_shape") == F.col("want_shape"), "loaded").otherwise("shape_mismatch")
    return both.withColumn("status", status)


def coverage(matched: DataFrame) -> DataFrame:
    """One row on what reconcile_shapes gave: the shares of the wanted tensors and of their elements that are loaded, and the lesser.
    With a shape unknown the share of elements is NaN, and the lesser that of tensors; with nothing wanted all are 0."""
    wanted = matched.where("want_shape is not null").withColumn("_n", product(F.col("want_shape")))
    loaded = F.col("status") == "loaded"
    t = wanted.agg(F.count("*").alias("n"), F.count_if(loaded).alias("hit"), F.count("_n").alias("known"), F.sum("_n").alias("all"), F.sum(F.when(loaded, F.col("_n"))).alias("some"))
    elements = F.when(F.col("known") < F.col("n"), F.lit(float("nan"))).otherwise(F.coalesce("some", F.lit(0.0)) / F.greatest(F.coalesce("all", F.lit(0.0)), F.lit(1.0)))
    both = t.select((F.col("hit") / F.greatest("n", F.lit(1))).alias("tensors"), elements.alias("elements"))
    return both.withColumn("guard", F.least("tensors", F.nanvl("elements", "tensors")))


def scored(df: DataFrame, flag: str, name: str = "scored") -> DataFrame:
    """Adds whether a row counts: those whose flag is not 1, or all rows where every flag is."""
    some = F.broadcast(df.agg(F.coalesce(F.bool_or(F.coalesce(F.col(flag), F.lit(0)) != 1), F.lit(False)).alias("_some")))  # one row
    return df.crossJoin(some).withColumn(name, (F.coalesce(F.col(flag), F.lit(0)) != 1) | ~F.col("_some")).drop("_some")


def leaks(assigned: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that stand in more than one split."""
    return assigned.groupBy(group).agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1")
