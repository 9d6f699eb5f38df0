"""Group-safe splits by greedy rules over the table of groups, which stays in Spark: the driver holds counts by ranges and profiles of groups, and
names of one range at a time; folds are dealt range after range in tasks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import in_order, shared_folder, stored

#: Counts by range and profile that a greedy split gathers; more are refused.
MOST_GROUPS = 1_000_000
#: Groups in a range whose names are gathered.
RANGE_GROUPS = 20_000
#: Groups that one task deals to folds before the next one goes on.
DEALT_GROUPS = 250_000
#: Ranges whose names the driver remembers.
RANGES_HELD = 8


def group_strata(df: DataFrame, group: str, stratum: str) -> DataFrame:
    """group, n, strata (map of counts)."""
    counts = df.groupBy(group, stratum).agg(F.count("*").alias("c"))
    return counts.groupBy(group).agg(F.sum("c").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(stratum, "c")))).alias("strata"))


def group_table(df: DataFrame, group: str, stratum: str) -> tuple[DataFrame, list]:
    """Stored (group, n, c: its rows in each stratum), and the strata in order."""
    strata = sorted((r[0] for r in df.select(stratum).distinct().collect()), key=lambda x: (x is not None, x))  # a row a stratum
    counts = df.groupBy(group, stratum).agg(F.count("*").alias("_c"))
    own = [F.coalesce(F.sum(F.when(F.col(stratum).eqNullSafe(F.lit(s)), F.col("_c"))), F.lit(0).cast("long")) for s in strata]
    return stored(counts.groupBy(group).agg(F.sum("_c").alias("_n"), F.array(*own).cast("array<long>").alias("_kind"))), strata


def _name(group: str) -> Column:
    """A group as text, by which ties are settled."""
    return F.coalesce(F.col(group).cast("string"), F.lit("None\0"))


def _in_ranges(table: DataFrame, size: int, *order: Column | str) -> tuple[DataFrame, int]:
    """A stored table dealt to ranges of about so many rows in that order, written to the shared folder with the range of each row; and the count of ranges."""
    ranges = -(-table.count() // size)
    path = f"{shared_folder(table.sparkSession)}/ranges-{uuid.uuid4().hex}"
    table.repartitionByRange(max(ranges, 1), *order).withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(path)
    kept = T.StructType([*table.schema, T.StructField("_range", T.IntegerType())])
    return table.sparkSession.read.schema(kept).parquet(path), ranges


def _dealer(counts: np.ndarray, key: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas: rows in order with the fold where the strata stay most even, from what the folds hold (folds, strata) on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, k = counts.copy(), len(counts)
        own_fold = np.eye(k)[:, :, None]
        for x in batches:
            folds = []
            for own in np.array(x["_kind"].tolist(), dtype=float).reshape(len(x), -1):
                trial = held + own_fold * own
                apart = trial - np.add.reduce(trial, 1, keepdims=True) / k
                uneven = np.sqrt(np.add.reduce(apart * apart, 1) / k).sum(1).tolist()
                f = min(zip([round(u, 12) for u in uneven], held.sum(1).tolist(), range(k)))[2]
                held[f] += own
                folds.append(f)
            yield pd.DataFrame({key: x[key], "fold": np.array(folds, dtype=np.int32), "_kind": x["_kind"]})

    return run


def _drawn(seed: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas: adds _draw, the number of a seeded sequence at the row's _place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            at = x["_place"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at) != 1) + 1), len(at)]  # stretches of one place after another
            draws = [np.random.Generator(np.random.PCG64(seed).advance(int(at[a]))).random(b - a) for a, b in zip(cuts, cuts[1:]) if b > a]
            yield x.assign(_draw=np.concatenate(draws) if draws else np.zeros(0))

    return run


def kfold_groups(df: DataFrame, group: str, stratum: str, k: int, seed: int = 0) -> DataFrame:
    """(group, fold): the largest group first, ties by a seeded draw, each into the fold where the strata stay most even.

    Each choice depends on all before it, so ranges of the order are dealt one after another, each by a task that begins with the folds'
    counts so far; only these counts pass through the driver."""
    spark, kind = df.sparkSession, df.schema[group].dataType.simpleString()
    table, strata = group_table(df, group, stratum)
    placed = in_order(table, [group], "_place")
    drawn = stored(placed.mapInPandas(_drawn(seed), T.StructType([*placed.schema, T.StructField("_draw", T.DoubleType())])))
    ranges, n_ranges = _in_ranges(drawn, DEALT_GROUPS, F.desc("_n"), F.col("_draw"), _name(group))
    out, schema = f"{shared_folder(spark)}/folds-{uuid.uuid4().hex}", f"`{group}` {kind}, fold int, _kind array<long>"
    counts = np.zeros((k, len(strata)))
    for i in range(n_ranges):
        rows = ranges.where(F.col("_range") == i).coalesce(1).sortWithinPartitions(F.desc("_n"), "_draw", _name(group)).select(group, "_kind")
        rows.mapInPandas(_dealer(counts, group), schema).write.parquet(f"{out}/part={i}")
        sums = [F.sum(F.get("_kind", j)).alias(f"_{j}") for j in range(len(strata))]
        for r in spark.read.schema(schema).parquet(f"{out}/part={i}").groupBy("fold").agg(*sums).collect():  # a row a fold
            counts[r["fold"]] += r[1:]
    wanted = df.select(F.col(group), F.lit(0).alias("fold")).schema
    return spark.read.schema(schema).parquet(out).select(group, "fold") if n_ranges else spark.createDataFrame([], wanted)


class Taking:
    """Takes groups one by one, each time the one that overshoots its use the least: by (over - useful, over, name), where useful is what
    of a group's rows the quotas still ask, and over the rest.

    Groups of equal counts by stratum (a profile) differ by name only, and what they are of use changes only while a quota has less left than some
    group's count. Until then whole classes of equal (over - useful, over) are taken in order of name: by the counts of ranges where a range
    goes whole, row by row within the one range where a quota comes to its end. A profile's groups are taken in order of name, so what is
    taken is told by a bound (range, name) for each profile."""

    def __init__(self, kinds: np.ndarray, at: np.ndarray, of: np.ndarray, counts: np.ndarray, names: Callable[[int], tuple[np.ndarray, list[str]]]):
        """kinds: a row of counts for each profile. at, of, counts: range, profile and count of groups. names: of a range, profiles and names in order of name."""
        self.kinds, self.names = kinds, names
        self.size, self.left = kinds.sum(1), np.bincount(of, counts, len(kinds)).astype(np.int64)
        self.bound: list[tuple[int, str | None]] = [(-1, None)] * len(kinds)  # None: all of the range
        self.column, self.tables = np.zeros(len(kinds), dtype=np.int64), {}
        for n in np.unique(self.size[of]):
            rows = self.size[of] == n
            ranges, row = np.unique(at[rows], return_inverse=True)
            own, column = np.unique(of[rows], return_inverse=True)
            table = np.zeros((len(ranges), len(own)), dtype=np.int64)
            np.add.at(table, (row, column), counts[rows])
            self.column[own], self.tables[n] = np.arange(len(own)), (ranges, table)

    def take(self, quotas: np.ndarray) -> None:
        """Takes groups until all quotas are met or none helps."""
        need = quotas.astype(np.int64)
        while True:
            useful = np.minimum(self.kinds, np.maximum(need, 0)).sum(1)
            may = np.flatnonzero((self.left > 0) & (useful > 0))
            if not len(may):
                return
            over = self.size[may] - useful[may]
            may, over = (x[over - useful[may] == (over - useful[may]).min()] for x in (may, over))
            may = may[over == over.min()]  # of one size and use
            most = self.kinds[self.left > 0].max(0)
            slack = np.where(need <= 0, np.iinfo(np.int64).max, np.where(need >= most, need - most, 0))
            need -= self._in_class(may, slack)

    def _in_class(self, own: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """Takes groups of these profiles in order of name until the sum of some stratum is above its slack; the sums."""
        ranges, table = self.tables[self.size[own[0]]]
        columns = self.column[own]
        sums = np.cumsum(table[:, columns] @ self.kinds[own], axis=0)
        beyond = np.flatnonzero((sums > slack).any(1))
        whole = beyond[0] if len(beyond) else len(ranges)  # ranges that go whole
        taken = sums[whole - 1] if whole else np.zeros_like(sums[0])
        self.left[own] -= table[:whole, columns].sum(0)
        table[:whole, columns] = 0
        end: tuple[int, str | None] = (int(ranges[whole - 1]), None) if whole else (-1, None)
        if whole < len(ranges):
            at = int(ranges[whole])
            of, names = self.names(at)
            mine = [i for i in np.flatnonzero(np.isin(of, own)) if _beyond((at, names[i]), self.bound[of[i]])]
            rows = np.cumsum(self.kinds[of[mine]], axis=0)
            last = int(np.flatnonzero((rows > slack - taken).any(1))[0])
            gone = np.bincount(of[mine[: last + 1]], minlength=len(self.kinds))[own]
            self.left[own] -= gone
            table[whole, columns] -= gone
            taken, end = taken + rows[last], (at, names[mine[last]])
        for i in own:
            if _beyond(end, self.bound[i]):
                self.bound[i] = end
        return taken


def _beyond(a: tuple[int, str | None], b: tuple[int, str | None]) -> bool:
    """Whether a place (range, name; None: the end of the range) lies behind another."""
    if a[0] != b[0]:
        return a[0] > b[0]
    return b[1] is not None and (a[1] is None or a[1] > b[1])


class GroupRanges:
    """The groups of a table (group, _n, _kind, and _folds where they have any) in ranges of size and name, with what splits by quotas need of them."""

    def __init__(self, table: DataFrame, strata: list, group: str):
        self.strata, self.spark = strata, table.sparkSession
        folds = table if "_folds" in table.columns else table.withColumn("_folds", F.array().cast("array<int>"))
        named = folds.withColumn("_name", _name(group))
        self.rows, _ = _in_ranges(named, max(1, min(RANGE_GROUPS, MOST_GROUPS // 2)), F.desc("_n"), F.col("_name"))
        counts = self.rows.groupBy("_range", "_kind", "_folds").agg(F.count("*").alias("_c")).limit(MOST_GROUPS + 1).toArrow()
        if len(counts) > MOST_GROUPS:
            raise ValueError(f"more than {MOST_GROUPS} profiles of groups to choose from")
        kinds = self._vectors(counts["_kind"])
        self.kinds, self.of = np.unique(kinds, axis=0, return_inverse=True) if len(kinds) else (kinds, np.zeros(0, dtype=np.int64))
        self.of = self.of.ravel()
        self.number = {tuple(x): i for i, x in enumerate(self.kinds.tolist())}
        self.at, self.counts, self.folds = counts["_range"].to_numpy(), counts["_c"].to_numpy(), counts["_folds"].to_pylist()
        self.held: dict[int, tuple[np.ndarray, list[str], list]] = {}

    def _vectors(self, column) -> np.ndarray:
        return np.array(column.to_pylist(), dtype=np.int64).reshape(len(column), len(self.strata))

    def _names(self, at: int) -> tuple[np.ndarray, list[str], list]:
        if at not in self.held:
            if len(self.held) >= RANGES_HELD:
                self.held.pop(next(iter(self.held)))
            rows = sorted(self.rows.where(F.col("_range") == at).select("_name", "_kind", "_folds").collect(), key=lambda r: r["_name"])  # one range
            self.held[at] = np.array([self.number[tuple(r["_kind"])] for r in rows]), [r["_name"] for r in rows], [r["_folds"] for r in rows]
        return self.held[at]

    def taking(self, but: int | None = None) -> Taking:
        """Of all groups, or of those that aren't in a fold."""
        kept = np.array([but not in f for f in self.folds], dtype=bool)

        def names(at: int) -> tuple[np.ndarray, list[str]]:
            of, named, folds = self._names(at)
            mine = [i for i, f in enumerate(folds) if but not in f]
            return of[mine], [named[i] for i in mine]

        return Taking(self.kinds, self.at[kept], self.of[kept], self.counts[kept], names)

    def quotas(self, wanted: dict) -> np.ndarray:
        return np.array([wanted.get(s, 0) for s in self.strata], dtype=np.int64)

    def marked(self, rows: DataFrame, bounds: list[tuple[str, int, list]]) -> DataFrame:
        """Rows with a column _in, for bounds (name, round, the bounds of each profile) in order: the first name whose bound a row of that round is
        within, null if none; with _round in rows if any has."""
        told = [(self.kinds[i].tolist(), i_round, n, name, *b) for n, (name, i_round, own) in enumerate(bounds) for i, b in enumerate(own) if b[0] >= 0]
        ends = self.spark.createDataFrame(told, "_kind array<long>, _round int, _nth int, _as string, _last int, _until string")
        by_kind = ends.groupBy("_kind", "_round").agg(F.array_sort(F.collect_list(F.struct("_nth", "_as", "_last", "_until"))).alias("_ends"))
        within = F.filter("_ends", lambda e: (F.col("_range") < e["_last"]) | ((F.col("_range") == e["_last"]) & (e["_until"].isNull() | (F.col("_name") <= e["_until"]))))
        return rows.join(by_kind, ["_kind", "_round"], "left").withColumn("_in", F.get(within, 0)["_as"])


def quota_split(df: DataFrame, group: str, stratum: str, quotas: dict[str, int]) -> DataFrame:
    """(group, taken): groups taken one by one, each time the one that overshoots its use the least, until all quotas are met or none helps."""
    ranges = GroupRanges(*group_table(df, group, stratum), group)
    taking = ranges.taking()
    taking.take(ranges.quotas(quotas))
    rows = ranges.marked(ranges.rows.withColumn("_round", F.lit(0)), [("taken", 0, taking.bound)])
    return rows.where("_in is not null").select(group, F.lit(1).alias("taken"))


def rotate(assigned: DataFrame, k: int) -> DataFrame:
    """Each row in each of k rounds: the round's fold is test, the next one val, the rest train."""
    rounds = assigned.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    split = F.when(F.col("fold") == F.col("round"), "test").when(F.col("fold") == F.pmod(F.col("round") + 1, F.lit(k)), "val").otherwise("train")
    return rounds.withColumn("split", split)


def dev_split(df: DataFrame, group: str, stratum: str, test: dict[str, int], val: dict[str, int]) -> DataFrame:
    """(group, split): test by quotas, val by quotas from what is left, and the rest train; a group is in one split only."""
    ranges = GroupRanges(*group_table(df, group, stratum), group)
    taking, bounds = ranges.taking(), []
    for name, wanted in (("test", test), ("val", val)):
        taking.take(ranges.quotas(wanted))
        bounds.append((name, 0, list(taking.bound)))  # a later bound holds what an earlier one does
    rows = ranges.marked(ranges.rows.withColumn("_round", F.lit(0)), bounds)
    return rows.select(group, F.coalesce("_in", F.lit("train")).alias("split"))


def carve(df: DataFrame, assigned: DataFrame, group: str, stratum: str, k: int, share: float) -> DataFrame:
    """(group, round, split): in each of k rounds the round's fold of assigned (group, fold) is test; val is taken from the rest
    by quotas of so large a share of each stratum, rounded to even."""
    table, strata = group_table(df, group, stratum)
    own = assigned.groupBy(F.col(group).alias("_of")).agg(F.array_sort(F.collect_set(F.col("fold").cast("int"))).alias("_own"))  # one, as a rule
    with_folds = table.join(own, F.col(group).eqNullSafe(F.col("_of")), "left").withColumn("_folds", F.coalesce("_own", F.array().cast("array<int>")))
    ranges, bounds = GroupRanges(stored(with_folds.drop("_of", "_own")), strata, group), []
    for i in range(k):
        taking = ranges.taking(but=i)
        taking.take(np.array([round(share * int(n)) for n in taking.left @ taking.kinds], dtype=np.int64))
        bounds.append(("val", i, taking.bound))
    rows = ranges.marked(ranges.rows.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))), bounds)
    split = F.when(F.array_contains("_folds", F.col("_round")), "test").otherwise(F.coalesce("_in", F.lit("train")))
    return rows.select(group, F.col("_round").alias("round"), split.alias("split"))
