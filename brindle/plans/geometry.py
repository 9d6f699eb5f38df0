"""Queries over geometry, seeds, dev splits and training examples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import grids
from ..operators import folds, sampling
from ..operators import geometry as G
from .catalogue import query, table
from .cohort import WITH, cohort
from .volumes import CUBE, W, by_place, elements, kernel, measure, signals, values

#: A made-up affine: voxel axes run to posterior, right and superior.
AFFINE = np.array([[0.0, 1.5, 0, -10], [-1, 0, 0, 20], [0, 0, 2, 5], [0, 0, 0, 1]])


def _reoriented(a: np.ndarray) -> dict:
    b, affine = G.reorient(a, AFFINE)
    return {"values": b.ravel().tolist(), "affine": affine.ravel().tolist(), "letters": G.orientation(affine)}


kernel("reorient", _reoriented, "values array<double>, affine array<double>, letters string")
kernel("pad_to", lambda a: dict(zip(("values", "start"), (lambda b, at: (b.ravel().tolist(), list(at)))(*G.pad_to(a, (4, 6, 4), 4)))), "values array<double>, start array<int>")
values("pad_to_places", lambda a: grids.pad(a, CUBE, (0, 2, 0), (0, 2, 0), None), "", by_place("a[x.i * 16 + least(3, greatest(0, y.i - 2)) * 4 + z.i + 1]", (4, 8, 4)))
TURN = "u AS (SELECT vec_id, a[1] / sqrt(a[1] * a[1] + a[2] * a[2] + a[3] * a[3]) AS x, a[2] / sqrt(a[1] * a[1] + a[2] * a[2] + a[3] * a[3]) AS y, a[3] / sqrt(a[1] * a[1] + a[2] * a[2] + a[3] * a[3]) AS z, cos(a[4]) AS c, sin(a[4]) AS s FROM e), m AS (SELECT vec_id, [c + x * x * (1 - c), x * y * (1 - c) - z * s, x * z * (1 - c) + y * s, y * x * (1 - c) + z * s, c + y * y * (1 - c), y * z * (1 - c) - x * s, z * x * (1 - c) - y * s, z * y * (1 - c) + x * s, c + z * z * (1 - c)] AS m FROM u)"
values("turn_matrix", lambda a: grids.turn_matrix([a[0], a[1], a[2]], a[3]), TURN, "SELECT vec_id, i.i AS pos, m[i.i + 1] AS v FROM m, range(9) i(i)")

MEAN, SD = "list_avg(a)", "list_aggregate(a, 'stddev_pop')"
elements(
    "statistical_norm", f"list_transform(a, lambda x: least(255.0, greatest(0.0, (x - {MEAN} + 2 * {SD}) / (4 * {SD}) * 255)))",
    lambda a, b: A.statistical255(a, 2.0), 4,
)
elements(
    "train_example", "list_transform(list_transform(a, lambda x: (x - list_min(a)) / (list_max(a) - list_min(a)) * 255), lambda x: (x - 127.5) / 127.5)",
    lambda a, b: A.example(A.minmax255(a)),
)
L1 = "list_sum(list_transform(range(1, 65), lambda i: abs(a[i] - b[i]))) / 64"
measure("adversarial_mix", f"list_avg(list_transform(a, lambda x: ln(1 + exp(-x)))) + 100 * {L1}", lambda a, b: A.cross_entropy(a, 1) + 100 * A.mae(a, b))
measure("least_squares_mix", f"list_avg(list_transform(a, lambda x: (x - 1) * (x - 1))) + 100 * {L1}", lambda a, b: A.mean(F.transform(a, lambda x: (x - 1) * (x - 1))) + 100 * A.mae(a, b))

L1_BACK = "list_sum(list_transform(range(1, 65), lambda i: abs(a[i] - a[65 - i]))) / 64"
JUDGED = "list_avg(list_transform({0}, lambda x: ln(1 + exp(-x))))"
measure("cycle_mix", f"{JUDGED.format('a')} + {JUDGED.format('b')} + 20 * {L1} + 5 * {L1_BACK}", lambda a, b: A.side_loss(a, a, b, F.reverse(a)) + A.side_loss(b, b, a, b))


@query("pad_edge", W + ", v AS (SELECT vec_id, list_concat([a[1], a[1], a[1]], a, [a[64], a[64], a[64], a[64], a[64]]) AS v FROM s) SELECT vec_id, i.i AS pos, round(v[i.i + 1], 6) AS x FROM v, range(72) i(i)")
def _(spark, sf):
    padded = F.concat(F.array_repeat(F.get("a", 0), 3), F.col("a"), F.array_repeat(F.element_at("a", -1), 5))
    return signals(spark, sf).select("vec_id", F.posexplode(padded).alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query("align_geometry", W + "SELECT vec_id, CAST(2 + vec_id % 3 AS DOUBLE) AS spacing, CAST(vec_id AS DOUBLE) AS origin, round(a[1], 6) AS first FROM s")
def _(spark, sf):
    volume = F.struct(F.array(F.lit(1.0)).alias("spacing"), F.array(F.lit(0.0)).alias("origin"), F.col("a").alias("data"))
    reference = F.struct(F.array(2.0 + F.pmod("vec_id", F.lit(3))).alias("spacing"), F.array(F.col("vec_id").cast("double")).alias("origin"))
    v = signals(spark, sf).select("vec_id", G.aligned(volume, reference).alias("v"))
    return v.select("vec_id", F.get("v.spacing", 0).alias("spacing"), F.get("v.origin", 0).alias("origin"), F.round(F.get("v.data", 0), 6).alias("first"))


@query("stable_seed", WITH + "SELECT o_orderkey, CAST('0x' || substr(md5('7:' || stem), 1, 8) AS BIGINT) AS seed FROM cohort")
def _(spark, sf):
    return cohort(spark, sf).select("o_orderkey", sampling.stable_seed(F.lit(7), F.col("stem")).alias("seed"))


@query("random_pair", "WITH b AS (SELECT vec_id AS b, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1 AS place, count(*) OVER () AS n FROM embeddings) SELECT e.vec_id AS a, b.b FROM embeddings e JOIN b ON b.place = CAST('0x' || substr(md5('3:' || e.vec_id), 1, 8) AS BIGINT) % b.n")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id")
    return sampling.random_pairs(e.withColumnRenamed("vec_id", "a"), e.withColumnRenamed("vec_id", "b"), "a", "b", 3)


@query("row_cap", WITH + "SELECT stem FROM cohort ORDER BY stem LIMIT 25")
def _(spark, sf):
    return cohort(spark, sf).select("stem").orderBy("stem").limit(25)  # the feature: the first so many names


@query("param_count", "SELECT p_brand, CAST(sum(p_size * (1 + p_partkey % 4)) AS BIGINT) AS numbers, count(*) AS tensors FROM part GROUP BY 1")
def _(spark, sf):
    shape = F.array(F.col("p_size"), 1 + F.pmod("p_partkey", F.lit(4)))
    return table(spark, sf, "part").groupBy("p_brand").agg(F.sum(A.product(shape).cast("long")).alias("numbers"), F.count("*").alias("tensors"))


QUOTAS = {"f": 20, "o": 20, "p": 2}


@query("dev_split")
def _(spark, sf):
    return folds.dev_split(cohort(spark, sf), "o_custkey", "weighting", QUOTAS, QUOTAS)


@query("cv_carve")
def _(spark, sf):
    return folds.carve(cohort(spark, sf), folds.kfold_groups(cohort(spark, sf), "o_custkey", "weighting", 4), "o_custkey", "weighting", 4, 0.2)


def checked(name: str, rounds: int, splits) -> None:
    """Whether a greedy split keeps what it must: each group in one split of each round, and none left out."""
    sql = WITH + f"SELECT r.i AS round, count(DISTINCT o_custkey) AS groups, 0 AS leaks, 0 AS missing FROM cohort, range({rounds}) r(i) GROUP BY 1"

    @query(name, sql)
    def _(spark, sf):
        c = cohort(spark, sf)
        found = splits(c).groupBy("round", "o_custkey").agg(F.countDistinct("split").alias("n"))
        every = c.select("o_custkey").distinct().join(F.broadcast(spark.range(rounds).withColumnRenamed("id", "round")))  # a row a round
        both = every.join(found, ["round", "o_custkey"], "left")
        return both.groupBy("round").agg(F.count("*").alias("groups"), F.count_if(F.col("n") > 1).alias("leaks"), F.count_if(F.col("n").isNull()).alias("missing"))


checked("kfold_groups_kept", 1, lambda c: folds.kfold_groups(c, "o_custkey", "weighting", 5).select("o_custkey", F.lit(0).alias("round"), F.col("fold").alias("split")))
checked("dev_split_kept", 1, lambda c: folds.dev_split(c, "o_custkey", "weighting", QUOTAS, QUOTAS).withColumn("round", F.lit(0)))
checked("cv_carve_kept", 4, lambda c: folds.carve(c, folds.kfold_groups(c, "o_custkey", "weighting", 4), "o_custkey", "weighting", 4, 0.2))


@query("quota_split_met", WITH + "SELECT weighting, least(count(*), q.n) AS n FROM cohort JOIN (VALUES ('f', 20), ('o', 20), ('p', 2)) q(w, n) ON q.w = weighting GROUP BY weighting, q.n")
def _(spark, sf):
    """Of each stratum as many rows as its quota asks, where there are so many."""
    c = cohort(spark, sf)
    taken = c.join(folds.quota_split(c, "o_custkey", "weighting", QUOTAS), "o_custkey").groupBy("weighting").agg(F.count("*").alias("n"))
    asked = spark.createDataFrame(list(QUOTAS.items()), "weighting string, asked long")
    return taken.join(asked, "weighting").select("weighting", F.least("n", "asked").alias("n"))
