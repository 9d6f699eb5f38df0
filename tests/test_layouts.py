"""Interval joins, running aggregates, curves and chunks against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import grids
from brindle.functions.curves import hilbert, morton
from brindle.operators import chunks, geometry, intervals, kernels, ordering, transforms
from brindle.sources import layout
from brindle.streaming import stream


def test_last_before_against_a_scan(spark):
    r = random.Random(1)
    begins = [(r.choice([1.0, 2.0, 2.0, 5.0, r.random() * 9]), i) for i in range(60)] + [(None, 99)]
    points = [(i, r.choice([0.5, 2.0, 5.0, r.random() * 10])) for i in range(300)] + [(1000, None)]
    got = intervals.last_before(spark.createDataFrame(points, "id long, at double").repartition(3), "at", spark.createDataFrame(begins, "low double, item long"), "low").collect()
    for x in got:
        held = [] if x["at"] is None else [b for b in begins if b[0] is not None and b[0] <= x["at"]]
        assert x["item"] == (max(held)[1] if held else None)
    assert sorted(x["id"] for x in got) == sorted(i for i, _ in points)


def test_draws_follow_weights_and_a_heavy_row_stays_spread(spark, monkeypatch):
    rows = [("heavy", 100.0)] + [(f"k{i:03}", 1.0) for i in range(100)] + [("none", 0.0), ("null", None)]
    df = spark.createDataFrame(rows, "k string, w double")
    kept, real = [], intervals.stored
    monkeypatch.setattr(intervals, "stored", lambda x: (kept.append(real(x)), kept[-1])[1])
    with stream.settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        got = intervals.draws_with_replacement(df, "k", "w", 4000, 3).collect()
    assert [sorted(x["draw"] for x in got)] == [list(range(4000))]
    assert sum(x["k"] == "heavy" for x in got) == pytest.approx(2000, abs=150) and not {"none", "null"} & {x["k"] for x in got}
    assert sorted(got) == sorted(intervals.draws_with_replacement(df.repartition(5), "k", "w", 4000, 3).collect())
    most = kept[0].groupBy("_range").count().agg(F.max("count")).first()[0]
    assert most < 4100 * 0.5, "half of the draws fall to one row, and yet no range has half of them"
    assert intervals.draws_with_replacement(df.where("w = 0"), "k", "w", 10, 3).collect() == []


def test_holding_against_all_pairs(spark):
    r = random.Random(2)
    stretches = [(i, a, a + r.choice([0.0, 0.1, 3.0, 50.0])) for i in range(80) for a in [r.random() * 100]]
    points = [(i, r.choice([r.random() * 160 - 10, stretches[i % 80][1], stretches[i % 80][2]])) for i in range(300)]
    p, s = spark.createDataFrame(points, "id long, at double"), spark.createDataFrame(stretches, "s long, low double, high double")
    want = sorted((i, k) for (i, at), (k, low, high) in itertools.product(points, stretches) if low <= at < high)
    for cells in (1, 7, 1000):
        assert sorted((x["id"], x["s"]) for x in intervals.holding(p, "at", s, "low", "high", cells).collect()) == want


def test_running_aggregates_of_a_hot_group(spark):
    r = random.Random(3)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), i, r.choice([None, r.randint(-9, 9)])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i long, v long").repartition(6)
    got = {x["i"]: x for x in ordering.running(df, ["g"], ["i"], {"top": ("max", "v"), "least": ("min", "v"), "total": ("sum", "v"), "n": ("count", "v")}).collect()}
    for g, i, _ in rows:
        past = [v for h, j, v in rows if h == g and j < i and v is not None]
        x = got[i]
        assert (x["top"], x["least"], x["total"], x["n"]) == ((max(past), min(past), sum(past), len(past)) if past else (None, None, None, 0))


def test_hilbert_against_the_whole_curve(spark):
    for bits in (1, 2, 4):
        side = 1 << bits
        at = np.array(list(itertools.product(range(side), range(side))))
        df = spark.createDataFrame([tuple(map(int, p)) for p in at], "x long, y long")
        places = {(r["x"], r["y"]): r["p"] for r in df.withColumn("p", hilbert([F.col("x"), F.col("y")], bits)).collect()}
        path = sorted(places, key=places.get)
        assert sorted(places.values()) == list(range(side * side))
        assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(path, path[1:])), "neighbours on the curve are neighbours in space"
    other = transforms.hilbert_rank([at[:, 0], at[:, 1]], 4)
    assert sorted(other) == sorted(places.values())


def test_morton_of_three(spark):
    r = random.Random(4)
    rows = [tuple(r.randrange(1 << 20) for _ in range(3)) for _ in range(50)]
    got = spark.createDataFrame(rows, "x long, y long, z long").withColumn("p", morton([F.col(c) for c in "xyz"], 20)).collect()
    for x in got:
        assert x["p"] == sum((x[c] >> i & 1) << 3 * i + j for i in range(20) for j, c in enumerate("xyz"))
    with pytest.raises(ValueError):
        morton([F.col("x")] * 3, 22)


def test_a_box_is_in_few_files(spark, tmp_path):
    df = spark.range(40_000).select("id", (F.xxhash64("id") % 1000).alias("x"), (F.xxhash64("id", F.lit(1)) % 1000).cast("double").alias("y"))
    box = "x between 100 and 180 and y between -300 and -220"

    def touched(path):
        files = spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
        return files.where("a <= 180 and b >= 100 and c <= -220 and d >= -300").count(), files.count()

    for curve in ("hilbert", "morton"):
        layout.write_by_curve(df, str(tmp_path / curve), ["x", "y"], 64, curve=curve)
        hit, every = touched(str(tmp_path / curve))
        assert every >= 50 and hit <= 9
        assert spark.read.parquet(str(tmp_path / curve)).where(box).count() == df.where(box).count()
    df.repartition(64).write.parquet(str(tmp_path / "plain"))
    assert touched(str(tmp_path / "plain"))[0] >= 50


@pytest.mark.parametrize("shape, chunk", [((4, 6, 2), (2, 3, 1)), ((4, 6, 2), (4, 6, 2)), ((3, 3, 3), (1, 1, 1)), ((1, 4, 8), (1, 2, 4))])
def test_differences_over_chunks(spark, shape, chunk):
    rng = np.random.default_rng(5)
    whole = rng.normal(size=shape)
    df = spark.createDataFrame([(1, whole.ravel().tolist()), (2, (whole * 2).ravel().tolist())], "k long, data array<double>")
    c = chunks.chunked(df, "k", "data", shape, chunk)
    assert c.select(F.max(F.size("values"))).first()[0] == int(np.prod(chunk)), "no row holds a volume"
    for axis in range(3):
        forward = np.zeros(shape)
        inner = [slice(None)] * 3
        inner[axis] = slice(0, -1)
        if shape[axis] > 1:
            forward[tuple(inner)] = np.diff(whole, axis=axis)
        for central, want in ((False, forward), (True, np.gradient(whole, axis=axis) if shape[axis] > 1 else None)):
            got = {(r["x"], r["y"], r["z"]): r["value"] for r in chunks.voxels(chunks.differences(c, "k", chunk, axis, central), "k", chunk).where("k = 2").collect()}
            for at in np.ndindex(*shape):
                assert got[at] is None if want is None else got[at] == pytest.approx(2 * want[at])
    with pytest.raises(ValueError):
        chunks.chunked(df, "k", "data", (4, 4, 4), (3, 2, 2))


def test_grids_against_numpy(spark):
    shape = (2, 3, 5)
    whole = np.random.default_rng(6).normal(size=shape)
    a = F.col("a")
    df = spark.createDataFrame([(whole.ravel().tolist(),)], "a array<double>")
    cases = {
        "crop": (grids.crop(a, shape, (0, 1, 2), (2, 2, 3)), whole[0:2, 1:3, 2:5]),
        "zeros": (grids.pad(a, shape, (1, 0, 2), (0, 2, 1)), np.pad(whole, ((1, 0), (0, 2), (2, 1)))),
        "nearest": (grids.pad(a, shape, (1, 0, 2), (0, 2, 1), None), np.pad(whole, ((1, 0), (0, 2), (2, 1)), mode="edge")),
        "value": (grids.pad(a, shape, (0, 0, 0), (1, 0, 0), -1.0), np.pad(whole, ((0, 1), (0, 0), (0, 0)), constant_values=-1.0)),
        **{f"flip{k}": (grids.flip(a, shape, k), np.flip(whole, k)) for k in range(3)},
        **{f"turn{i}{k}": (grids.quarter_turn(a, shape, i, k), np.rot90(whole, 1, (i, k))) for i in range(3) for k in range(3) if i != k},
        **{f"plane{k}": (grids.plane(a, shape, k, 1), np.take(whole, 1, k)) for k in range(3)},
    }
    other = F.reverse(a)
    cases |= {
        "translate": (grids.translate(a, shape, (0, -1, 2)), transforms.translate(whole, (0, -1, 2))),
        "laplacian": (grids.laplacian(a, shape), transforms.laplacian(whole)),
        "sobel": (grids.sobel(a, shape), transforms.sobel(whole)),
        "scaled": (grids.scaled(a, a, 0.005, 0.995), kernels.percentile_norm(whole)),
        "foreground": (grids.foreground_scaled(a), kernels.foreground_norm(whole)),
        "mass": (grids.crop_about_mass(a, shape, (1, 2, 3), F.lit(0.5)), transforms.crop_background(whole, (1, 2, 3), 0.5)),
        "middle": (grids.crop_about_mass(a, shape, (1, 2, 3), F.lit(99.0)), transforms.crop_background(whole, (1, 2, 3), 99.0)),
        "turn": (grids.turn_matrix([a[0], a[1], a[2]], a[3]), geometry.about_axis(tuple(whole.ravel()[:3]), whole.ravel()[3])[:3, :3]),
        "sharpness": (F.array(grids.sharpness(a, shape)), np.array([kernels.sharpness(whole)])),
        "edges": (F.array(grids.edge_weighted_l1(a, other, shape)), np.array([kernels.edge_weighted_l1(whole, whole.ravel()[::-1].reshape(shape))])),
    }
    for name, (c, want) in cases.items():
        assert df.select(c).first()[0] == pytest.approx(want.ravel().tolist()), name
    with pytest.raises(ValueError):
        grids.crop(a, shape, (1, 0, 0), (2, 1, 1))
