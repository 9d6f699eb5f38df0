import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import geometry as G
from brindle.sources.nifti import NiftiSource
from brindle.sources.volume import read_affine, write_nifti

A = np.random.default_rng(5).random((3, 4, 5)).astype(np.float32)


@pytest.mark.parametrize("wanted", ["LPS", "RAS", "SPL", "AIR"])
def test_reorient_keeps_places(wanted):
    affine = np.array([[0, 0.1, -2.0, 5], [-1.5, 0, 0.1, 7], [0.1, 3, 0, -2], [0, 0, 0, 1]])
    assert G.orientation(affine) == "PSL"
    b, new = G.reorient(A, affine, wanted)
    assert G.orientation(new) == wanted
    for i in np.ndindex(*b.shape):
        old = np.rint(np.linalg.solve(affine, new @ [*i, 1]))[:3].astype(int)
        assert b[i] == A[tuple(old)]
    assert np.allclose(sorted(G.spacing_of(new)), sorted(G.spacing_of(affine)))
    with pytest.raises(ValueError):
        G.reorient(A, affine, "LRS")


def test_pad_and_turn():
    b, at = G.pad_to(A, (4, 4, 9), 4)
    assert b.shape == (4, 4, 12) and at == (0, 0, 3)
    assert np.array_equal(b[:3, :, 3:8], A) and np.array_equal(b[3], b[2]) and np.array_equal(b[:, :, 0], b[:, :, 3])
    turn = G.about_axis((0, 0, 2), np.pi / 2)
    assert np.allclose(turn @ [1, 0, 0], [0, 1, 0]) and np.allclose(turn @ turn.T, np.eye(3)) and np.allclose(G.about_axis((0, 0, 0), 1), np.eye(3))


def test_affine_of_a_quaternion():
    raw = bytearray(write_nifti(A, [2.0, 3.0, 4.0]))
    assert np.allclose(read_affine(bytes(raw)), np.diag([2, 3, 4, 1]))
    half = np.sqrt(0.5)  # a quarter turn about z
    raw[252:254] = (1).to_bytes(2, "little")
    raw[256:280] = np.array([0, 0, half, 5, 6, 7], dtype="<f4").tobytes()
    assert np.allclose(read_affine(bytes(raw)), [[0, -3, 0, 5], [2, 0, 0, 6], [0, 0, 4, 7], [0, 0, 0, 1]], atol=1e-6)


def test_source_round_trip(spark, tmp_path):
    spark.dataSource.register(NiftiSource)
    affine = np.array([[2.0, 0, 0, 1], [0, 3, 0, 2], [0, 0, 4, 3], [0, 0, 0, 1]]).ravel().tolist()
    rows = [(f"v{i}", [3, 4, 5], [2.0, 3.0, 4.0], affine, (A + i).ravel().tolist()) for i in range(5)]
    df = spark.createDataFrame(rows, "stem string, shape array<int>, spacing array<double>, affine array<double>, data array<float>")
    out = str(tmp_path / "volumes")
    df.where("stem <> 'v4'").write.format("nifti").mode("append").save(out)
    df.withColumn("data", F.transform("data", lambda x: x * 0)).write.format("nifti").mode("append").save(out)  # only v4 is new
    (tmp_path / "volumes" / "bad.nii").write_bytes(b"no volume")
    (tmp_path / "volumes" / "deep").mkdir()
    (tmp_path / "volumes" / "deep" / "z.NII.GZ").write_bytes(gzip.compress(write_nifti(A, [1, 1, 1])))
    got = {r["stem"]: r for r in spark.read.format("nifti").load(out).collect()}
    assert sorted(got) == ["bad", "v0", "v1", "v2", "v3", "v4", "z"]
    assert got["bad"]["data"] is None and got["bad"]["status"] != "ok"
    assert np.allclose(got["v2"]["data"], (A + 2).ravel()) and got["v2"]["affine"] == affine and got["v2"]["shape"] == [3, 4, 5]
    assert not any(got["v4"]["data"]) and np.allclose(got["z"]["data"], A.ravel())
    df.write.format("nifti").mode("overwrite").save(out)
    assert spark.read.format("nifti").load(out).where("stem = 'v4' and data[0] > 4").count() == 1


def test_dev_split_and_carve(spark):
    from brindle.operators import folds, sampling

    df = spark.createDataFrame([(g, "ab"[(g + i) % 2]) for g in range(20) for i in range(3)], "g long, s string")
    rows = {r["g"]: r["split"] for r in folds.dev_split(df, "g", "s", {"a": 6, "b": 6}, {"a": 3, "b": 3}).collect()}
    sizes = {x: list(rows.values()).count(x) for x in ("test", "val", "train")}
    assert len(rows) == 20 and sizes["test"] == 4 and sizes["val"] == 2 and sizes["train"] == 14
    assigned = df.select("g").distinct().withColumn("fold", (F.col("g") % 4).cast("int"))
    got = folds.carve(df, assigned, "g", "s", 4, 0.2).collect()
    assert len(got) == 80 and len({(r["g"], r["round"]) for r in got}) == 80
    assert all((r["split"] == "test") == (r["g"] % 4 == r["round"]) for r in got) and {r["split"] for r in got} == {"test", "val", "train"}
    odd = spark.createDataFrame([(None,), (1,), (1,), (2,)], "k long")
    assert sorted(r["p"] for r in sampling.shuffled_places(odd, "k", "p").collect()) == [0, 1, 2, 3]
    assert sampling.random_pairs(odd.withColumnRenamed("k", "a"), odd.where("k > 9").withColumnRenamed("k", "b"), "a", "b", 1).count() == 0


def test_places_over_many_ranges(spark):
    from brindle.operators.ordering import in_order

    df = spark.range(0, 5000, 1, 7).select(((F.col("id") * 7919) % 5003).alias("k"), F.lit("x").alias("place_"))
    rows = in_order(df.withColumn("w", F.col("k") % 3 + 0.5), ["k"], "p", "w").collect()
    run = 0.0
    for i, r in enumerate(sorted(rows, key=lambda r: r["k"])):
        run += r["w"]
        assert r["p"] == i and abs(r["until"] - run) < 1e-6
    assert abs(rows[0]["total"] - run) < 1e-6
    assert [r["p"] for r in sorted(in_order(df, [F.desc("k")], "p").collect(), key=lambda r: -r["k"])] == list(range(5000))
    assert in_order(df.where("k < 0"), ["k"], "p").count() == 0
