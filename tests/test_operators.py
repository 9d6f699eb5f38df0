import fnmatch
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import SF

from brindle.functions import arrays as A
from brindle.functions import names as N
from brindle.functions.stats import finite, t_critical, with_interval
from brindle.operators import folds, kernels, pairing, registry, sampling, summaries, transforms
from brindle.plans.catalogue import QUERIES
from brindle.sources import tables, volume
from brindle.streaming import stream


def test_t_critical_against_published_values():
    for df, want in ((1, 12.706), (2, 4.303), (5, 2.571), (10, 2.228), (30, 2.042), (1000, 1.962)):
        assert t_critical(df) == pytest.approx(want, abs=6e-4)


def test_intervals_of_few_values(spark):
    values = [("none", float("nan")), ("one", 2.0), ("one", float("inf")), ("two", 1.0), ("two", 3.0), ("three", 1.0), ("three", 2.0), ("three", 6.0)]
    v = spark.createDataFrame(values, "g string, x double").withColumn("x", finite(F.col("x")))
    g = v.groupBy("g").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    got = {r["g"]: (r["n"], r["mean"], r["hw"]) for r in with_interval(g).collect()}
    assert got["none"] == (0, None, None) and got["one"] == (1, 2.0, None)
    assert got["two"] == (2, 2.0, pytest.approx(12.7062, abs=1e-3)) and got["three"] == (3, 3.0, pytest.approx(4.30265 * 7**0.5 / 3**0.5, abs=1e-4))


def test_ci95_all_takes_every_finite_row(spark):
    finite_rows = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_linenumber <> 7").count()
    assert QUERIES["ci95_all"](spark, SF).agg(F.sum("n")).first()[0] == finite_rows


def test_long_names_whole(spark):
    names = spark.createDataFrame([("a1" + "0" * 25,), ("a2" + "0" * 24,), ("a007",), ("a10",)], "n string")
    assert [r[0] for r in names.orderBy(N.natural_key(F.col("n"))).collect()] == ["a007", "a10", "a2" + "0" * 24, "a1" + "0" * 25]
    long = "x" * 10_000
    have, want = (spark.createDataFrame([(p + long + "a", "1")], "name string, shape string") for p in ("module.", ""))
    assert [r["status"] for r in pairing.reconcile_shapes(have, want).collect()] == ["loaded"]


def test_names(spark):
    rows = spark.createDataFrame([("/a/b/12345_02_2.2_t1w.nii.gz",), ("x_01_0.5y_T1w.NII",), ("a__1_t1w.mha",), ("one_two_three",), ("9_1_06mo_t2w",)], "p string")
    s = rows.select(N.strip_ext(F.col("p")).alias("s"))
    got = [r[0] for r in s.collect()]
    assert got == ["12345_02_2.2_t1w", "x_01_0.5y_T1w", "a__1_t1w", "one_two_three", "9_1_06mo_t2w"]
    assert [r[0] for r in s.select(N.fault(F.col("s"))).collect()] == [None, None, "empty:session", "tokens:3", None]
    assert [r[0] for r in s.select(N.age_number(N.field(F.col("s"), 2))).collect()] == [2.2, 0.5, 1.0, None, 6.0]
    assert [r[0] for r in s.select(N.subgroup(N.field(F.col("s"), 3))).collect()] == ["t1w", "t1w", "t1w", "unknown", "t2w"]
    names = spark.createDataFrame([("10.nii",), ("9.nii",), ("a2",), ("a10",), ("",)], "n string")
    assert [r[0] for r in names.orderBy(N.natural_key(F.col("n"))).collect()] == ["", "9.nii", "10.nii", "a2", "a10"]
    assert N.parse_counts("t1w=8;T2w=3,T1W=2") == {"t1w": 2, "t2w": 3}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "g string, s string")
    assert folds.kfold_groups(none, "g", "s", 3).count() == 0
    assert sampling.balance_weights(none, "s", 0.5, 2).count() == 0


def test_kfold_keeps_groups_whole_and_even(spark):
    df = spark.createDataFrame([(f"g{i % 17}", "ab"[(i // 3) % 2]) for i in range(200)], "g string, s string")
    got = folds.kfold_groups(df, "g", "s", 4, seed=3).collect()
    assert len(got) == 17 and len({r["g"] for r in got}) == 17
    sizes = np.bincount([r["fold"] for r in got for _ in range(200 // 17)])
    assert sizes.max() - sizes.min() <= 2 * (200 // 17)


def test_quota_split_meets_quotas(spark):
    df = spark.createDataFrame([(f"g{i % 9}", "ab"[i % 2]) for i in range(90)], "g string, s string")
    taken = [r["g"] for r in folds.quota_split(df, "g", "s", {"a": 7, "b": 7}).collect()]
    rows = df.where(F.col("g").isin(taken)).groupBy("s").count().collect()
    assert all(r["count"] >= 7 for r in rows)


def test_cap_shares(spark):
    g = spark.createDataFrame([("a", 90.0), ("b", 6.0), ("c", 3.0), ("d", 1.0)], "k string, w double")
    s = {r["k"]: r["share"] for r in sampling.cap_shares(g, "k", "w", 0.5).collect()}
    assert s["a"] == 0.5 and sum(s.values()) == pytest.approx(1) and s["b"] == pytest.approx(0.3)
    assert {r["share"] for r in sampling.cap_shares(g, "k", "w", 0.1).collect()} == {0.25}


def test_psnr_of_equal_arrays_is_infinite(spark):
    a = F.array(F.lit(1.0), F.lit(2.0))
    assert math.isinf(spark.range(1).select(A.psnr(a, a)).first()[0])


def _phantom(n=12):
    x = np.stack(np.meshgrid(*[np.linspace(-1, 1, n)] * 3, indexing="ij"))
    return np.where((x**2).sum(0) < 0.6, 100.0, 0) + np.where((x**2).sum(0) < 0.2, 50.0, 0)


def test_kernels():
    a = _phantom()
    assert np.abs(kernels.blend(a, 8, 4) - a).max() < 1e-9
    d = kernels.degrade(a, (2, 2, 2))
    assert d["low"].shape == (6, 6, 6) and d["up"].shape == a.shape
    assert kernels.hf_energy(d["up"]) < kernels.hf_energy(a)
    whole = kernels.degrade(a, (1, 1, 1), mode="kspace")
    assert np.abs(whole["up"] - a).max() < 1e-9
    assert kernels.ssim(a, a) == pytest.approx(1) and kernels.ssim(a / 150, d["up"] / 150) < 1
    mask = kernels.foreground(a)
    assert mask[6, 6, 6] and not mask[0, 0, 0]
    assert kernels.tile_starts(10, 4, 3) == [0, 3, 6] and kernels.tile_starts(11, 4, 3) == [0, 3, 6, 7]
    noisy = [kernels.degrade(a, (2, 2, 2), snr=20, seed=5)["low"] for _ in range(2)]
    assert (noisy[0] == noisy[1]).all()


def test_forward_model():
    rng = np.random.default_rng(0)
    a = np.abs(rng.normal(10, 3, (32, 32, 32)))
    power = lambda b: kernels.axis_spectrum(b, 0)
    f, p = power(kernels.degrade(a, (2, 2, 2), mode="kspace")["up"])
    assert p[(f > 0.05) & (f < 0.24)].mean() > 20 * p[f > 0.27].mean()  # nothing is left beyond the coarse Nyquist frequency
    odd = kernels.degrade(a[:13, :10, :7], (2, 2, 2))
    assert odd["up"].shape == (13, 10, 7) and odd["info"]["padded_shape"] == [16, 12, 8] and odd["info"]["pad_before"] == [1, 1, 0] and odd["info"]["lowres_shape"] == [8, 6, 4] == list(odd["low"].shape)
    plain, gained, fixed = (kernels.degrade(a, (2, 2, 2), snr=s, voxel_gain=g, seed=1) for s, g in ((0, True), (20, True), (20, False)))
    assert plain["info"]["noise_sigma"] == 0 and fixed["info"]["noise_sigma"] == pytest.approx(fixed["info"]["foreground_mean"] / 20) == pytest.approx(8 * gained["info"]["noise_sigma"])
    assert np.abs(fixed["low"] - plain["low"]).std() > 4 * np.abs(gained["low"] - plain["low"]).std()
    windows = {m: kernels.kspace_window((16, 16, 16), (0.5, 0.5, 0.5), m) for m in ("fermi", "kspace", "kspace_hann", "gaussian", "slab")}
    assert windows["fermi"][8, 8, 8] == pytest.approx(1 / (1 + np.exp(-9))) and set(np.unique(windows["kspace"])) == {0.0, 1.0}
    assert windows["kspace_hann"][8, 8, 8] == 1 and windows["kspace_hann"][4, 8, 8] == pytest.approx(0, abs=1e-9) and windows["kspace_hann"][6, 8, 8] == pytest.approx(0.5)
    width = 1.2 / 0.5 / kernels.FWHM
    assert windows["slab"][8, 6, 10] == pytest.approx(np.exp(-2 * (np.pi * width * 2 / 16) ** 2)) and windows["slab"][4, 8, 8] == 1
    assert np.abs(kernels.kspace_window((16,), (0.5,), "kspace", apod=1.0) - windows["kspace_hann"][:, 8, 8]).max() < 1e-12
    with pytest.raises(ValueError):
        kernels.kspace_window((4,), (0.5,), "none")


def test_spectra_are_mean_free():
    a = 1000 + np.random.default_rng(1).normal(size=(8, 8, 8))
    centres, power = kernels.radial_spectrum(a)
    assert len(centres) == len(power) == 64 and power[0] < 1e-6 and np.allclose(np.diff(centres), centres[1] - centres[0])
    f, p = kernels.axis_spectrum(a, 1)
    assert f.tolist() == [0, 0.125, 0.25, 0.375] and p[0] < 50 and kernels.axis_spectrum(a, 1, bins=2)[0].tolist() == [0.09375, 0.28125]


def test_foreground_at_the_border():
    a = np.zeros((6, 6, 6))
    a[0:3, 1:4, 1:4] = 1  # touches the border
    assert kernels.foreground(a, 50).sum() == a[1:].sum()  # closing lets go of what lies at the border


def test_audit_and_headroom():
    a = _phantom(24)
    found = transforms.audit(a, (1.0, 1.0, 2.0))
    assert found["worst_axis"] in "xyz" and found["spacing"] == "1.00,1.00,2.00" and len(found["f99"]) == 3 and found["eff_mm"] >= 1
    assert found["shape"] != "24x24x24" and transforms.audit(a, masked=False)["shape"] == "24x24x24"
    assert 10 < transforms.headroom(a)["db"] < 60


def test_draws_by_name_and_epoch(spark):
    got = spark.range(1).select(sampling.stable_seed(F.lit(6), F.lit("v1"), F.lit(2))).first()[0]
    assert got == transforms.named_seed(6, "v1", 2) != transforms.named_seed(6, "v1", 3)


@pytest.mark.parametrize("shape", [(4, 4, 4), (3, 5, 4), (5, 2, 3), (1, 4, 2)])
def test_spiral_steps_to_neighbours(shape):
    order = transforms.curve_order(shape, "spiral")
    at = np.stack(np.unravel_index(order, shape), axis=1)
    assert sorted(order) == list(range(int(np.prod(shape)))) and (np.abs(np.diff(at, axis=0)).sum(1) == 1).all()


def test_globs():
    rng = random.Random(1)
    for _ in range(20_000):
        pattern, text = "".join(rng.choice("ab-!]^[c*?1&~") for _ in range(rng.randint(0, 6))), "".join(rng.choice("ab-!]^[c1&~") for _ in range(rng.randint(0, 4)))
        assert bool(re.match(N.glob_regex(pattern), text)) == fnmatch.fnmatchcase(text, pattern), (pattern, text)


def test_places_within_few_groups(spark):
    df = spark.createDataFrame([(g, i) for g in ("a", "b", None) for i in range(40)], "g string, i int")
    got = {(r["g"], r["i"]): r["p"] for r in pairing.ranked(df, "p", "g", F.desc("i"), few=True).collect()}
    assert got == {(g, i): 39 - i for g in ("a", "b", None) for i in range(40)}


def test_discover_falls_back(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/m.csv").write_text("x\n1\n")
    assert [r[0].split("/")[-2] for r in tables.discover(spark, str(tmp_path), "m.csv").collect()] == ["b"]
    (tmp_path / "a/m.csv").write_text("x\n1\n")
    assert [r[0].split("/")[-2] for r in tables.discover(spark, str(tmp_path), "m.csv").collect()] == ["a"]


def test_windows_of_a_stream(spark, tmp_path):
    at = str(tmp_path / "events")
    spark.sql("select timestamp_seconds(id * 600) as ts, 'k' as event_type, 'u' as user_id, 1.0 as value from range(12)").coalesce(1).write.parquet(at)
    source = spark.readStream.schema("ts timestamp, event_type string, user_id string, value double").parquet(at)
    for name, df in (("one", stream.windowed(source)), ("two", stream.sliding(source, "1 hour", "30 minutes")), ("three", stream.sessions(source, "user_id", "1 hour"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(name).agg(F.sum("n")).first()[0] == (24 if name == "two" else 12)


def test_bad_volume_gives_a_status(spark):
    df = spark.createDataFrame([(1, [1.0] * 8), (2, [1.0] * 7), (3, None)], "i long, a array<double>")
    got = {r["i"]: r["status"] for r in kernels.per_volume(df, ["i"], "a", (2, 2, 2), lambda a: {"m": float(a.mean())}, "m double").collect()}
    assert got[1] == "ok" and got[2] == "ValueError" and got[3] != "ok"


def test_volume_source(spark, tmp_path):
    a = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    (tmp_path / "s1_01_2_t1w.nii").write_bytes(volume.write_nifti(a, [1.0, 1.0, 2.5]))
    (tmp_path / "bad.nii").write_bytes(b"no")
    (tmp_path / ".hidden.nii").write_bytes(b"no")
    got = {r["stem"]: r for r in volume.read_volumes(spark, str(tmp_path)).collect()}
    assert set(got) == {"s1_01_2_t1w", "bad"} and got["bad"]["status"] != "ok"
    assert got["s1_01_2_t1w"]["shape"] == [2, 3, 4] and got["s1_01_2_t1w"]["spacing"] == [1.0, 1.0, 2.5] and got["s1_01_2_t1w"]["data"] == a.ravel().tolist()
    assert volume.list_files(spark, str(tmp_path)).count() == 2


def test_tables(spark, tmp_path):
    (tmp_path / "f0").mkdir()
    (tmp_path / "f0/per_volume.csv").write_text("stem,fold,pred\na,,1.5\nb,3,abc\nc,4,inf\n")
    rows = {r["stem"]: r for r in volume.read_metrics(spark, [str(tmp_path / "f0/per_volume.csv")], ["stem", "subgroup", "fold"], ["pred", "more"]).collect()}
    assert rows["a"]["fold"] == "f0" and rows["a"]["subgroup"] == "unknown" and rows["b"]["pred"] is None and rows["c"]["pred"] is None and rows["a"]["pred"] == 1.5
    (tmp_path / "list.txt").write_text(" a \n\n# no\nb\na\n")
    assert sorted(r[0] for r in volume.read_list(spark, str(tmp_path / "list.txt")).collect()) == ["a", "b"]
    (tmp_path / "folds.json").write_text('{"mode":"rotate","folds":[{"fold":"0","train":["a"],"val":["b"],"test":["c"]}]}')
    assert sorted(tuple(r) for r in volume.read_folds(spark, str(tmp_path / "folds.json")).collect()) == [("0", "test", "c"), ("0", "train", "a"), ("0", "val", "b")]


def test_streams(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows = spark.range(120).select(F.col("id").alias("event_id"), (F.col("id") % 3).cast("string").alias("event_type"))
    rows.where("event_id < 60").coalesce(1).write.parquet(src)
    stream.ingest(spark, src, rows.schema, out, mark)
    rows.where("event_id >= 60").coalesce(1).write.mode("append").parquet(src)
    stream.ingest(spark, src, rows.schema, out, mark)
    assert spark.read.parquet(out).count() == 120 and spark.read.parquet(out).distinct().count() == 120
    pooled = stream.pool(spark.readStream.schema(rows.schema).parquet(src), "event_type", "event_id", size=5)
    q = pooled.writeStream.format("memory").queryName("pooled").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("pooled").collect()
    assert len(got) == 120 and all(r["item_out"] % 3 == int(r["event_type"]) for r in got) and any(r["item_in"] != r["item_out"] for r in got)


def test_quota_split_by_profiles_takes_the_same_groups(spark, monkeypatch):
    rows = [(f"g{i}", s) for i in range(40) for s in "ab"[: 1 + i % 2] * (1 + i % 3)]
    df = spark.createDataFrame(rows, "g string, s string")
    taken = lambda: sorted(r["g"] for r in folds.quota_split(df, "g", "s", {"a": 9, "b": 4}).collect())
    every = taken()
    counts = {}
    for g, s in rows:
        counts.setdefault(g, {}).setdefault(s, 0)
        counts[g][s] += 1
    need, left, plain = {"a": 9, "b": 4}, dict(counts), []
    while any(v > 0 for v in need.values()):
        keyed = [(sum(c.values()) - 2 * u, sum(c.values()) - u, -u, sum(c.values()), g) for g, c in left.items() if (u := sum(min(n, max(0, need[s])) for s, n in c.items()))]
        if not keyed:
            break
        g = min(keyed)[-1]
        for s, n in left.pop(g).items():
            need[s] -= n
        plain.append(g)
    assert every == sorted(plain)
    df = df.union(spark.createDataFrame([(f"z{i}", "a") for i in range(200)], "g string, s string"))
    every = taken()
    monkeypatch.setattr(folds, "MOST_GROUPS", 150)
    assert taken() == every
    monkeypatch.setattr(folds, "MOST_GROUPS", 20)
    with pytest.raises(ValueError):
        taken()


def test_coverage_of_unknown_shapes_and_of_nothing(spark):
    have = spark.createDataFrame([("module.a", [2, 3]), ("module.n.running_mean", [2])], "name string, shape array<int>")
    want = spark.createDataFrame([("a", [2, 3]), ("b", [None])], "name string, shape array<int>")
    matched = pairing.reconcile_shapes(have, want, left_out=pairing.BUFFERS)
    assert {(r["name"], r["status"]) for r in matched.collect()} == {("a", "loaded"), ("b", "missing")}
    r = pairing.coverage(matched).first()
    assert r["tensors"] == r["guard"] == 0.5 and math.isnan(r["elements"])
    r = pairing.coverage(pairing.reconcile_shapes(have, want.limit(0))).first()
    assert r["tensors"] == r["elements"] == r["guard"] == 0


def test_scored_rows_of_an_empty_table_and_of_null_flags(spark):
    df = spark.createDataFrame([(1, 1), (2, None), (3, 0)], "k int, low int")
    assert {r["k"] for r in pairing.scored(df, "low").where("scored").collect()} == {2, 3}
    assert pairing.scored(df.limit(0), "low").count() == 0


def test_power_edge_of_few_bins_and_of_no_power(spark):
    rows = [(1, i, 1.0) for i in range(5)] + [(2, i, 1.0) for i in range(2)] + [(3, i, 0.0) for i in range(5)]
    got = {r["k"]: r["edge"] for r in summaries.power_edge(spark.createDataFrame(rows, "k int, f int, p double"), "k", "f", "p", 0.5).collect()}
    assert got[1] == pytest.approx(np.interp(0.5, np.cumsum([0, 1, 1, 1, 1]) / 4, range(5))) and math.isnan(got[2]) and math.isnan(got[3])


def test_models_by_name_and_option_lists():
    a = np.arange(3 * 5 * 9, dtype=float).reshape(3, 5, 9)
    shapes = set()

    def seen(x):
        shapes.add(x.shape)
        return x

    assert np.allclose(kernels.blend_fitted(a, 6, 4, seen), a) and shapes == {(4, 4, 4)}
    assert np.allclose(registry.create("SCALED", factor="3")(a), 3 * a) and registry.create("identity")(a) is a
    for name, given in (("absent", {}), ("scaled", {"other": 1})):
        with pytest.raises(KeyError):
            registry.create(name, **given)
    assert registry.three(["96"]) == [96, 96, 96] and registry.three((1, 2, 3)) == [1, 2, 3] and registry.three(None) is None
    with pytest.raises(ValueError):
        registry.three([1, 2])
    assert registry.numbers("0, 2,-1") == [0, 2]
