"""Queries over arrays: an embedding of 64 values is a signal, or a volume of 4 x 4 x 4; its partner is its means of two samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import curves, grids
from ..operators import chunks
from ..operators import kernels as K
from ..operators import registry
from ..operators import sampling
from ..operators import transforms as T
from ..sources import layout
from ..sources.tables import scratch
from ..streaming import stream
from .catalogue import query, table

E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings), s AS (SELECT *, list_transform(range(64), lambda i: (a[(i // 2) * 2 + 1] + a[(i // 2) * 2 + 2]) / 2) AS b FROM e)"
W = "WITH " + E + " "


def signals(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", A.doubles(F.col("embedding")).alias("a"))
    pair = lambda i: F.floor(i / 2).cast("int") * 2
    return e.withColumn("b", F.transform("a", lambda x, i: (F.get("a", pair(i)) + F.get("a", pair(i) + 1)) / 2))


def measure(name, sql, column, digits=6):
    @query(name, W + f"SELECT vec_id, round({sql}, {digits}) AS {name} FROM s")
    def _(spark, sf):
        return signals(spark, sf).select("vec_id", F.round(column(F.col("a"), F.col("b")), digits).alias(name))


def elements(name, sql, column, digits=6):
    @query(name, W + f", v AS (SELECT vec_id, {sql} AS v FROM s) SELECT vec_id, i.i AS pos, round(v[i.i + 1], {digits}) AS x FROM v, range(64) i(i) WHERE i.i < len(v)")
    def _(spark, sf):
        return signals(spark, sf).select("vec_id", F.posexplode(column(F.col("a"), F.col("b"))).alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", digits).alias("x"))


SSE = "list_sum(list_transform(range(1, 65), lambda i: (a[i] - b[i]) * (a[i] - b[i])))"
N = "64.0"
SUM = {k: f"list_sum(list_transform(range(1, 65), lambda i: {v}))" for k, v in {"a": "a[i]", "b": "b[i]", "aa": "a[i] * a[i]", "bb": "b[i] * b[i]", "ab": "a[i] * b[i]"}.items()}
CORR = f"((64 * {SUM['ab']} - {SUM['a']} * {SUM['b']}) / sqrt((64 * {SUM['aa']} - {SUM['a']} * {SUM['a']}) * (64 * {SUM['bb']} - {SUM['b']} * {SUM['b']})))"
measure("mae", "list_sum(list_transform(range(1, 65), lambda i: abs(a[i] - b[i]))) / 64", A.mae)
measure("rmse", f"sqrt({SSE} / 64)", A.rmse)
measure("psnr", f"10 * log10(1.0 / ({SSE} / 64))", A.psnr, 5)
measure("volume_corr", CORR, lambda a, b: A.correlation(A.moments(a, b), F.size(a)))
measure("cor_coe_loss", f"1 - {CORR} * {CORR}", lambda a, b: 1 - F.pow(A.correlation(A.moments(a, b), F.size(a)), F.lit(2)))
MA, MB = f"({SUM['a']} / 64)", f"({SUM['b']} / 64)"
measure("ssim_global", f"(2 * {MA} * {MB} + 0.0001) * (2 * ({SUM['ab']} / 64 - {MA} * {MB}) + 0.0009) / (({MA} * {MA} + {MB} * {MB} + 0.0001) * ({SUM['aa']} / 64 - {MA} * {MA} + {SUM['bb']} / 64 - {MB} * {MB} + 0.0009))", lambda a, b: A.global_ssim(A.moments(a, b), F.size(a)))
measure("center_of_mass", "coalesce(list_avg(list_filter(range(64), lambda i: a[i + 1] > 0.1 * list_max(a))), 31.5)", lambda a, b: A.mass_center(a))
measure("foreground_mean", "list_avg(list_filter(a, lambda x: x > list_aggregate(a, 'quantile_cont', 0.6)))", lambda a, b: A.foreground_mean(a, 0.6, 1))
ABOVE = "list_filter(a, lambda x: x > list_aggregate(a, 'quantile_cont', 0.8))"
measure("foreground_mean_fallback", f"CASE WHEN len({ABOVE}) >= 100 THEN list_avg({ABOVE}) ELSE list_avg(a) END", lambda a, b: A.foreground_mean(a, 0.8))
elements("digitize", "list_transform(a, lambda x: CASE WHEN x >= 0.1 THEN 3.0::DOUBLE WHEN x >= 0 THEN 2.0 WHEN x >= -0.1 THEN 1.0 ELSE 0.0 END)", lambda a, b: F.transform(a, lambda x: A.digitize(x, [-0.1, 0.0, 0.1])))
elements("to01", "list_transform(a, lambda x: least(1.0, greatest(0.0, (x + 1) / 2)))", lambda a, b: A.clip01(a))
elements("minmax255", "list_transform(a, lambda x: (x - list_min(a)) / (list_max(a) - list_min(a)) * 255)", lambda a, b: A.minmax255(a), 4)
elements("window255", "list_transform(a, lambda x: least(255.0, greatest(0.0, (x + 0.2) / 0.4 * 255)))", lambda a, b: A.window255(a, -0.2, 0.2), 4)
elements("invert", "list_transform(a, lambda x: 255 - x)", lambda a, b: A.invert(a))
elements("brightness", "list_transform(a, lambda x: least(list_max(a), greatest(list_min(a), x + 0.1)))", lambda a, b: A.brightness(a, 0.1))
elements("contrast", "list_transform(a, lambda x: least(255.0, greatest(0.0, x + (x - trunc(list_avg(a))) * 15 / 100)))", lambda a, b: A.contrast(a, 15))
elements("gamma", "list_transform(a, lambda x: pow((x - list_min(a)) / (list_max(a) - list_min(a)), 1.5) * 255)", lambda a, b: A.gamma255(a, 1.5), 4)
elements("forward_diff", "list_transform(range(1, 65), lambda i: CASE WHEN i = 1 THEN 0.0 ELSE a[i] - a[i - 1] END)", lambda a, b: A.forward_diff(a))
elements("gradient_sharpness", "list_transform(range(1, 65), lambda i: abs(CASE WHEN i = 1 THEN a[2] - a[1] WHEN i = 64 THEN a[64] - a[63] ELSE (a[i + 1] - a[i - 1]) / 2 END))", lambda a, b: F.transform(A.gradient(a), lambda x: F.abs(x)))
elements("center_slice", "a[17:48]", lambda a, b: A.center_slice(a, 32))
elements("flip", "list_reverse(a)", lambda a, b: F.reverse(a))
elements("zero_fill", "list_concat(list_transform(range(17), lambda i: 0.0), a[1:30], list_transform(range(17), lambda i: 0.0))", lambda a, b: A.zero_fill(F.slice(a, F.lit(1), F.lit(30)), 64))

CUBE = (4, 4, 4)
elements("crop_box", "list_transform(range(12), lambda i: a[(i // 6 + 1) * 16 + (i // 2 % 3) * 4 + i % 2 + 2 + 1])", lambda a, b: grids.crop(a, CUBE, (1, 0, 2), (2, 3, 2)))
elements("flip_axis", "list_transform(range(64), lambda i: a[i // 16 * 16 + (3 - i // 4 % 4) * 4 + i % 4 + 1])", lambda a, b: grids.flip(a, CUBE, 1))
elements("turn_axes", "list_transform(range(64), lambda i: a[i % 4 * 16 + i // 4 % 4 * 4 + 3 - i // 16 + 1])", lambda a, b: grids.quarter_turn(a, CUBE, 0, 2))
elements("pad_box", "list_transform(range(60), lambda i: CASE WHEN i // 30 = 0 OR i // 6 % 5 = 0 OR i % 6 > 3 THEN 0.0 ELSE a[(i // 30 - 1) * 16 + (i // 6 % 5 - 1) * 4 + i % 6 + 1] END)", lambda a, b: grids.pad(grids.crop(a, CUBE, (0, 0, 0), (1, 4, 4)), (1, 4, 4), (1, 1, 0), (0, 0, 2)))
elements("pad_nearest", "list_transform(range(60), lambda i: a[greatest(i // 6 % 5 - 1, 0) * 4 + least(i % 6, 3) + 1])", lambda a, b: grids.pad(grids.crop(a, CUBE, (0, 0, 0), (1, 4, 4)), (1, 4, 4), (1, 1, 0), (0, 0, 2), None))
elements("plane_across", "list_transform(range(16), lambda i: a[i // 4 * 16 + 2 * 4 + i % 4 + 1])", lambda a, b: grids.plane(a, CUBE, 1, 2))


def window(name, sql, column):
    @query(name, f"WITH f AS (SELECT i.i, (i.i - 32) / 64.0 AS f FROM range(64) i(i)) SELECT i, round({sql}, 8) AS w FROM f")
    def _(spark, sf):
        return spark.range(64).select(F.col("id").alias("i"), F.round(column(A.centered_freq(F.col("id"), 64)), 8).alias("w"))


window("tukey_window", "CASE WHEN abs(f) > 0.25 + 1e-12 THEN 0 WHEN abs(f) / 0.25 <= 0.7 THEN 1 ELSE 0.5 * (1 + cos(pi() * (abs(f) / 0.25 - 0.7) / 0.3)) END", lambda f: A.tukey(f, 0.25, 0.3))
window("fermi_window", "1 / (1 + exp((abs(f) / 0.25 - 1) / 0.1))", lambda f: A.fermi(F.abs(f) / 0.25, 1.0, 0.1))
window("gaussian_window", "CASE WHEN abs(f) <= 0.25 THEN exp(-2 * pow(pi() * 1.5 * f, 2)) ELSE 0 END", lambda f: A.gaussian(f, 0.25, 1.5))


@query("pad_plan", "SELECT p_partkey, p_size AS n, (8 - p_size % 8) % 8 AS pad, ((8 - p_size % 8) % 8) // 2 AS before, CAST(round_even(p_size / 4.0, 0) AS BIGINT) - CAST(round_even(p_size / 4.0, 0) AS BIGINT) % 2 AS coarse FROM part")
def _(spark, sf):
    n = F.col("p_size")
    m = F.bround(n / F.lit(4.0), 0).cast("long")
    return table(spark, sf, "part").select("p_partkey", n.alias("n"), F.pmod(-n, F.lit(8)).alias("pad"), F.floor(F.pmod(-n, F.lit(8)) / 2).alias("before"), (m - F.pmod(m, F.lit(2))).alias("coarse"))


@query("sigma_for_snr", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 0 ELSE round(p_retailprice / (p_size % 5) / (2.0 * 2.0 / 1.0), 6) END AS sigma FROM part")
def _(spark, sf):
    snr, gain = F.pmod("p_size", F.lit(5)), A.product(F.array(F.lit(2.0), F.lit(2.0))) / A.product(F.array(F.lit(1.0)))
    return table(spark, sf, "part").select("p_partkey", F.when(snr <= 0, F.lit(0.0)).otherwise(F.round(F.col("p_retailprice") / F.greatest(snr, F.lit(1)) / gain, 6)).alias("sigma"))


@query("resample_plan", "SELECT p_partkey, CAST(ceil(p_size * 1.0 / 0.7) AS BIGINT) AS up, CAST(round_even(p_size * 1.0 / 0.7, 0) AS BIGINT) AS near FROM part")
def _(spark, sf):
    x = F.col("p_size") * 1.0 / 0.7
    return table(spark, sf, "part").select("p_partkey", F.ceil(x).alias("up"), F.bround(x, 0).cast("long").alias("near"))


@query("dezip_plan", "WITH p AS (SELECT p_partkey, p_size, [1.0 + p_partkey % 2, 2.0, 1.5] AS s FROM part) SELECT p_partkey, i.i AS axis, CASE WHEN s[i.i] < list_max(s) * (1 - 1e-3) THEN CAST(round_even(p_size * s[i.i] / list_max(s), 0) AS BIGINT) ELSE p_size END AS kept FROM p, range(1, 4) i(i)")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", F.array(1.0 + F.pmod("p_partkey", F.lit(2)), F.lit(2.0), F.lit(1.5)).alias("s")).withColumn("most", F.array_max("s"))
    return p.select("p_partkey", "p_size", "most", F.posexplode("s").alias("axis", "x")).select("p_partkey", (F.col("axis") + 1).alias("axis"), F.when(F.col("x") < F.col("most") * (1 - 1e-3), F.bround(F.col("p_size") * F.col("x") / F.col("most"), 0).cast("long")).otherwise(F.col("p_size")).alias("kept"))


@query("grid_match_check", "SELECT vec_id, list_max(list_transform(range(1, 65), lambda i: abs(a[i] - b[i]))) < 0.2 AS same FROM (" + W + "SELECT * FROM s)")
def _(spark, sf):
    return signals(spark, sf).select("vec_id", F.forall(F.zip_with("a", "b", lambda x, y: F.abs(x - y)), lambda d: d < 0.2).alias("same"))


@query("sidecar_check", "SELECT event_id, CASE WHEN k <= 50 THEN 'recon' WHEN NOT (abs(k - 60) <= 1 OR abs(k - 70) <= 1) THEN 'axis' END AS warning FROM (SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k FROM events)")
def _(spark, sf):
    k = F.coalesce(F.from_json("props", "k long")["k"], F.lit(0))
    near = F.exists(F.array(F.lit(60), F.lit(70)), lambda m: F.abs(m - k) <= 1)
    return table(spark, sf, "events").select("event_id", F.when(k <= 50, "recon").when(~near, "axis").alias("warning"))


@query("tile_grid", "WITH n AS (SELECT nn.n FROM (VALUES (10),(16),(17)) nn(n)), st AS (SELECT DISTINCT n, least(i.i * 3, n - 8) AS s FROM n, range(10) i(i) WHERE i.i * 3 < n - 8 + 3) SELECT n, x.s AS x, y.s AS y FROM st x JOIN st y USING (n)")
def _(spark, sf):
    n = spark.createDataFrame([(10,), (16,), (17,)], "n int")
    starts = F.array_distinct(F.array_union(F.sequence(F.lit(0), F.col("n") - 8, F.lit(3)), F.array(F.col("n") - 8)))
    return n.withColumn("x", F.explode(starts)).withColumn("y", F.explode(starts))


@query("overlap_add", W + ", t AS (SELECT DISTINCT least(i.i * 12, 48) AS st FROM range(6) i(i)), v AS (SELECT vec_id, st + k.i AS pos, a[st + k.i + 1] AS x FROM s, t, range(16) k(i)) SELECT vec_id, pos, round(sum(x) / count(*), 6) AS x, count(*) AS n FROM v GROUP BY 1, 2")
def _(spark, sf):
    starts = F.array_distinct(F.array_union(F.sequence(F.lit(0), F.lit(48), F.lit(12)), F.array(F.lit(48))))
    tiles = signals(spark, sf).withColumn("at", F.explode(starts)).select("vec_id", "at", F.posexplode(F.slice("a", F.col("at") + 1, F.lit(16))).alias("k", "x"))
    return tiles.groupBy("vec_id", (F.col("at") + F.col("k")).cast("long").alias("pos")).agg(F.round(F.sum("x") / F.count("*"), 6).alias("x"), F.count("*").alias("n"))


@query("gauss_blend_weights", "SELECT i.i, round(greatest(1e-3, exp(-0.5 * pow((i.i - 7.5) / (16 / 6.0), 2))), 8) AS w FROM range(16) i(i)")
def _(spark, sf):
    return spark.range(16).select(F.col("id").alias("i"), F.round(F.greatest(F.lit(1e-3), F.exp(-0.5 * F.pow((F.col("id") - 7.5) / (16 / 6.0), F.lit(2)))), 8).alias("w"))


@query("tile_fit", "WITH t AS (SELECT n.i + 1 AS n, greatest(4, floor(least(16, ceil((n.i + 1) / 4.0) * 4) / 4) * 4)::BIGINT AS tile FROM range(40) n(i)) SELECT n, tile, (ceil(greatest(n, tile) / 4.0) * 4)::BIGINT - n AS pad FROM t")
def _(spark, sf):
    """The tile that a model of multiples of 4 takes on an axis, and what the axis is padded by."""
    tile, pad = A.fitted_tile(F.col("n"), F.lit(16))
    return spark.range(1, 41).withColumnRenamed("id", "n").select("n", tile.alias("tile"), pad.alias("pad"))


@query("perm_inverse", W + ", o AS (SELECT vec_id, i.i AS idx, row_number() OVER (PARTITION BY vec_id ORDER BY a[i.i + 1], i.i) - 1 AS place FROM s, range(64) i(i)) SELECT vec_id, idx, place FROM o")
def _(spark, sf):
    order = F.transform(F.array_sort(F.transform("a", lambda x, i: F.struct(x.alias("x"), i.alias("i")))), lambda p: p["i"])
    return signals(spark, sf).select("vec_id", F.posexplode(order).alias("place", "idx")).select("vec_id", F.col("idx").cast("long").alias("idx"), F.col("place").cast("long").alias("place"))


@query("hf_energy", W + ", d AS (SELECT vec_id, i.i AS n, a[i.i + 1] - list_avg(a) AS x FROM s, range(64) i(i)), p AS (SELECT vec_id, k.i AS k, pow(sum(x * cos(2 * pi() * k.i * n / 64)), 2) + pow(sum(x * sin(2 * pi() * k.i * n / 64)), 2) AS power FROM d, range(64) k(i) GROUP BY 1, 2) SELECT vec_id, round(sum(power) FILTER (least(k, 64 - k) / 64.0 > 0.25) / sum(power), 6) AS hf FROM p GROUP BY 1")
def _(spark, sf):
    return K.per_volume(signals(spark, sf), ["vec_id"], "a", (64,), lambda a: {"hf": round(K.hf_energy(a), 6)}, "hf double").select("vec_id", "hf")


CUBE = (4, 4, 4)
#: The places of a volume; a[16 x + 4 y + z + 1] is the value there.
PLACES = "range(4) x(i), range(4) y(i), range(4) z(i)"
#: Power of the mean-free volume at each frequency (kx, ky, kz) and the distance r from 0, by sums of cosines and sines, axis by axis.
POWER = """d AS (SELECT vec_id, x.i AS x, y.i AS y, z.i AS z, a[x.i * 16 + y.i * 4 + z.i + 1] - list_avg(a) AS re, 0.0 AS im FROM e, range(4) x(i), range(4) y(i), range(4) z(i)),
f1 AS (SELECT vec_id, k.i AS x, y, z, sum(re * cos(pi() * k.i * x / 2) + im * sin(pi() * k.i * x / 2)) AS re, sum(im * cos(pi() * k.i * x / 2) - re * sin(pi() * k.i * x / 2)) AS im FROM d, range(4) k(i) GROUP BY 1, 2, 3, 4),
f2 AS (SELECT vec_id, x, k.i AS y, z, sum(re * cos(pi() * k.i * y / 2) + im * sin(pi() * k.i * y / 2)) AS re, sum(im * cos(pi() * k.i * y / 2) - re * sin(pi() * k.i * y / 2)) AS im FROM f1, range(4) k(i) GROUP BY 1, 2, 3, 4),
f3 AS (SELECT vec_id, x, y, k.i AS z, sum(re * cos(pi() * k.i * z / 2) + im * sin(pi() * k.i * z / 2)) AS re, sum(im * cos(pi() * k.i * z / 2) - re * sin(pi() * k.i * z / 2)) AS im FROM f2, range(4) k(i) GROUP BY 1, 2, 3, 4),
p AS (SELECT vec_id, x, y, z, re * re + im * im AS power, sqrt(pow(least(x, 4 - x) / 4.0, 2) + pow(least(y, 4 - y) / 4.0, 2) + pow(least(z, 4 - z) / 4.0, 2)) AS r FROM f3)"""


def kernel(name, function, schema, sql=None):
    @query(name, sql)
    def _(spark, sf):
        found = K.per_volume(signals(spark, sf), ["vec_id"], "a", CUBE, function, schema)
        return found.drop("status") if sql else found


def _with(steps: str) -> str:
    return f"WITH {E}, {steps} " if steps else f"WITH {E} "


def one(name, function, steps, value, rows, digits=6):
    """A query of one number a volume; its SQL: common tables, the value, and what it is selected from."""

    @query(name, _with(steps) + f"SELECT vec_id, round({value}, {digits}) AS {name} FROM {rows}")
    def _(spark, sf):
        got = K.per_volume(signals(spark, sf), ["vec_id"], "a", CUBE, lambda a: {"v": float(function(a))}, "v double")
        return got.select("vec_id", F.round("v", digits).alias(name))


def places(name, function, steps, values, digits=6):
    """A query of a row for each value that a kernel gives, with its place in C order; its SQL: common tables, and a select of vec_id, pos and v."""

    @query(name, _with(steps) + f"SELECT vec_id, pos, round(v, {digits}) AS x FROM ({values})")
    def _(spark, sf):
        got = K.per_volume(signals(spark, sf), ["vec_id"], "a", CUBE, lambda a: {"values": np.asarray(function(a), dtype=float).ravel().tolist()}, "values array<double>")
        return got.select("vec_id", F.posexplode("values").alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", digits).alias("x"))


def number(name, column, steps, value, rows, digits=6):
    """As one, of an expression over the columns a and b."""

    @query(name, _with(steps) + f"SELECT vec_id, round({value}, {digits}) AS {name} FROM {rows}")
    def _(spark, sf):
        return signals(spark, sf).select("vec_id", F.round(column(F.col("a")), digits).alias(name))


def values(name, column, steps, rows, digits=6):
    """As places, of an expression over the column a."""

    @query(name, _with(steps) + f"SELECT vec_id, pos, round(v, {digits}) AS x FROM ({rows})")
    def _(spark, sf):
        return signals(spark, sf).select("vec_id", F.posexplode(column(F.col("a"))).alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", digits).alias("x"))


def by_place(value: str, shape: tuple[int, int, int] = CUBE) -> str:
    """SQL with a row for each place (x, y, z) of a grid and the value there."""
    n, m, k = shape
    return f"SELECT vec_id, x.i * {m * k} + y.i * {k} + z.i AS pos, {value} AS v FROM e, range({n}) x(i), range({m}) y(i), range({k}) z(i)"


def held(c: str, n: int = 3) -> str:
    return f"least({n}, greatest(0, {c}))"


places("radial_spectrum", lambda a: K.radial_spectrum(a, 8)[1], POWER + ", w AS (SELECT vec_id, least(CAST(floor(r / (sqrt(0.75) / 8) + 1e-9) AS BIGINT), 7) AS bin, power FROM p), g AS (SELECT vec_id, bin, avg(power) AS v FROM w GROUP BY 1, 2)", "SELECT e.vec_id, b.i AS pos, coalesce(v, 0.0) AS v FROM e CROSS JOIN range(8) b(i) LEFT JOIN g ON g.vec_id = e.vec_id AND g.bin = b.i")
places("axis_spectrum", lambda a: K.axis_spectrum(a, 0)[1], POWER.split("f2 AS")[0].rstrip(",\n ") , "SELECT vec_id, x AS pos, avg(re * re + im * im) AS v FROM f1 WHERE x < 2 GROUP BY 1, 2")
one("band_power", lambda a: K.band_power(a, 0.2, 0.45), POWER, "coalesce(sum(power) FILTER (r >= 0.2 AND r < 0.45), 0)", "p GROUP BY 1")
DIFF = {k: f"CASE {k}.i WHEN 0 THEN {b} - {c} WHEN 3 THEN {c} - {d} ELSE ({b} - {d}) / 2 END" for k, (b, c, d) in {"x": ("a[(x.i + 1) * 16 + y.i * 4 + z.i + 1]", "a[x.i * 16 + y.i * 4 + z.i + 1]", "a[(x.i - 1) * 16 + y.i * 4 + z.i + 1]"), "y": ("a[x.i * 16 + (y.i + 1) * 4 + z.i + 1]", "a[x.i * 16 + y.i * 4 + z.i + 1]", "a[x.i * 16 + (y.i - 1) * 4 + z.i + 1]"), "z": ("a[x.i * 16 + y.i * 4 + z.i + 2]", "a[x.i * 16 + y.i * 4 + z.i + 1]", "a[x.i * 16 + y.i * 4 + z.i]")}.items()}
number("sharpness", lambda a: grids.sharpness(a, CUBE), "g AS (SELECT vec_id, sqrt(" + " + ".join(f"pow({DIFF[k]}, 2)" for k in "xyz") + f") AS g FROM e, {PLACES})", "avg(g)", "g GROUP BY 1")
values("percentile_norm", lambda a: grids.scaled(a, a, 0.005, 0.995), "q AS (SELECT vec_id, a, list_aggregate(a, 'quantile_cont', 0.005) AS lo, list_aggregate(a, 'quantile_cont', 0.995) AS hi FROM e)", "SELECT vec_id, i.i AS pos, least(1.0, greatest(0.0, (a[i.i + 1] - lo) / greatest(hi - lo, 1e-12))) AS v FROM q, range(64) i(i)")
values("percentile_norm_foreground", grids.foreground_scaled, "f AS (SELECT vec_id, a, list_filter(a, lambda x: x > list_max(a) * 0.02) AS f FROM e), q AS (SELECT vec_id, a, list_aggregate(f, 'quantile_cont', 0.01) AS lo, list_aggregate(f, 'quantile_cont', 0.99) AS hi FROM f)", "SELECT vec_id, i.i AS pos, least(1.0, greatest(0.0, (a[i.i + 1] - lo) / greatest(hi - lo, 1e-12))) AS v FROM q, range(64) i(i)")
values("percentile_norm_reference", lambda a: grids.scaled(a, F.slice(a, 1, 32), 0.01, 0.995), "q AS (SELECT vec_id, a, list_aggregate(a[1:32], 'quantile_cont', 0.01) AS lo, list_aggregate(a[1:32], 'quantile_cont', 0.995) AS hi FROM e)", "SELECT vec_id, i.i AS pos, least(1.0, greatest(0.0, (a[i.i + 1] - lo) / greatest(hi - lo, 1e-12))) AS v FROM q, range(64) i(i)")
places("blend_fitted", lambda a: K.blend_fitted(a[:3], 6, 4, registry.create("Scaled", factor="2")), "", by_place("2 * a[x.i * 16 + y.i * 4 + z.i + 1]", (3, 4, 4)))
EDGE = " + ".join(f"pow({c}, 2)" for c in ("CASE WHEN x.i > 0 THEN {0} - {1} ELSE 0 END".format("t[x.i * 16 + y.i * 4 + z.i + 1]", "t[(x.i - 1) * 16 + y.i * 4 + z.i + 1]"), "CASE WHEN y.i > 0 THEN {0} - {1} ELSE 0 END".format("t[x.i * 16 + y.i * 4 + z.i + 1]", "t[x.i * 16 + (y.i - 1) * 4 + z.i + 1]"), "CASE WHEN z.i > 0 THEN {0} - {1} ELSE 0 END".format("t[x.i * 16 + y.i * 4 + z.i + 1]", "t[x.i * 16 + y.i * 4 + z.i]")))
number("edge_weighted_l1", lambda a: grids.edge_weighted_l1(a, grids.flip(a, CUBE, 0), CUBE), f"t AS (SELECT vec_id, a, list_concat(a[49:64], a[33:48], a[17:32], a[1:16]) AS t FROM e), g AS (SELECT vec_id, sqrt({EDGE} + 1e-12) AS g, abs(a[x.i * 16 + y.i * 4 + z.i + 1] - t[x.i * 16 + y.i * 4 + z.i + 1]) AS d FROM t, {PLACES}), w AS (SELECT vec_id, d, 1 + 2 * least(1.0, g / (4 * avg(g) OVER (PARTITION BY vec_id))) AS w FROM g)", "sum(w * d) / sum(w)", "w GROUP BY 1")
one("blend_identity", lambda a: np.abs(K.blend(a, 2, 1) - a).max(), "", "CAST(0 AS DOUBLE)", "e")
values("translate", lambda a: grids.translate(a, CUBE, (1, -2, 0)), "", by_place("CASE WHEN x.i >= 1 AND y.i < 2 THEN a[(x.i - 1) * 16 + (y.i + 2) * 4 + z.i + 1] ELSE 0 END"))
values("rotate_quarter", lambda a: grids.quarter_turn(a, CUBE, 0, 1), "", by_place("a[y.i * 16 + (3 - x.i) * 4 + z.i + 1]"))
LAP = " + ".join(f"a[{held('x.i + ' + str(i))} * 16 + {held('y.i + ' + str(j))} * 4 + {held('z.i + ' + str(k))} + 1]" for i, j, k in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)))
values("laplacian", lambda a: grids.laplacian(a, CUBE), "", by_place(LAP + " - 6 * a[x.i * 16 + y.i * 4 + z.i + 1]"))
SOBEL = "o AS (SELECT * FROM (VALUES (-1),(0),(1)) o(o)), n AS (SELECT vec_id, x.i AS x, y.i AS y, z.i AS z, dx.o AS dx, dy.o AS dy, dz.o AS dz, CASE WHEN x.i + dx.o BETWEEN 0 AND 3 AND y.i + dy.o BETWEEN 0 AND 3 AND z.i + dz.o BETWEEN 0 AND 3 THEN a[(x.i + dx.o) * 16 + (y.i + dy.o) * 4 + z.i + dz.o + 1] ELSE -1 END AS v FROM e, range(4) x(i), range(4) y(i), range(4) z(i), o dx, o dy, o dz), g AS (SELECT vec_id, x * 16 + y * 4 + z AS pos, sum(v * dx * (2 - abs(dy)) * (2 - abs(dz))) / 4 AS gx, sum(v * dy * (2 - abs(dx)) * (2 - abs(dz))) / 4 AS gy, sum(v * dz * (2 - abs(dx)) * (2 - abs(dy))) / 4 AS gz FROM n GROUP BY 1, 2)"
values("sobel", lambda a: grids.sobel(a, CUBE), SOBEL, "SELECT vec_id, pos, 2 * ((exp(2 * sqrt(gx * gx + gy * gy + gz * gz)) - 1) / (exp(2 * sqrt(gx * gx + gy * gy + gz * gz)) + 1)) - 1 AS v FROM g")
places("resample_nearest", lambda a: T.resample(a, (1, 1, 1), (0.5, 0.8, 2), "nearest"), "", by_place("a[CAST(floor(least(3.0, x.i * 0.5) + 0.5) AS BIGINT) * 16 + CAST(floor(least(3.0, y.i * 0.8) + 0.5) AS BIGINT) * 4 + CAST(floor(least(3.0, z.i * 2.0) + 0.5) AS BIGINT) + 1]", (8, 5, 2)))
LINEAR = f"c AS (SELECT vec_id, a, x.i * 10 + y.i * 2 + z.i AS pos, least(3.0, x.i * 0.5) AS px, least(3.0, y.i * 0.8) AS py, least(3.0, z.i * 2.0) AS pz FROM e, range(8) x(i), range(5) y(i), range(2) z(i)), b AS (SELECT vec_id, pos, a[least(3, CAST(floor(px) AS BIGINT) + i.i) * 16 + least(3, CAST(floor(py) AS BIGINT) + j.i) * 4 + least(3, CAST(floor(pz) AS BIGINT) + k.i) + 1] * (CASE i.i WHEN 0 THEN 1 - (px - floor(px)) ELSE px - floor(px) END) * (CASE j.i WHEN 0 THEN 1 - (py - floor(py)) ELSE py - floor(py) END) * (CASE k.i WHEN 0 THEN 1 - (pz - floor(pz)) ELSE pz - floor(pz) END) AS v FROM c, range(2) i(i), range(2) j(i), range(2) k(i))"
places("resample_linear", lambda a: T.resample(a, (1, 1, 1), (0.5, 0.8, 2), "linear"), LINEAR, "SELECT vec_id, pos, sum(v) AS v FROM b GROUP BY 1, 2")


def tapped(window: str) -> tuple[str, str]:
    """SQL that resamples the axes by eight taps each, weighted by a window of the distance {d} and normalised; beyond the ends the last value goes on."""
    steps = []
    for axis, step, count in (("x", 0.5, 8), ("y", 0.8, 5), ("z", 2.0, 2)):
        at = f"least(3.0, i.i * {step})"
        weight = window.format(d=f"({at} - floor({at}) - (k.i - 3))")
        steps.append(f"t{axis} AS (SELECT i.i AS i, greatest(0, least(3, CAST(floor({at}) AS BIGINT) + k.i - 3)) AS src, {weight} AS w FROM range({count}) i(i), range(8) k(i))")
        steps.append(f"w{axis} AS (SELECT i, src, sum(w) / sum(sum(w)) OVER (PARTITION BY i) AS w FROM t{axis} GROUP BY 1, 2)")
    return ", ".join(steps), "SELECT vec_id, x.i * 10 + y.i * 2 + z.i AS pos, sum(x.w * y.w * z.w * a[x.src * 16 + y.src * 4 + z.src + 1]) AS v FROM e, wx x, wy y, wz z GROUP BY 1, 2"


SINC = "CASE WHEN abs({d}) < 1e-12 THEN 1.0 WHEN abs({d}) > 4 THEN 0.0 ELSE sin(pi() * {d}) / (pi() * {d}) END"
TAPERS = {
    "hamming": "0.54 + 0.46 * cos(pi() * {d} / 4)", "cosine": "cos(pi() * {d} / 8)", "welch": "1 - {d} * {d} / 16",
    "lanczos": "CASE WHEN abs({d}) < 1e-12 THEN 1.0 ELSE sin(pi() * {d} / 4) / (pi() * {d} / 4) END", "blackman": "0.42 + 0.5 * cos(pi() * {d} / 4) + 0.08 * cos(pi() * {d} / 2)",
}
places("resample_gaussian", lambda a: T.resample(a, (1, 1, 1), (0.5, 0.8, 2), "gaussian"), *tapped("exp(-0.5 * pow({d} / 0.8, 2))"))
for method, taper in TAPERS.items():
    places(f"resample_{method}", lambda a, method=method: T.resample(a, (1, 1, 1), (0.5, 0.8, 2), method), *tapped(f"({SINC}) * ({taper})"))

MASS = "m AS (SELECT vec_id, a, list_aggregate(a, 'quantile_cont', 0.5) AS level FROM e), h AS (SELECT vec_id, avg(x.i) AS cx, avg(y.i) AS cy FROM m, range(4) x(i), range(4) y(i), range(4) z(i) WHERE a[x.i * 16 + y.i * 4 + z.i + 1] > level GROUP BY 1), st AS (SELECT e.vec_id, a, least(2, greatest(0, CAST(round_even(coalesce(cx, 2), 0) AS BIGINT) - 1)) AS sx, least(2, greatest(0, CAST(round_even(coalesce(cy, 2), 0) AS BIGINT) - 1)) AS sy FROM e LEFT JOIN h USING (vec_id))"
values("crop_background", lambda a: grids.crop_about_mass(a, CUBE, (2, 2, 3), A.quantile(a, 0.5)), MASS, "SELECT vec_id, x.i * 6 + y.i * 3 + z.i AS pos, a[(sx + x.i) * 16 + (sy + y.i) * 4 + z.i + 1] AS v FROM st, range(2) x(i), range(2) y(i), range(3) z(i)")
places("regrid_affine", lambda a: T.regrid(np.diag([*(1 + np.abs(a[0, 0, :3])), 1]), (4, 4, 4), (2, 4, 8)), "n AS (SELECT vec_id, [1 + abs(a[1]), 1 + abs(a[2]), 1 + abs(a[3])] AS d, [2.0, 1.0, 0.5] AS g, [0.5, 1.5, 3.5] AS c FROM e)", "SELECT vec_id, r.i * 4 + k.i AS pos, CASE WHEN r.i = 3 THEN CASE WHEN k.i = 3 THEN 1.0 ELSE 0.0 END WHEN k.i = r.i THEN d[r.i + 1] * g[r.i + 1] WHEN k.i = 3 THEN d[r.i + 1] * 1.5 - d[r.i + 1] * g[r.i + 1] * c[r.i + 1] ELSE 0.0 END AS v FROM n, range(4) r(i), range(4) k(i)")

# curves: where a place of the 4 x 4 x 4 grid stands in the order
SPIRAL = "o AS (SELECT x.i AS x, y.i AS y, z.i AS z, least(x.i, y.i, 3 - x.i, 3 - y.i) AS ring FROM range(4) x(i), range(4) y(i), range(4) z(i)), q AS (SELECT *, CASE WHEN x = ring THEN y - ring WHEN y = 3 - ring THEN 3 - 2 * ring + x - ring WHEN x = 3 - ring THEN 2 * (3 - 2 * ring) + 3 - ring - y ELSE 3 * (3 - 2 * ring) + 3 - ring - x END AS step FROM o), r AS (SELECT x * 16 + y * 4 + z AS idx, row_number() OVER (ORDER BY z, CASE WHEN z % 2 = 1 THEN -ring ELSE ring END, CASE WHEN z % 2 = 1 THEN -step ELSE step END) - 1 AS pos FROM q)"
places("scan_spiral", lambda a: a.ravel()[T.curve_order(a.shape, "spiral")], SPIRAL, "SELECT vec_id, pos, a[idx + 1] AS v FROM e, r")
kernel("fg_mask_threshold", lambda a: {"voxels": int(K.foreground(a).sum())}, "voxels long")
kernel("degrade", lambda a: K.degraded_row(a, (2, 2, 1)), "low array<double>, up array<double>, info struct<padded_shape:array<int>,pad_before:array<int>,lowres_shape:array<int>,keep_fraction:array<double>,mode:string,foreground_mean:double,noise_sigma:double>")
kernel("ssim3d", lambda a: {"ssim": K.ssim(a, K.degrade(np.abs(a), (2, 2, 2))["up"])}, "ssim double")
kernel("audit_derived", T.audit, "hf025 double, f99 array<double>, eff_mm double, worst_axis string, cliff double, shape string, spacing string")
kernel("resample_bspline", lambda a: {"values": T.resample(a, (1, 1, 1), (0.5, 0.8, 2), "bspline").ravel().tolist()}, "values array<double>")
kernel("conform_spacing", lambda a: {"values": T.resample(a, (1, 1, 1), (0.8, 0.8, 0.8), "bspline", centred=True).ravel().tolist()}, "values array<double>")
kernel("rotate", lambda a: {"values": T.rotate(a, (10, -20, 90)).ravel().tolist()}, "values array<double>")
kernel("crop_kspace", lambda a: {"values": T.crop_kspace(a, (0.5, 1, 1)).ravel().tolist()}, "values array<double>")
kernel("deform", lambda a: {"values": T.deform(a, T.seeded(1, a), size=1.0).ravel().tolist()}, "values array<double>")
kernel("equalise", lambda a: {"values": T.equalise(a, radius=1).ravel().tolist()}, "values array<double>")
kernel("random_crop", lambda a: dict(zip(("start", "share"), T.random_crop(a, (2, 2, 2), T.seeded(2, a)))), "start array<int>, share double")
kernel("confidence_crop", lambda a: {"start": T.confidence_crop(a > np.percentile(a, 80), (2, 2, 2), T.seeded(3, a))}, "start array<int>")
kernel("augment", lambda a: dict(zip(("change", "values"), (lambda n, v: (n, v.ravel().tolist()))(*T.augment(a, T.seeded(4, a))))), "change string, values array<double>")
kernel("augment_pair", lambda a: dict(zip(("input", "target"), (v.ravel().tolist() for v in T.augment_pair(K.degrade(a, (2, 2, 2))["up"], a, T.seeded(5, a))))), "input array<double>, target array<double>")


@query("random_degrade")
def _(spark, sf):
    def drawn(a: np.ndarray, vec_id: int) -> dict:  # a volume draws by its name and the epoch, so epochs differ
        return {"epochs": [T.random_degrade(a, np.random.default_rng(T.named_seed(6, vec_id, epoch))).ravel().tolist() for epoch in range(2)]}

    return K.per_volume(signals(spark, sf), ["vec_id"], "a", CUBE, drawn, "epochs array<array<double>>", named=True)


kernel("all_metrics", lambda a: T.all_metrics(K.degrade(a, (2, 2, 2))["up"], a, K.foreground(a)), ", ".join(f"{n} double" for n in ("psnr", "mae", "rmse", "ssim", "sharpness_pred", "sharpness_target", "hf_energy_pred", "hf_energy_target", "psnr_masked", "mae_masked")))
kernel("headroom_db", lambda a: T.headroom(a), "db double, share double")
for kind in ("hilbert", "slices"):
    kernel(f"scan_{kind}", lambda a, kind=kind: {"values": a.ravel()[T.curve_order(a.shape, kind)].tolist()}, "values array<double>")


@query("grid_crops", "WITH g AS (SELECT vec_id, x.i * 2 AS x, y.i * 2 AS y, z.i * 2 AS z FROM embeddings, range(2) x(i), range(2) y(i), range(2) z(i)), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY md5(concat_ws(':', 7, vec_id, x, y, z))) AS n FROM g) SELECT vec_id, x, y, z FROM r WHERE n <= 3")
def _(spark, sf):
    return sampling.grid_crops(table(spark, sf, "embeddings").select("vec_id"), "vec_id", (4, 4, 4), 2, 3, 7)


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, sf):
    return stream.windowed(table(spark, sf, "events")).withColumn("total", F.round("total", 4))


@query("log_every_n", "SELECT event_id, value FROM events WHERE event_id % 50 = 0")
def _(spark, sf):
    return stream.every_nth(table(spark, sf, "events").select("event_id", "value"), "event_id", 50)


def _differences_sql(central: bool) -> str:
    """Differences of every voxel of a 4 x 4 x 4 volume along each axis, by windows over its lines."""
    v = "v AS (SELECT vec_id, i // 16 AS x, i // 4 % 4 AS y, i % 4 AS z, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) t(i))"
    parts = []
    for axis in "xyz":
        others = ", ".join(a for a in "xyz" if a != axis)
        after, before = [f"{f}(v) OVER (PARTITION BY vec_id, {others} ORDER BY {axis})" for f in ("lead", "lag")]
        d = f"CASE WHEN {before} IS NULL THEN {after} - v WHEN {after} IS NULL THEN v - {before} ELSE ({after} - {before}) / 2 END" if central else f"coalesce({after} - v, 0)"
        parts.append(f"SELECT '{axis}' AS axis, vec_id, x, y, z, round({d}, 6) AS value FROM v")
    return f"WITH {v} " + " UNION ALL ".join(parts)


def _chunk_differences(spark, sf, central):
    """Along each axis, over volumes in chunks of 2 x 2 x 2."""
    c = chunks.chunked(table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("data")), "vec_id", "data", (4, 4, 4), (2, 2, 2))
    parts = [chunks.voxels(chunks.differences(c, "vec_id", (2, 2, 2), k, central), "vec_id", (2, 2, 2)).withColumn("axis", F.lit(axis)) for k, axis in enumerate(chunks.AXES)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("axis", "vec_id", "x", "y", "z", F.round("value", 6).alias("value"))


@query("chunk_forward_diff", _differences_sql(False))
def _(spark, sf):
    return _chunk_differences(spark, sf, False)


@query("chunk_central_diff", _differences_sql(True))
def _(spark, sf):
    return _chunk_differences(spark, sf, True)


@query("curve_key", "SELECT event_id, " + " + ".join(f"(CAST(floor(least(value / 1000, 0.999) * 256) AS BIGINT) // {1 << i} % 2) * {1 << 2 * i} + (user_id % 256 // {1 << i} % 2) * {1 << 2 * i + 1}" for i in range(8)) + " AS place FROM events")
def _(spark, sf):
    """Place on the Z-order curve of value (in 256 steps) and user."""
    x = F.floor(F.least(F.col("value") / 1000, F.lit(0.999)) * 256).cast("long")
    return table(spark, sf, "events").select("event_id", curves.morton([x, F.pmod("user_id", F.lit(256))], 8).alias("place"))


@query("curve_box", "SELECT event_id FROM events WHERE user_id BETWEEN 20 AND 60 AND value BETWEEN 5 AND 30")
def _(spark, sf):
    """A box of users and values out of a table laid out along a Hilbert curve."""
    at = scratch(spark, "curve")
    layout.write_by_curve(table(spark, sf, "events"), at, ["user_id", "value"], 16)
    return spark.read.parquet(at).where("user_id between 20 and 60 and value between 5 and 30").select("event_id")
