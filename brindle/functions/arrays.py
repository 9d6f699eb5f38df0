"""Array kernels as expressions over array<double> columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def mae(a: Column, b: Column) -> Column:
    return mean(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def mse(a: Column, b: Column) -> Column:
    return mean(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def rmse(a: Column, b: Column) -> Column:
    return F.sqrt(mse(a, b))


def psnr(a: Column, b: Column, span: float = 1.0) -> Column:
    """Infinite for equal arrays."""
    return F.when(mse(a, b) <= 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(span * span) / mse(a, b)))


def moments(a: Column, b: Column) -> Column:
    """Sums of a, b, a², b² and ab in one pass."""
    start = F.struct(*[F.lit(0.0).alias(k) for k in ("a", "b", "aa", "bb", "ab")])
    return F.aggregate(F.arrays_zip(a.alias("x"), b.alias("y")), start, lambda s, p: F.struct((s["a"] + p["x"]).alias("a"), (s["b"] + p["y"]).alias("b"), (s["aa"] + p["x"] * p["x"]).alias("aa"), (s["bb"] + p["y"] * p["y"]).alias("bb"), (s["ab"] + p["x"] * p["y"]).alias("ab")))


def correlation(m: Column, n: Column) -> Column:
    """Pearson's r from moments and the number of elements."""
    return (n * m["ab"] - m["a"] * m["b"]) / F.sqrt((n * m["aa"] - m["a"] * m["a"]) * (n * m["bb"] - m["b"] * m["b"]))


def global_ssim(m: Column, n: Column, span: float = 1.0) -> Column:
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    ma, mb = m["a"] / n, m["b"] / n
    va, vb, cov = m["aa"] / n - ma * ma, m["bb"] / n - mb * mb, m["ab"] / n - ma * mb
    return (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))


def clip01(a: Column) -> Column:
    return F.transform(a, lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x + 1) / 2)))


def minmax255(a: Column) -> Column:
    return F.transform(a, lambda x: (x - F.array_min(a)) / (F.array_max(a) - F.array_min(a)) * 255)


def window255(a: Column, low: float, high: float) -> Column:
    return F.transform(a, lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), (x - low) / (high - low) * 255)))


def invert(a: Column) -> Column:
    return F.transform(a, lambda x: 255 - x)


def brightness(a: Column, shift: float) -> Column:
    """Shifted, within the range that the array had."""
    return F.transform(a, lambda x: F.least(F.array_max(a), F.greatest(F.array_min(a), x + shift)))


def contrast(a: Column, percent: float) -> Column:
    """Differences from the whole part of the mean grown by a percentage, within 0 to 255."""
    middle = mean(a).cast("long")
    return F.transform(a, lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), x + (x - middle) * percent / 100)))


def gamma255(a: Column, power: float) -> Column:
    """A power of the array's own range, on 0 to 255."""
    return F.transform(a, lambda x: F.pow((x - F.array_min(a)) / (F.array_max(a) - F.array_min(a)), F.lit(power)) * 255)


def forward_diff(a: Column) -> Column:
    """a[i] - a[i-1], 0 first."""
    return F.transform(a, lambda x, i: F.when(i == 0, F.lit(0.0)).otherwise(x - F.get(a, i - 1)))


def gradient(a: Column) -> Column:
    """Central differences, one-sided at the ends."""
    n = F.size(a)
    return F.transform(a, lambda x, i: F.when(i == 0, F.get(a, F.lit(1)) - x).when(i == n - 1, x - F.get(a, i - 1)).otherwise((F.get(a, i + 1) - F.get(a, i - 1)) / 2))


def center_slice(a: Column, m: int) -> Column:
    return F.slice(a, F.floor((F.size(a) - m) / 2).cast("int") + 1, F.lit(m))


def zero_fill(a: Column, n: int) -> Column:
    before = F.floor((n - F.size(a)) / 2).cast("int")
    return F.concat(F.array_repeat(F.lit(0.0), before), a, F.array_repeat(F.lit(0.0), n - F.size(a) - before))


def centered_freq(i: Column, n: int) -> Column:
    return (i - n // 2) / F.lit(float(n))


def tukey(f: Column, kmax: float, apod: float) -> Column:
    """1 inside, cosine flank of the share apod, 0 beyond kmax."""
    r = F.abs(f) / kmax
    flank = 0.5 * (1 + F.cos(math.pi * (r - (1 - apod)) / max(apod, 1e-12)))
    return F.when(F.abs(f) > kmax + 1e-12, F.lit(0.0)).when((r <= 1 - apod) | F.lit(apod <= 0), F.lit(1.0)).otherwise(flank)


def fermi(dv: Column, p1: float, p2: float) -> Column:
    return 1 / (1 + F.exp((dv - p1) / p2))


def gaussian(f: Column, kmax: float, sigma: float) -> Column:
    return F.when(F.abs(f) <= kmax, F.exp(-2 * F.pow(math.pi * sigma * f, F.lit(2)))).otherwise(F.lit(0.0))


def mass_center(a: Column, share: float = 0.1) -> Column:
    """Mean index of the elements above a share of the largest; the middle if there is none."""
    at = F.filter(F.transform(a, lambda x, i: F.when(x > share * F.array_max(a), i.cast("double"))), lambda x: x.isNotNull())
    return F.when(F.size(at) > 0, mean(at)).otherwise((F.size(a) - 1) / 2)


def product(a: Column) -> Column:
    return F.aggregate(a, F.lit(1.0), lambda s, x: s * x)


def statistical255(a: Column, sigmas: float) -> Column:
    """The window of so many standard deviations about the mean, scaled to 0 to 255; a flat array gives 127.5."""
    m = mean(a)
    sd = F.sqrt(F.greatest(mean(F.transform(a, lambda x: x * x)) - m * m, F.lit(0.0)))
    half = F.lit(sigmas) * sd
    return F.transform(a, lambda x: F.when(half > 0, F.least(F.lit(255.0), F.greatest(F.lit(0.0), (x - m + half) / (2 * half) * 255))).otherwise(F.lit(127.5)))


def example(a: Column) -> Column:
    """Values of 0 to 255 as a network takes them: magnitudes, from -1 to 1."""
    return F.transform(a, lambda x: (F.abs(x) - 127.5) / 127.5)


def cross_entropy(logits: Column, label: int) -> Column:
    """Mean cross-entropy of logits against one label, 0 or 1."""
    return mean(F.transform(logits, lambda x: F.log1p(F.exp(-x if label else x))))


def let(value: Column, use) -> Column:
    """use(value), with value computed once: a lambda's body would compute it again for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def quantile(a: Column, share: float) -> Column:
    """The exact quantile, between two neighbours in proportion; null for an empty array."""

    def between(s: Column) -> Column:
        at = (F.size(s) - 1) * F.lit(float(share))
        low, high = F.get(s, F.floor(at).cast("int")), F.get(s, F.ceil(at).cast("int"))
        return low + (at - F.floor(at)) * (high - low)

    return F.when(F.size(a) > 0, let(F.array_sort(a), between))


def foreground_mean(a: Column, share: float = 0.6, least: int = 100) -> Column:
    """The mean of the elements above a quantile; of all where fewer than least are."""
    above = let(quantile(a, share), lambda q: F.filter(a, lambda x: x > q))
    return let(above, lambda high: mean(F.when(F.size(high) >= least, high).otherwise(a)))


def digitize(x: Column, edges: list[float]) -> Column:
    """How many of the ascending edges are at or below x; NaN is above all."""
    return sum((F.when(x >= e, F.lit(1.0)).otherwise(0.0) for e in edges), F.lit(0.0))


def side_loss(logits: Column, real: Column, rebuilt: Column, kept: Column, weight: float = 10.0, same: float = 0.5) -> Column:
    """One side's loss of two generators trained in a cycle: what is made should be judged real, its way back should give the
    original (weight), and what is of the target kind already should stay (weight times same)."""
    return cross_entropy(logits, 1) + weight * mae(rebuilt, real) + weight * same * mae(kept, real)


def fitted_tile(n: Column, tile: Column, multiple: int = 4) -> tuple[Column, Column]:
    """Of an axis of n: the tile that fits in it, a multiple, and what the axis is padded by so that it is one and holds a tile."""
    fits = F.greatest(F.lit(multiple), F.floor(F.least(tile, F.ceil(n / multiple) * multiple) / multiple) * multiple)
    need = F.greatest(F.lit(0), fits - n)
    return fits.cast("long"), (need + F.pmod(-(n + need), F.lit(multiple))).cast("long")
