"""Three-dimensional slices, padding, turns, edges and scaling of volumes as expressions over flat arrays (x slowest)."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let, mean, quantile, total

Shape = tuple[int, int, int]


def once(f: Callable[..., Column]) -> Callable[..., Column]:
    """f with its array computed once: what each voxel reads is a value then, not an expression such as a cast of the whole array."""

    @wraps(f)
    def held(a: Column, *rest, **named) -> Column:
        return let(a, lambda v: f(v, *rest, **named))

    return held


def laid_out(size: Shape, value: Callable[[Column, Column, Column], Column]) -> Column:
    """The array of a volume of a size from the value at each place."""
    _, ny, nz = size
    numbers = F.sequence(F.lit(0), F.lit(size[0] * ny * nz - 1))
    places = F.transform(numbers, lambda i: F.struct(F.floor(i / (ny * nz)).cast("int").alias("x"), (F.floor(i / nz) % ny).cast("int").alias("y"), (i % nz).alias("z")))
    return F.transform(places, lambda p: value(p["x"], p["y"], p["z"]))


def voxel(a: Column, shape: Shape, x: Column, y: Column, z: Column) -> Column:
    """The value at a place of a volume; null where the place is outside."""
    inside = (x >= 0) & (x < shape[0]) & (y >= 0) & (y < shape[1]) & (z >= 0) & (z < shape[2])
    return F.when(inside, _at(a, shape, x, y, z))


def _at(a: Column, shape: Shape, x: Column, y: Column, z: Column) -> Column:
    """The value at a place that is inside."""
    return F.get(a, ((x * shape[1] + y) * shape[2] + z).cast("int"))


@once
def crop(a: Column, shape: Shape, start: Shape, size: Shape) -> Column:
    """The box of a size from start on; it has to lie in the volume."""
    if any(s < 0 or n < 1 or s + n > whole for s, n, whole in zip(start, size, shape)):
        raise ValueError("the box is not in the volume")
    return laid_out(size, lambda x, y, z: voxel(a, shape, x + start[0], y + start[1], z + start[2]))


@once
def pad(a: Column, shape: Shape, before: Shape, after: Shape, value: float | None = 0.0) -> Column:
    """The volume with so many planes before and after it on each axis, of a value, or with None of the nearest voxel's."""
    size = tuple(b + n + c for b, n, c in zip(before, shape, after))
    within = lambda v, n: v if value is not None else F.greatest(F.least(v, F.lit(n - 1)), F.lit(0))
    found = lambda x, y, z: voxel(a, shape, within(x - before[0], shape[0]), within(y - before[1], shape[1]), within(z - before[2], shape[2]))
    return laid_out(size, found if value is None else lambda x, y, z: F.coalesce(found(x, y, z), F.lit(value)))


@once
def flip(a: Column, shape: Shape, axis: int) -> Column:
    return laid_out(shape, lambda *at: voxel(a, shape, *[shape[k] - 1 - v if k == axis else v for k, v in enumerate(at)]))


@once
def quarter_turn(a: Column, shape: Shape, first: int, second: int) -> Column:
    """Turned by 90 degrees from the first axis towards the second; the axes' extents change places."""
    size = list(shape)
    size[first], size[second] = shape[second], shape[first]

    def value(*at: Column) -> Column:
        source = list(at)
        source[first], source[second] = at[second], shape[second] - 1 - at[first]
        return voxel(a, shape, *source)

    return laid_out(tuple(size), value)


@once
def plane(a: Column, shape: Shape, axis: int, at: int) -> Column:
    """The values of one plane across an axis."""
    size = tuple(1 if k == axis else n for k, n in enumerate(shape))
    return laid_out(size, lambda *place: voxel(a, shape, *[F.lit(at) if k == axis else v for k, v in enumerate(place)]))


@once
def translate(a: Column, shape: Shape, offset: Shape) -> Column:
    """Moved by whole samples; 0 where nothing was."""
    return laid_out(shape, lambda *at: F.coalesce(voxel(a, shape, *[v - o for v, o in zip(at, offset)]), F.lit(0.0)))


def _near(a: Column, shape: Shape, at: tuple[Column, ...], axis: int, step: int) -> Column:
    """The value a step along an axis from a place, or the last one within."""
    within = F.least(at[axis] + step, F.lit(shape[axis] - 1)) if step > 0 else F.greatest(at[axis] + step, F.lit(0))
    return _at(a, shape, *[within if k == axis else v for k, v in enumerate(at)])


@once
def laplacian(a: Column, shape: Shape) -> Column:
    """The six neighbours less six times the value; beyond the border the last value goes on."""
    return laid_out(shape, lambda *at: sum((_near(a, shape, at, k, s) for k in range(3) for s in (1, -1)), F.lit(0.0)) - 6 * _at(a, shape, *at))


def slope(a: Column, shape: Shape, at: tuple[Column, ...], axis: int) -> Column:
    """Half of the next value less the one before, at a border the one-sided difference."""
    n = shape[axis]
    d = _near(a, shape, at, axis, 1) - _near(a, shape, at, axis, -1)
    return F.when((at[axis] > 0) & (at[axis] < n - 1), d / 2).otherwise(d)


@once
def sharpness(a: Column, shape: Shape) -> Column:
    """The mean length of the gradient."""
    return mean(laid_out(shape, lambda *at: F.sqrt(sum((F.pow(slope(a, shape, at, k), 2) for k in range(3)), F.lit(0.0)))))


@once
def sobel(a: Column, shape: Shape) -> Column:
    """Edge strength after smoothing, from -1 to 1; beyond the border lies -1."""
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]

    def strength(around: Column) -> Column:
        squares = F.lit(0.0)
        for axis in range(3):
            weights = [d[axis] * (2 - abs(d[(axis + 1) % 3])) * (2 - abs(d[(axis + 2) % 3])) for d in steps]
            g = F.aggregate(F.zip_with(around, F.array(*[F.lit(float(w)) for w in weights]), lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v)
            squares = squares + F.pow(g / 4, 2)
        return 2 * F.tanh(F.sqrt(squares)) - 1

    around = laid_out(shape, lambda *at: F.array(*[F.coalesce(voxel(a, shape, *[v + s for v, s in zip(at, d)]), F.lit(-1.0)) for d in steps]))
    return F.transform(around, strength)


@once
def edge_weighted_l1(a: Column, b: Column, shape: Shape, alpha: float = 2.0) -> Column:
    """Mean absolute difference, weighted up where b has edges; the weights' mean is 1."""

    def by_edges(b: Column) -> Column:
        back = lambda at, k: _at(b, shape, *at) - _near(b, shape, at, k, -1)
        edges = laid_out(shape, lambda *at: F.sqrt(sum((F.pow(back(at, k), 2) for k in range(3)), F.lit(1e-12))))
        weights = lambda g: let(mean(g), lambda m: F.transform(g, lambda x: 1 + alpha * F.least(x / (4 * m), F.lit(1.0))))
        apart = F.zip_with(a, b, lambda x, y: F.abs(x - y))
        return let(let(edges, weights), lambda w: total(F.zip_with(w, apart, lambda x, y: x * y)) / total(w))

    return let(b, by_edges)


def scaled(a: Column, of: Column, low: float, high: float) -> Column:
    """Scaled to 0 to 1 between two quantiles of another array."""
    ends = F.struct(quantile(of, low).alias("p"), quantile(of, high).alias("q"))
    return let(ends, lambda e: F.transform(a, lambda x: F.least(F.greatest((x - e["p"]) / F.greatest(e["q"] - e["p"], F.lit(1e-12)), F.lit(0.0)), F.lit(1.0))))


@once
def foreground_scaled(a: Column, low: float = 0.01, high: float = 0.99, share: float = 0.02) -> Column:
    """scaled by the values above a share of the largest, by all where there are none."""
    above = let(F.array_max(a), lambda top: F.filter(a, lambda x: x > top * share))
    return let(above, lambda some: scaled(a, F.when(F.size(some) > 0, some).otherwise(a), low, high))


@once
def crop_about_mass(a: Column, shape: Shape, size: Shape, level: Column) -> Column:
    """A box of x and y about the centre of what exceeds a level (else the middle), from z = 0."""
    ny, nz = shape[1], shape[2]
    hits = F.filter(F.transform(a, lambda v, i: F.when(v > level, i)), lambda i: i.isNotNull())

    def box(h: Column) -> Column:
        middle = [F.when(F.size(h) > 0, mean(F.transform(h, lambda i: (F.floor(i / step) % n).cast("double")))).otherwise(n / 2) for step, n in ((ny * nz, shape[0]), (nz, ny))]
        return F.array(*[F.greatest(F.least((F.rint(m) - size[k] // 2).cast("int"), F.lit(max(shape[k] - size[k], 0))), F.lit(0)) for k, m in enumerate(middle)])

    return let(let(hits, box), lambda at: laid_out(size, lambda x, y, z: voxel(a, shape, x + at[0], y + at[1], z)))


def turn_matrix(axis: list[Column], radians: Column) -> Column:
    """The nine numbers of the matrix that turns about an axis by an angle."""
    n = F.sqrt(sum((v * v for v in axis), F.lit(0.0)))
    parts = F.struct(*[(v / n).alias(k) for k, v in zip("xyz", axis)], F.cos(radians).alias("c"), F.sin(radians).alias("s"))

    def rows(t: Column) -> Column:
        u, c, s = [t[k] for k in "xyz"], t["c"], t["s"]
        turn = [[F.lit(0.0), -u[2], u[1]], [u[2], F.lit(0.0), -u[0]], [-u[1], u[0], F.lit(0.0)]]
        return F.array(*[u[i] * u[k] * (1 - c) + turn[i][k] * s + (c if i == k else F.lit(0.0)) for i in range(3) for k in range(3)])

    return let(parts, rows)
