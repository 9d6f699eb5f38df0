"""Volumes as rows of chunks, so that no row holds a volume: differences along the axes with planes from the neighbouring chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def _sizes(shape: tuple[int, int, int], axis: int) -> tuple[int, int, int]:
    """The chunk's extent along an axis, the step to the next value along it, and the values of a plane across it."""
    step = 1
    for n in shape[axis + 1 :]:
        step *= n
    return shape[axis], step, shape[0] * shape[1] * shape[2] // shape[axis]


def chunked(volumes: DataFrame, key: str, data: str, shape: tuple[int, int, int], chunk: tuple[int, int, int]) -> DataFrame:
    """key, cx, cy, cz (a chunk's place), values: volumes of one shape, x slowest, as chunks. Each side is a multiple of the chunk's."""
    if any(n % c for n, c in zip(shape, chunk)):
        raise ValueError("a volume's sides are multiples of its chunks'")
    places = F.array(*[F.struct(*[F.lit(v).alias(f"c{a}") for a, v in zip(AXES, (i, j, k))]) for i in range(shape[0] // chunk[0]) for j in range(shape[1] // chunk[1]) for k in range(shape[2] // chunk[2])])
    rows = volumes.select(key, data, F.explode(places).alias("c")).select(key, data, "c.*")
    inner = F.sequence(F.lit(0), F.lit(chunk[0] * chunk[1] * chunk[2] - 1))

    def source(i: Column) -> Column:
        at = [F.col(f"c{a}") * n + F.floor(i / s) % n for a, n, s in zip(AXES, chunk, (chunk[1] * chunk[2], chunk[2], 1))]
        return (at[0] * shape[1] + at[1]) * shape[2] + at[2]

    return rows.select(key, "cx", "cy", "cz", F.transform(inner, lambda i: F.element_at(F.col(data), (source(i) + 1).cast("int"))).alias("values"))


def plane(values: Column, chunk: tuple[int, int, int], axis: int, at: int) -> Column:
    """The values of a chunk whose coordinate along the axis is at, in order."""
    n, step, across = _sizes(chunk, axis)
    return F.transform(F.sequence(F.lit(0), F.lit(across - 1)), lambda i: F.element_at(values, (F.floor(i / step) * (n * step) + at * step + i % step + 1).cast("int")))


def with_neighbours(chunks: DataFrame, key: str, chunk: tuple[int, int, int], axis: int) -> DataFrame:
    """Adds before and after: the neighbouring planes along the axis, null at the volume's borders. A chunk sends its first and last plane to
    its neighbours; planes and chunks meet by an equi-join, and what is shuffled besides the chunks is their surface."""
    place = [f"c{a}" for a in AXES]
    along = place[axis]
    sent = lambda at, to, name: chunks.select(key, *[(F.col(c) + to).alias(c) if c == along else F.col(c) for c in place], plane(F.col("values"), chunk, axis, at).alias(name))
    return chunks.join(sent(chunk[axis] - 1, 1, "before"), [key, *place], "left").join(sent(0, -1, "after"), [key, *place], "left")


def differences(chunks: DataFrame, key: str, chunk: tuple[int, int, int], axis: int, central: bool = False) -> DataFrame:
    """key, cx, cy, cz, values: the next value along the axis less the value (0 at the last), or half of the next less the one before
    (central; at a border the one-sided difference), as over the whole volume."""
    n, step, across = _sizes(chunk, axis)
    both = with_neighbours(chunks, key, chunk, axis)
    inner = F.sequence(F.lit(0), F.lit(n * across - 1))
    value = lambda i: F.element_at(F.col("values"), (i + 1).cast("int"))
    on_plane = lambda p, i: F.element_at(F.col(p), (F.floor(i / (n * step)) * step + i % step + 1).cast("int"))

    def at(i: Column) -> Column:
        k = F.floor(i / step) % n
        following = F.when(k < n - 1, value(F.least(i + step, F.lit(n * across - 1)))).when(F.col("after").isNotNull(), on_plane("after", i))
        if not central:
            return F.coalesce(following - value(i), F.lit(0.0))
        before = F.when(k > 0, value(F.greatest(i - step, F.lit(0)))).when(F.col("before").isNotNull(), on_plane("before", i))
        return F.when(before.isNull(), following - value(i)).when(following.isNull(), value(i) - before).otherwise((following - before) / 2)

    return both.select(key, "cx", "cy", "cz", F.transform(inner, at).alias("values"))


def voxels(chunks: DataFrame, key: str, chunk: tuple[int, int, int]) -> DataFrame:
    """key, x, y, z, value of chunks."""
    rows = chunks.select(key, "cx", "cy", "cz", F.posexplode("values").alias("i", "value"))
    at = [(F.col(f"c{a}") * n + F.floor(F.col("i") / s) % n).cast("long").alias(a) for a, n, s in zip(AXES, chunk, (chunk[1] * chunk[2], chunk[2], 1))]
    return rows.select(key, *at, "value")
