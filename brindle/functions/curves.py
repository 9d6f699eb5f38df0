"""Places on space-filling curves as column expressions: rows near in all their coordinates get near places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def morton(coordinates: list[Column], bits: int) -> Column:
    """The place on a Z-order curve of whole coordinates from 0 below 2^bits: their bits in turn, the first coordinate's lowest. With d
    coordinates d * bits is at most 63."""
    n = len(coordinates)
    if n * bits > 63:
        raise ValueError("a place has 63 bits at most")
    place = F.lit(0).cast("long")
    for j, c in enumerate(coordinates):
        for i in range(bits):
            place = place.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), i).bitwiseAND(F.lit(1).cast("long")), i * n + j))
    return place


def hilbert(coordinates: list[Column], bits: int) -> Column:
    """The place on a Hilbert curve, whose neighbours are neighbours in space: with two coordinates, square by square from the largest.

    Of each square the quadrant that holds the point tells two bits of the place; the rest is turned so that the curve inside begins and
    ends as the whole one does. The state of the fold is (x, y, place) for bits from the highest."""
    if len(coordinates) != 2 or bits > 31:
        raise ValueError("two coordinates of 31 bits at most")
    x, y = [c.cast("long") for c in coordinates]
    start = F.struct(x.alias("x"), y.alias("y"), F.lit(0).cast("long").alias("place"))

    def step(s: Column, side: Column) -> Column:
        right, up = s["x"].bitwiseAND(side) > 0, s["y"].bitwiseAND(side) > 0
        quadrant = F.when(~right, F.when(up, 1).otherwise(0)).otherwise(F.when(up, 2).otherwise(3)).cast("long")
        within = side - 1
        a, b = s["x"].bitwiseAND(within), s["y"].bitwiseAND(within)
        mirrored = right & ~up
        p, q = F.when(mirrored, within - a).otherwise(a), F.when(mirrored, within - b).otherwise(b)
        return F.struct(F.when(up, p).otherwise(q).alias("x"), F.when(up, q).otherwise(p).alias("y"), (s["place"] * 4 + quadrant).alias("place"))

    sides = F.array(*[F.lit(1 << i).cast("long") for i in reversed(range(bits))])
    return F.aggregate(sides, start, step)["place"]


def cell(value: Column, low: Column, high: Column, bits: int) -> Column:
    """The whole coordinate below 2^bits of a value within [low, high]; what is beyond is put to the border, null to 0."""
    top = (1 << bits) - 1
    at = F.floor((value.cast("double") - low) / F.greatest(high - low, F.lit(1e-300)) * F.lit(float(1 << bits)))
    return F.coalesce(F.least(F.greatest(at, F.lit(0)), F.lit(top)), F.lit(0)).cast("long")
