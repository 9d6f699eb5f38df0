"""Tables laid out along a space-filling curve, so that a box of values is found in few files and row groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.curves import cell, hilbert, morton


def curve_places(df: DataFrame, columns: list[str], bits: int, curve: str = "hilbert", name: str = "_place") -> DataFrame:
    """Adds the place of each row on a curve over the box that the columns' values span (numbers or times)."""
    as_number = {c: F.col(c).cast("timestamp").cast("double") if kind.startswith("timestamp") else F.col(c).cast("double") for c, kind in df.dtypes if c in columns}
    span = df.agg(*[f(as_number[c]).alias(f"_{side}_{c}") for c in columns for side, f in (("low", F.min), ("high", F.max))])
    cells = [cell(as_number[c], F.col(f"_low_{c}"), F.col(f"_high_{c}"), bits) for c in columns]
    place = hilbert(cells, bits) if curve == "hilbert" else morton(cells, bits)
    return df.crossJoin(F.broadcast(span)).withColumn(name, place).select(*df.columns, name)  # one row


def write_by_curve(df: DataFrame, path: str, columns: list[str], files: int, bits: int = 16, curve: str = "hilbert", group_bytes: int = 8 << 20) -> None:
    """Writes Parquet files that each hold a stretch of the curve, in its order, so the least and greatest values that a file and a row group
    note are close together in every one of the columns and a filter on any of them skips most."""
    placed = curve_places(df, columns, bits, curve).repartitionByRange(files, "_place").sortWithinPartitions("_place")
    placed.drop("_place").write.mode("overwrite").option("parquet.block.size", group_bytes).parquet(path)
