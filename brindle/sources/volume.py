"""Readers and writers of NIfTI-1 volumes, of text and of tables."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import EXTENSIONS, strip_ext

#: Fixed values of the format: data type codes.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
SCHEMA = "path string, stem string, shape array<int>, spacing array<double>, data array<float>, status string"


def read_header(raw: bytes) -> tuple[list[int], list[float]]:
    """Shape and spacing of a NIfTI-1 header, which need not be followed by values."""
    order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    if struct.unpack(order + "i", raw[:4])[0] != 348:
        raise ValueError("not a NIfTI-1 header")
    dim = struct.unpack(order + "8h", raw[40:56])
    return list(dim[1 : 1 + dim[0]]), [float(x) for x in struct.unpack(order + "8f", raw[76:108])[1 : 1 + dim[0]]]


def read_nifti(raw: bytes) -> tuple[list[int], list[float], np.ndarray]:
    """Shape, spacing and values in C order of (x, y, z) of a NIfTI-1 file, plain or gzipped."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    shape, spacing = read_header(raw)
    order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    kind, at = struct.unpack(order + "h", raw[70:72])[0], int(struct.unpack(order + "f", raw[108:112])[0])
    slope, shift = struct.unpack(order + "2f", raw[112:120])
    values = np.frombuffer(raw, dtype=order + TYPES[kind], count=int(np.prod(shape)), offset=at).reshape(shape, order="F").astype(np.float32)
    return shape, spacing, (values * slope + shift if slope else values).ravel()


def read_affine(raw: bytes) -> np.ndarray:
    """The 4 x 4 matrix from voxel indices to world coordinates: the file's own if it has one, else from its quaternion, else from spacing."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    by_quaternion, by_rows = struct.unpack(order + "2h", raw[252:256])
    sizes = struct.unpack(order + "4f", raw[76:92])
    affine = np.eye(4)
    if by_rows > 0:
        affine[:3] = np.array(struct.unpack(order + "12f", raw[280:328])).reshape(3, 4)
    elif by_quaternion > 0:
        b, c, d, *offset = struct.unpack(order + "6f", raw[256:280])
        v = np.array([b, c, d])
        w = np.sqrt(max(0.0, 1 - v @ v))
        cross = np.array([[0, -d, c], [d, 0, -b], [-c, b, 0]])
        turn = (w * w - v @ v) * np.eye(3) + 2 * np.outer(v, v) + 2 * w * cross
        affine[:3, :3] = turn * np.array([sizes[1], sizes[2], sizes[3] * (-1 if sizes[0] < 0 else 1)])
        affine[:3, 3] = offset
    else:
        affine[:3, :3] = np.diag(sizes[1:])
    return affine


def write_nifti(data: np.ndarray, spacing: list[float], affine: np.ndarray | None = None) -> bytes:
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, data.ndim, *data.shape, *[1] * (7 - data.ndim))
    struct.pack_into("<2h", head, 70, 16, 32)
    struct.pack_into("<8f", head, 76, 1.0, *spacing, *[0.0] * (7 - len(spacing)))
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    if affine is not None:
        struct.pack_into("<2h", head, 252, 0, 1)
        struct.pack_into("<12f", head, 280, *np.asarray(affine, dtype=float)[:3].ravel())
    head[344:348] = b"n+1\0"
    return bytes(head) + data.astype("<f4").ravel(order="F").tobytes()


def read_volumes(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """A row for each volume file below a path that Spark can read; status tells what failed, with the rest null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    files = files.where(F.col("path").rlike(r"(?i)/[^/.][^/]*\.(nii|nii\.gz)$"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for path_, raw in zip(x["path"], x["content"]):
                try:
                    shape, spacing, data = read_nifti(raw)
                    yield pd.DataFrame([[path_, None, shape, spacing, data.tolist(), "ok"]], columns=["path", "stem", "shape", "spacing", "data", "status"])
                except Exception as e:  # one bad file must not end the scan
                    yield pd.DataFrame([[path_, None, None, None, None, type(e).__name__]], columns=["path", "stem", "shape", "spacing", "data", "status"])

    return files.select("path", "content").mapInPandas(run, SCHEMA).withColumn("stem", strip_ext(F.col("path")))


def list_files(spark: SparkSession, path: str, recursive: bool = True, anywhere: bool = False) -> DataFrame:
    """path and stem of the files with a known extension, hidden ones left out; contents aren't read. anywhere: of files whose
    names hold .nii or .mhd at any place. Spark's readers don't see names that begin with a dot or an underscore."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path")
    ends = r"(?i)/[^/.][^/]*\.(" + "|".join(e.replace(".", r"\.") for e in EXTENSIONS) + ")$"
    return files.where(F.col("path").rlike(r"(?i)\.(nii|mhd)[^/]*$" if anywhere else ends)).withColumn("stem", strip_ext(F.col("path")))


def list_stems(spark: SparkSession, path: str) -> DataFrame:
    """Names without extension of a folder's own volumes, in the order of their characters. A path that is not there is an error."""
    return list_files(spark, path, recursive=False).select("stem").orderBy("stem")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """The distinct lines of a text file without blanks and # comments."""
    return spark.read.text(path).select(F.trim("value").alias("entry")).where("entry <> '' and not startswith(entry, '#')").distinct()


def read_metrics(spark: SparkSession, paths: list[str], lead: list[str], metrics: list[str]) -> DataFrame:
    """Rows of many CSV files; metrics as finite doubles or null, subgroup and fold with their defaults (unknown, the folder's name)."""
    df = spark.read.csv(paths, header=True).withColumn("_src", F.input_file_name())
    for c in [*lead, *metrics]:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    number = lambda c: F.col(c).try_cast("double")
    values = [F.when(~F.isnan(number(m)) & (F.abs(number(m)) < float("inf")), number(m)).alias(m) for m in metrics]
    fills = {"subgroup": F.lit("unknown"), "fold": F.regexp_extract("_src", r"([^/]+)/[^/]*$", 1)}
    return df.select(*[F.coalesce(F.nullif(c, F.lit("")), fills.get(c, F.lit(""))).alias(c) for c in lead], *values, "_src")


def write_list(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


FOLDS = "mode string, folds array<struct<fold:string, train:array<string>, val:array<string>, test:array<string>>>"


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    """fold, split, stem from a folds.json."""
    f = spark.read.schema(FOLDS).json(path, multiLine=True).select(F.explode("folds").alias("f"))
    parts = F.array(*[F.struct(F.lit(s).alias("split"), F.col(f"f.{s}").alias("stems")) for s in ("train", "val", "test")])
    return f.select("f.fold", F.explode(parts).alias("p")).select("fold", "p.split", F.explode("p.stems").alias("stem"))
