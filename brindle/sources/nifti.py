"""The data source "nifti": `spark.read.format("nifti").load(folder)` and `df.write.format("nifti").mode(...).save(folder)`.

Register it once a session with `spark.dataSource.register(NiftiSource)`. Files are read and written by the tasks that
hold their rows, on any file system that Arrow knows by URI.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from .volume import read_affine, read_header, read_nifti, write_nifti

#: Bytes of files that a task reads.
TASK_BYTES = 64 << 20
SCHEMA = "stem string, shape array<int>, spacing array<double>, affine array<double>, data array<float>, status string"


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _stem(path: str) -> str | None:
    """The name without its extension; None for what is hidden or no volume."""
    name = path.rsplit("/", 1)[-1]
    end = next((e for e in (".nii.gz", ".nii") if name.lower().endswith(e)), None)
    return name[: -len(end)] if end and not name.startswith(".") else None


class NiftiSource(DataSource):
    """Rows (stem, shape, spacing, affine, data, status): a row a file. A file that can't be read has its error's name as status and nulls.

    Options of a scan: `data` = "false" reads headers only and leaves data null; `push` = "true" takes filters on stem (equality, lists, what
    it begins or ends with or holds) to the listing, so that other files are not opened, where spark.sql.python.filterPushdown.enabled is set.

    Writing takes columns stem, shape, spacing, data and, if there, affine. Append leaves files that exist as they are, overwrite
    replaces them; other files stay. Tasks write to a staging folder of the job; when all have ended, the names that they report are
    published, and of a job that fails nothing stays, nor does what a repeated or speculative task wrote. Of rows with equal stems one
    is kept. A row with a null stem or data ends the job.
    """

    @classmethod
    def name(cls) -> str:
        return "nifti"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        kind = _FilteringReader if self.options.get("push") == "true" else _Reader
        return kind(self.options["path"], self.options.get("data") != "false")

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


class _Files(InputPartition):
    """Files to read, or a folder whose files the task finds itself."""

    def __init__(self, paths: list[str], folder: str | None = None):
        self.paths, self.folder = paths, folder


#: Bytes of a NIfTI-1 header.
HEADER = 352
#: Values of volumes in one batch of rows.
BATCH_VALUES = 1 << 22


class _Reader(DataSourceReader):
    def __init__(self, path: str, whole: bool):
        self.path, self.whole = path, whole

    def wanted(self, stem: str) -> bool:
        return True

    def _listed(self, folder: str, recursive: bool) -> tuple[list[tuple[str, int]], list[str]]:
        """Volumes (path, bytes) in order of name, and subfolders."""
        system, _ = _at(self.path)
        found = system.get_file_info(fs.FileSelector(folder, recursive=recursive))
        files = sorted((x.path, x.size or 0) for x in found if x.is_file and (stem := _stem(x.path)) is not None and self.wanted(stem))
        return files, sorted(x.path for x in found if x.type == fs.FileType.Directory and not x.base_name.startswith("."))

    def partitions(self) -> list[InputPartition]:
        """The root's own files in order of name, by TASK_BYTES or one larger file a task (headers: by as many files as bytes would allow);
        each folder below is a task that lists it itself."""
        files, folders = self._listed(_at(self.path)[1], False)
        parts, held, size = [], [], 0
        for path, n in files:
            n = n if self.whole else HEADER * 64
            if held and size + n > TASK_BYTES:
                parts.append(_Files(held))
                held, size = [], 0
            held.append(path)
            size += n
        return [*parts, _Files(held), *[_Files([], x) for x in folders]]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        paths = [path for path, _ in self._listed(partition.folder, True)[0] if not self._hidden(path)] if partition.folder else partition.paths
        rows, size = [], 0
        for path in paths:
            rows.append(self._row(path))
            size += len(rows[-1][4]) if rows[-1][4] is not None else 1
            if size > BATCH_VALUES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _hidden(self, path: str) -> bool:
        return any(x.startswith(".") for x in path[len(_at(self.path)[1]) :].split("/"))

    def _row(self, path: str) -> tuple:
        system, _ = _at(self.path)
        try:
            with system.open_input_stream(path, compression=None) as f:
                raw = f.read() if self.whole else _head(f)
            shape, spacing, data = read_nifti(raw) if self.whole else (*read_header(raw), None)
            return _stem(path), shape, spacing, read_affine(raw).ravel().tolist(), data, "ok"
        except Exception as e:  # one bad file must not end the scan
            return _stem(path), None, None, None, None, type(e).__name__


class _FilteringReader(_Reader):
    """Takes filters on stem to the listing."""

    #: What a filter on a name does with its value.
    TESTS = {EqualTo: lambda stem, v: stem == v, In: lambda stem, v: stem in v, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: lambda stem, v: v in stem}

    def __init__(self, path: str, whole: bool):
        super().__init__(path, whole)
        self.taken: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in self.TESTS and f.attribute == ("stem",):
                self.taken.append(f)
            else:
                yield f

    def wanted(self, stem: str) -> bool:
        return all(self.TESTS[type(f)](stem, f.value) for f in self.taken)


def _head(f) -> bytes:
    """The first HEADER bytes of a file, plain or gzipped; no more is read than they need."""
    raw = f.read(HEADER)
    if raw[:2] != b"\x1f\x8b":
        return raw
    gunzip, out = zlib.decompressobj(31), b""
    while raw and len(out) < HEADER:
        out += gunzip.decompress(raw, HEADER - len(out))
        raw = gunzip.unconsumed_tail or f.read(HEADER)
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    stems, shapes, spacings, affines, data, status = zip(*rows)
    ends = np.cumsum([0] + [0 if d is None else len(d) for d in data])
    values = np.concatenate([np.zeros(0, np.float32), *[d for d in data if d is not None]])
    nulls = pa.array([d is None for d in data])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.float32()), mask=nulls)
    numbers = pa.list_(pa.float64())
    return pa.record_batch([pa.array(stems, pa.string()), pa.array(shapes, pa.list_(pa.int32())), pa.array(spacings, numbers), pa.array(affines, numbers), lists, pa.array(status, pa.string())], ["stem", "shape", "spacing", "affine", "data", "status"])


class _Wrote(WriterCommitMessage):
    """The staged files of a task by stem."""

    def __init__(self, staged: dict[str, str]):
        self.staged = staged


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.staging = f"{_at(path)[1]}/.staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        system, _ = _at(self.path)
        own = f"{self.staging}/{uuid.uuid4().hex}"  # of this attempt
        system.create_dir(own, recursive=True)
        staged: dict[str, str] = {}
        for row in iterator:
            if row["stem"] is None or row["data"] is None:
                raise ValueError("a volume needs a stem and data")
            if row["stem"] in staged:
                continue
            values = np.array(row["data"], dtype=np.float32).reshape(row["shape"])
            affine = row["affine"] if "affine" in row and row["affine"] is not None else None
            path = staged[row["stem"]] = f"{own}/{len(staged)}"
            with system.open_output_stream(path) as f:
                f.write(write_nifti(values, list(row["spacing"]), None if affine is None else np.array(affine).reshape(4, 4)))
        return _Wrote(staged)

    def commit(self, messages: list[_Wrote | None]) -> None:
        """Gives the staged files their names, each by one move, so a file appears whole or not at all."""
        system, root = _at(self.path)
        published: set[str] = set()

        def publish(stem: str, staged: str) -> None:
            path = f"{root}/{stem}.nii"
            if self.overwrite or system.get_file_info(path).type == fs.FileType.NotFound:
                system.move(staged, path)

        with ThreadPoolExecutor(16) as pool:
            for message in messages:
                new = {k: v for k, v in (message.staged if message else {}).items() if k not in published}
                published |= new.keys()
                list(pool.map(publish, new.keys(), new.values()))
        self._clear()

    def abort(self, messages: list[_Wrote | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, _ = _at(self.path)
        if system.get_file_info(self.staging).type == fs.FileType.Directory:
            system.delete_dir(self.staging)
