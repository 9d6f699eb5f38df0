"""The data source of volumes: staged commits, headers only, filters on names, folders listed by tasks."""

import gzip

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringStartsWith

from brindle.sources import documents, nifti, volume
from brindle.sources.volume import write_nifti
from brindle.streaming import stream

A = np.arange(24, dtype=np.float32).reshape(2, 3, 4)


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(nifti.NiftiSource)
    return spark


def volumes(spark, n):
    return spark.range(n).select(F.concat(F.lit("v"), "id").alias("stem"), F.array(*[F.lit(x) for x in A.shape]).alias("shape"), F.array(*[F.lit(1.0)] * 3).alias("spacing"), F.array(*[F.lit(float(x)) for x in A.ravel()]).cast("array<float>").alias("data"))


def names(folder):
    return sorted(p.name for p in folder.rglob("*") if p.is_file() and not p.name.endswith(".crc"))


def test_a_job_that_fails_leaves_no_file(source, tmp_path):
    out = tmp_path / "out"
    bad = volumes(source, 40).repartition(4).withColumn("data", F.when(F.col("stem") != "v17", F.col("data")))
    with pytest.raises(Exception, match="a volume needs"):
        bad.write.format("nifti").mode("append").save(str(out))
    assert names(out) == [] and not list(out.glob(".staging*"))
    volumes(source, 40).repartition(4).write.format("nifti").mode("append").save(str(out))
    assert len(names(out)) == 40 and not list(out.glob(".staging*"))


def test_of_two_attempts_one_is_published(tmp_path):
    writer = nifti._Writer(str(tmp_path), False)
    row = Row(stem="a", shape=list(A.shape), spacing=[1.0, 1.0, 1.0], data=A.ravel().tolist())
    first, second = writer.write(iter([row, row])), writer.write(iter([row]))
    assert names(tmp_path) != [] and not (tmp_path / "a.nii").exists(), "nothing has its name before the job ends"
    writer.commit([second, None])
    assert names(tmp_path) == ["a.nii"] and first.staged.keys() == second.staged.keys()
    kept = (tmp_path / "a.nii").read_bytes()
    other = nifti._Writer(str(tmp_path), False)
    other.commit([other.write(iter([Row(**row.asDict() | {"data": (A + 1).ravel().tolist()})]))])
    assert (tmp_path / "a.nii").read_bytes() == kept, "append leaves files that exist"
    third = nifti._Writer(str(tmp_path), True)
    third.commit([third.write(iter([Row(**row.asDict() | {"data": (A + 1).ravel().tolist()})]))])
    assert (tmp_path / "a.nii").read_bytes() != kept


def test_headers_are_enough_for_voxel_sizes(source, tmp_path):
    whole = write_nifti(np.zeros((50, 60, 70), np.float32), [1.0, 2.0, 3.0])
    (tmp_path / "cut.nii").write_bytes(whole[:352])  # no values at all
    (tmp_path / "zip.nii.gz").write_bytes(gzip.compress(whole[:352] + np.random.default_rng(1).bytes(len(whole) - 352))[:2000])  # and a stream that breaks off
    (tmp_path / "bad.nii").write_bytes(b"no volume")
    got = {r["stem"]: r for r in source.read.format("nifti").option("data", "false").load(str(tmp_path)).collect()}
    assert all(got[x]["shape"] == [50, 60, 70] and got[x]["spacing"] == [1.0, 2.0, 3.0] and got[x]["data"] is None and got[x]["status"] == "ok" for x in ("cut", "zip"))
    assert got["bad"]["status"] == "ValueError" and got["bad"]["shape"] is None
    whole_scan = {r["stem"]: r["status"] for r in source.read.format("nifti").load(str(tmp_path)).collect()}
    assert "ok" not in whole_scan.values()


def test_few_bytes_are_read(tmp_path, monkeypatch):
    big = write_nifti(np.zeros((40, 40, 40), np.float32), [1.0, 1.0, 1.0])
    (tmp_path / "a.nii").write_bytes(big)
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(big, 1))
    read = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def read(self, n):
            read.append(n)
            return self.f.read(n)

    real = nifti._head
    monkeypatch.setattr(nifti, "_head", lambda f: real(Counted(f)))
    reader = nifti._Reader(str(tmp_path), False)
    rows = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
    assert [r["shape"] for r in rows] == [[40, 40, 40]] * 2 and sum(read) <= 4 * 352 < len(big) / 100


def test_filters_on_names_reach_the_listing(source, tmp_path):
    volumes(source, 30).write.format("nifti").mode("append").save(str(tmp_path))
    reader = nifti._FilteringReader(str(tmp_path), True)
    left = list(reader.pushFilters([StringStartsWith(("stem",), "v1"), EqualTo(("status",), "ok"), In(("stem",), ("v1", "v12", "v2"))]))
    assert [type(x) for x in left] == [EqualTo] and left[0].attribute == ("status",)
    assert sorted(x.rsplit("/", 1)[1] for part in reader.partitions() for x in part.paths) == ["v1.nii", "v12.nii"]
    with stream.settings(source, spark__sql__python__filterPushdown__enabled="true"):
        df = source.read.format("nifti").option("push", "true").load(str(tmp_path))
        for condition, n in (("stem like 'v1%'", 11), ("stem = 'v7'", 1), ("stem in ('v3', 'v9', 'x')", 2), ("stem like '%5' and shape[0] = 2", 3), ("stem > 'v5'", len([i for i in range(30) if f"v{i}" > "v5"]))):
            assert df.where(condition).count() == n == source.read.format("nifti").load(str(tmp_path)).where(condition).count()


def test_folders_below_are_listed_by_tasks(source, tmp_path):
    for where in ("", "s1", "s2/deep", ".hidden", "s1/.hidden"):
        (tmp_path / where).mkdir(parents=True, exist_ok=True)
        (tmp_path / where / f"x{where.replace('/', '').replace('.', '')}.nii").write_bytes(write_nifti(A, [1.0, 1.0, 1.0]))
    reader = nifti._Reader(str(tmp_path), True)
    assert [len(p.paths) for p in reader.partitions()] == [1, 0, 0]
    assert sorted(r["stem"] for r in source.read.format("nifti").load(str(tmp_path)).collect()) == ["x", "xs1", "xs2deep"]
    assert source.read.format("nifti").load(str(tmp_path / ".hidden")).count() == 1


def test_large_volumes_come_in_several_batches(tmp_path, monkeypatch):
    monkeypatch.setattr(nifti, "BATCH_VALUES", 30)
    for i in range(5):
        (tmp_path / f"{i}.nii").write_bytes(write_nifti(A + i, [1.0, 1.0, 1.0]))
    reader = nifti._Reader(str(tmp_path), True)
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert [b.num_rows for b in batches] == [2, 2, 1]
    assert [r["data"] for b in batches for r in b.to_pylist()] == [(A + i).ravel().tolist() for i in range(5)]


def test_documents_as_files_and_what_is_broken(spark, tmp_path):
    (tmp_path / "folds.json").write_text('{"seed": 1,\n "folds": [{"fold": 0, "train": ["a", "b"], "val": [], "test": ["c"]},\n {"fold": "x", "train": ["c"]}]}')
    folds = documents.fold_rows(documents.read_documents(spark, str(tmp_path / "folds.json"), documents.FOLDS)).drop("file")
    assert sorted(map(tuple, folds.collect())) == [("0", "test", "c"), ("0", "train", "a"), ("0", "train", "b"), ("x", "train", "c")]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "manifest.json").write_text('{"args": {"x": [1]},\n "splits": {"train": [{"assigned_name": "0.nii.gz", "stem": "s1", "lr": "p"}], "test": [{"assigned_name": "0.nii.gz", "stem": "s2"}, {"assigned_name": "1.nii"}]}}')
    (tmp_path / "m" / "broken.json").write_text('{"splits": {"train": [')
    read = documents.read_documents(spark, str(tmp_path / "m"), documents.MANIFEST)
    assert sorted((r["file"].rsplit("/", 1)[1], r["status"]) for r in read.collect()) == [("broken.json", "unreadable"), ("manifest.json", "ok")]
    rows = documents.manifest_rows(read)
    found = lambda split: sorted(map(tuple, documents.name_map(rows, split).collect()))
    assert found("train") == [("0", "s1", False)] and found("test") == [("0", "s2", False), ("1", "1", False)]
    assert found("other") == [("0", "s1", True), ("1", "1", False)] == found(None)


def test_sidecars(spark, tmp_path):
    for name, text in {"a": '{"AcquisitionMatrixPE": 100, "ReconMatrixPE": 256}', "b": '{"AcquisitionMatrixPE": 256, "ReconMatrixPE": 256, "Other": {}}', "c": '{"Other": 1}', "d": "{"}.items():
        (tmp_path / f"{name}.json").write_text(text)
    read = documents.read_documents(spark, str(tmp_path), documents.SIDECAR)
    told = read.select(F.regexp_extract("file", "([^/.]+).json", 1), documents.sidecar_doubts(F.col("AcquisitionMatrixPE"), F.col("ReconMatrixPE"), F.col("status"))).collect()
    assert sorted(map(tuple, told)) == [("a", None), ("b", "not_zero_filled"), ("c", "silent"), ("d", "unreadable")]


def test_names_that_hold_an_extension_anywhere(spark, tmp_path):
    for name in ("a.nii", "b.nii.gz.bak", ".c.NII", "deep/d.mhd2", "e.txt", "deep/f.nii.gz"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    names = lambda df: sorted(r["path"].rsplit("/", 1)[1] for r in df.collect())
    assert names(volume.list_files(spark, str(tmp_path), anywhere=True)) == ["a.nii", "b.nii.gz.bak", "d.mhd2", "f.nii.gz"]
    assert names(volume.list_files(spark, str(tmp_path))) == ["a.nii", "f.nii.gz"] and names(volume.list_files(spark, str(tmp_path), recursive=False)) == ["a.nii"]
