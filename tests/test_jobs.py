"""The jobs on copies of the tables: reruns, growing input, a stop between write and commit, and their SQL."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tests.conftest import SF, same

import __spark_entry__
from brindle.sources import tables
from brindle.streaming import stream
from jobs import cv_report, intake, queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_agrees_with_sql(spark, name):
    assert __spark_entry__.queries()[name] is queries.QUERIES[name]
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    same(spark, name, queries.QUERIES[name], queries.SQL[name])
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


def rows_of(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_report_reruns_alike_and_follows_its_input(spark, tmp_path):
    config, out = queries.config_of("cv_report"), str(tmp_path / "out")
    first = rows_of(cv_report.run(spark, SF, out, config))
    files = sorted(p.name for p in (tmp_path / "out").rglob("part-*.parquet"))
    assert rows_of(cv_report.run(spark, SF, out, config)) == first and len(list((tmp_path / "out").rglob("part-*.parquet"))) == len(files)
    text = "".join(p.read_text() for p in (tmp_path / "out" / "report_csv").rglob("*.csv"))
    assert all(len(x.split(".")[1]) == 4 for line in text.split() for x in line.split(",")[3:] if "." in x)
    kept = spark.read.parquet(f"{out}/scores")
    assert kept.groupBy("subject").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    few = tmp_path / "few"
    spark.read.parquet(f"{SF}/orders.parquet").limit(4).write.parquet(str(few / "orders.parquet"))
    spark.read.parquet(f"{SF}/lineitem.parquet").write.parquet(str(few / "lineitem.parquet"))
    report = cv_report.run(spark, str(few), str(tmp_path / "out2"), config)
    assert report.where("section = 'age'").count() == 0 < report.where("section = 'paired'").count()


def test_report_refuses_a_leak(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cv_report, "fold_of", lambda subject, seed, folds: F.pmod(F.xxhash64("stem"), F.lit(folds)).cast("int"))
    with pytest.raises(ValueError, match="more than one fold"):
        cv_report.run(spark, SF, str(tmp_path), queries.config_of("cv_report"))


def documents(spark, rows, at):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.mode("append").parquet(at)


def test_intake_takes_only_what_is_new(spark, tmp_path):
    at, out, mark, config = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"), queries.config_of("intake")
    run = lambda: rows_of(intake.run(spark, at, out, mark, config))
    documents(spark, [(1, "a b", "en", "s"), (2, "a b", "fr", "t"), (3, None, None, "t"), (None, "c", "en", "s"), (None, "d", "en", "s"), (2, "z", "fr", "t")], at)
    first = run()
    assert len(first) == 5 and run() == first
    documents(spark, [(4, "a b", "en", "u"), (1, "other", "en", "u"), (None, "c", "en", "s"), (5, "", "de", "u")], at)
    second = run()
    assert set(first) < set(second) and {r[0] for r in second if r not in first} == {"4", "5"}
    splits = {(r[3], r[6]) for r in second}
    assert len(splits) == len({k for k, _ in splits}), "copies share a split"
    sums = spark.read.parquet(f"{out}/summary")
    assert sums.agg(F.sum("documents")).first()[0] == len(second) == run().__len__()


def test_intake_goes_on_after_a_stop_between_write_and_commit(spark, tmp_path, monkeypatch):
    at, out, mark, config = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"), queries.config_of("intake")
    documents(spark, [(i, f"text {i % 7}", "en", "s") for i in range(40)], at)
    intake.run(spark, at, out, mark, config)
    documents(spark, [(i, f"text {i % 7}", "en", "s") for i in range(30, 80)], at)
    real = stream.write_batches

    def stops(*a, **k):
        def stop(*_):
            raise RuntimeError("stopped")

        return real(*a, **k, after=stop)

    monkeypatch.setattr(stream, "write_batches", stops)
    with pytest.raises(Exception, match="stopped"):
        intake.run(spark, at, out, mark, config)
    assert intake.manifest_of(spark, out).count() == 80, "the batch was written, but its end not noted"
    monkeypatch.setattr(stream, "write_batches", real)
    assert sorted(r["doc_id"] for r in intake.run(spark, at, out, mark, config).collect()) == list(range(80))


def test_intake_of_many_small_batches(spark, tmp_path):
    at, out, config = str(tmp_path / "in"), str(tmp_path / "out"), queries.config_of("intake") | {"files_a_batch": 1}
    for k in range(3):
        documents(spark, [(10 * k + i, f"t{i}", "en", "s") for i in range(10)], at)
    found = intake.run(spark, at, out, str(tmp_path / "mark"), config)
    assert found.select("batch").distinct().count() == 3 and found.count() == 30
    assert found.groupBy("text_key").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


def test_splits_follow_their_shares(spark):
    shares = {"train": 60, "val": 25, "test": 15}
    got = spark.range(20_000).select(intake.split_of(F.col("id").cast("string"), 1, shares).alias("s")).groupBy("s").count().collect()
    assert {r["s"]: r["count"] / 200 for r in got} == pytest.approx(shares, abs=1.5)
    with pytest.raises(ValueError):
        intake.split_of(F.lit("x"), 1, {"train": 50})


def test_jobs_use_no_training_data_operators():
    for path in (Path(__file__).parents[1] / "jobs").glob("*.py"):
        assert "brindle.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text()


def test_configs_are_what_the_jobs_read():
    assert set(json.loads((Path(queries.__file__).parent / "intake.json").read_text())) == {"seed", "shares", "files_a_batch"}


def test_numbers_with_decimals(spark):
    df = spark.createDataFrame([(1.23456,), (float("nan"),), (None,), (float("inf"),), (-2.0,)], "v double")
    assert [r[0] for r in df.select(tables.with_decimals(F.col("v"), 2)).collect()] == ["1.23", "nan", None, "inf", "-2.00"]


def test_late_rows_are_dropped_and_open_windows_wait(spark, tmp_path):
    at, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    run = lambda rows: (spark.createDataFrame(rows, "ts string, event_type string, value double").selectExpr("to_timestamp(ts) ts", "event_type", "value").coalesce(1).write.mode("append").parquet(at), stream.closed_windows(stream.stream_files(spark, at, "ts timestamp, event_type string, value double"), out, mark))
    told = lambda: sorted((str(r["start"])[11:13], r["n"]) for r in spark.read.parquet(out).collect())
    run([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 01:20:00", "a", 1.0)])
    assert told() == [("00", 1)], "the watermark is 01:10"
    run([("2024-01-01 00:50:00", "a", 1.0), ("2024-01-01 01:05:00", "a", 1.0), ("2024-01-01 02:30:00", "a", 1.0)])
    assert told() == [("00", 1), ("01", 2)], "00:50 is late, 01:05 is before the watermark in an open window"
    run([])
    assert told() == [("00", 1), ("01", 2)]


def test_settings_are_restored(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    with pytest.raises(RuntimeError):
        with stream.settings(spark, spark__sql__session__timeZone="CET", spark__sql__own__thing="1"):
            assert spark.conf.get("spark.sql.session.timeZone") == "CET"
            raise RuntimeError
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC" and spark.conf.get("spark.sql.own.thing", None) is None
