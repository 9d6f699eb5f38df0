"""What a task or the driver holds doesn't grow with the rows: medians of blocks, joins of stretches, pools of keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import intervals
from brindle.operators import summaries as S
from brindle.streaming import stream


@pytest.mark.parametrize("near", [S.__dict__.get("NEAR", 0), -0.2])
def test_medians_of_blocks_order_few_values(spark, monkeypatch, near):
    """Only values around a median are put in order; where their estimate fails (its sides are swapped) all are."""
    monkeypatch.setattr(S, "NEAR", near, raising=False)
    ordered, real = [], S.in_order
    monkeypatch.setattr(S, "in_order", lambda df, *a: ordered.append(df.count()) or real(df, *a))
    r = np.random.default_rng(5)
    rows = [(str(s), float(x)) for s, x in zip(r.choice(list("aab"), 20_001), r.normal(size=20_001))]
    df = spark.createDataFrame(rows, "s string, x double").repartition(3)
    got = {x["block"]: x for x in S.describe_blocks(df, "s", [], "x").collect()}
    for block in ("ALL", "a", "b"):
        own = [x for s, x in rows if block in ("ALL", s)]
        assert got[block]["n"] == len(own) and got[block]["median"] == pytest.approx(np.median(own), abs=1e-12)
    assert len(got) == 3 and ordered[0] < 200 if near > 0 else ordered[0] > 20_000
    one = S.describe_blocks(df.where("s = 'a'"), "s", [], "x").collect()
    assert [x["block"] for x in one] == ["ALL"] and one[0]["median"] == got["a"]["median"]
    ties = spark.createDataFrame([("a", 1.0)] * 50 + [("b", 2.0)] * 50 + [(None, None)], "s string, x double")
    assert {x["block"]: x["median"] for x in S.describe_blocks(ties, "s", [], "x").collect()} == {"ALL": 1.5, "a": 1.0, "b": 2.0, None: None}


def test_holding_in_tasks_of_few_pairs(spark, monkeypatch):
    """One cell holds all rows, and yet no task makes most of the pairs."""
    monkeypatch.setattr(intervals, "STRIP", 20, raising=False)
    monkeypatch.setattr(intervals, "PAIRS_IN_TASK", 2000, raising=False)
    points = spark.createDataFrame([(i, 5.0 + i % 3) for i in range(200)], "id long, at double")
    stretches = spark.createDataFrame([(i, 4.0, 6.5 + i % 2) for i in range(200)], "s long, low double, high double")
    got = intervals.holding(points, "at", stretches, "low", "high", 1).withColumn("_task", F.spark_partition_id())
    want = sorted((i, s) for i in range(200) for s in range(200) if 5.0 + i % 3 < 6.5 + s % 2)
    assert sorted((x["id"], x["s"]) for x in got.collect()) == want
    assert got.groupBy("_task").count().agg(F.max("count")).first()[0] < len(want) / 3


def _pooled(items, seen, held, size):
    out = []
    for v in sorted(items):
        seen += 1
        h = (v * 2654435761 + seen * 40503) % 2**32
        at = seen - 1 if seen <= size else (h >> 1) % size if h & 1 else None
        out.append((v, v if at is None or seen <= size else held[at]))
        if at is not None:
            held[at] = v
    return out, seen


def test_pool_by_place_over_runs(spark, tmp_path):
    """Runs go on from the places that the run before left; a key that comes late and large items do as others."""
    r, seen, held, want = random.Random(7), {}, {}, []
    src, out, mark, places = (str(tmp_path / x) for x in ("in", "out", "mark", "places"))
    for run in range(3):
        rows = [(k, r.randrange(2**60)) for k in ("hot",) * 6 + ("b",) * (run > 0) for _ in range(15)]
        spark.createDataFrame(rows, "k string, v long").coalesce(1).write.mode("append").parquet(src)
        for k in {k for k, _ in rows}:
            told, seen[k] = _pooled([v for x, v in rows if x == k], seen.get(k, 0), held.setdefault(k, {}), 9)
            want += [(k, *x) for x in told]
        stream.pool_by_place(stream.stream_files(spark, src, "k string, v long"), "k", "v", out, mark, places, size=9)
        assert sorted((x["k"], x["v_in"], x["v_out"]) for x in spark.read.parquet(out).collect()) == sorted(want)
