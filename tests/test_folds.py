"""Greedy splits in ranges against the plain rules, one group after another."""

import random

import numpy as np
import pytest

from brindle.operators import folds


def _counts(rows):
    found = {}
    for g, s in rows:
        found.setdefault(g, {}).setdefault(s, 0)
        found[g][s] += 1
    return found


def _taken(counts, quotas):
    left, need, out = dict(counts), dict(quotas), set()
    while any(v > 0 for v in need.values()):
        useful = {g: sum(min(n, max(0, need.get(s, 0))) for s, n in c.items()) for g, c in left.items()}
        keyed = [(sum(c.values()) - 2 * useful[g], sum(c.values()) - useful[g], str(g), g) for g, c in left.items() if useful[g]]
        if not keyed:
            break
        g = min(keyed)[-1]
        for s, n in left.pop(g).items():
            need[s] = need.get(s, 0) - n
        out.add(g)
    return out


def _dealt(counts, k, seed):
    rng, strata = np.random.default_rng(seed), sorted({s for c in counts.values() for s in c})
    order = sorted((-sum(counts[g].values()), rng.random(), g) for g in sorted(counts))
    held, out = np.zeros((k, len(strata))), {}
    for _, _, g in order:
        own = np.array([counts[g].get(s, 0) for s in strata], dtype=float)
        trials = [held + np.eye(k)[:, [f]] * own for f in range(k)]
        f = min((round(float(t.std(axis=0).sum()), 12), float(held[f].sum()), f) for f, t in enumerate(trials))[2]
        held[f] += own
        out[g] = f
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    return [(g, r.choice("aaabc")) for g in range(120) for _ in range(r.choice([1, 1, 2, 3, 9]))]


@pytest.mark.parametrize("size", [13, 20_000])
def test_quotas_in_ranges(spark, rows, monkeypatch, size):
    monkeypatch.setattr(folds, "RANGE_GROUPS", size)
    monkeypatch.setattr(folds, "RANGES_HELD", 2)
    df = spark.createDataFrame(rows, "g int, s string").repartition(3)
    for quotas in ({"a": 50, "b": 9, "c": 3}, {"c": 200, "a": 1}, {"x": 3, "b": 30}, {}):
        assert {r["g"] for r in folds.quota_split(df, "g", "s", quotas).collect()} == _taken(_counts(rows), quotas)
    test = _taken(_counts(rows), {"a": 20, "b": 5})
    val = _taken({g: c for g, c in _counts(rows).items() if g not in test}, {"a": 30, "c": 4})
    got = folds.dev_split(df, "g", "s", {"a": 20, "b": 5}, {"a": 30, "c": 4}).collect()
    assert {r["g"]: r["split"] for r in got} == {g: "test" if g in test else "val" if g in val else "train" for g in range(120)} and len(got) == 120


def test_large_quotas_of_more_groups_than_the_driver_takes(spark, monkeypatch):
    """Quotas that take most groups, and folds, of more groups than the driver would gather at once."""
    rows = [(g, s) for g in range(300) for s in ("a", "ab", "aab")[g % 3]]
    df = spark.createDataFrame(rows, "g long, s string")
    monkeypatch.setattr(folds, "MOST_GROUPS", 100)
    monkeypatch.setattr(folds, "DEALT_GROUPS", 70, raising=False)
    quotas = {"a": 300, "b": 90}
    assert {r["g"] for r in folds.quota_split(df, "g", "s", quotas).collect()} == _taken(_counts(rows), quotas)
    assert {r["g"]: r["fold"] for r in folds.kfold_groups(df, "g", "s", 5, 3).collect()} == _dealt(_counts(rows), 5, 3)


def test_carve_in_ranges(spark, rows, monkeypatch):
    monkeypatch.setattr(folds, "RANGE_GROUPS", 17, raising=False)
    df = spark.createDataFrame([*rows, (None, "b")], "g int, s string").repartition(3)
    assigned = spark.createDataFrame([(g, g % 4) for g in range(120) if g % 7], "g int, fold int")
    got = {(r["g"], r["round"]): r["split"] for r in folds.carve(df, assigned, "g", "s", 4, 0.3).collect()}
    assert len(got) == 4 * 121
    for i in range(4):
        pool = {g: c for g, c in _counts([*rows, (None, "b")]).items() if g is None or not g % 7 or g % 4 != i}
        quotas = {s: round(0.3 * sum(c.get(s, 0) for c in pool.values())) for s in "abc"}
        val = _taken(pool, quotas)
        assert {g: got[g, i] for g in [*range(120), None]} == {g: "test" if g not in pool else "val" if g in val else "train" for g in [*range(120), None]}
