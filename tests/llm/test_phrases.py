"""Phrase mining against a brute-force version, and the automaton against the end positions of all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from tests.conftest import SF, same

from brindle.llm import phrases
from brindle.llm.queries import QUERIES, SQL

LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_force(docs, least, longest, first):
    """The contract, word for word, over (text, lang) pairs."""
    n, f = Counter(), defaultdict(Counter)
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWERED)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(longest, len(words) - i) + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            inside = (q for q, b in candidates.items() if len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))))
            if any(True for _ in inside):
                continue
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            rows.append((score, a, " ".join(p), left, right))
        rows.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, left, right, n[lang], s) for i, (s, a, p, left, right) in enumerate(rows[:first], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def made(r, many):
    words = ["a", "B", "b", "ä", "Ä", "c-d", "x", "y", "😀"]
    return [("".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\x0b"]) for _ in range(r.randint(0, 40))), r.choice(["en", "fr", None, ""])) for _ in range(many)]


@pytest.mark.parametrize("words", [1 << 20, 50, 3])
def test_agrees_with_brute_force(spark, monkeypatch, words):
    monkeypatch.setattr(phrases, "SHARD_WORDS", words)
    monkeypatch.setattr(phrases, "SLICE_BYTES", 16)
    r = random.Random(words)
    docs = made(r, 60) + [(None, "en"), ("", "en"), (" \t ", "fr"), ("a b", "en")] + [("x x x x x x x x", None)] * 5
    docs.append((" ".join(r.choice("ab") for _ in range(2000)), "en"))  # one piece over many shards
    df = spark.createDataFrame([(t, g, 1, 2, 3) for t, g in docs], "text string, lang string, n long, phrase long, f long").repartition(3)
    for least, first in ((3, 2000), (1, 15)):
        assert rows_of(phrases.collocations(df, least, 5, first)) == by_force(docs, least, 5, first)


def test_empty_table(spark):
    assert rows_of(phrases.collocations(spark.createDataFrame([], "text string, lang string"))) == []


def test_long_text_without_ends(spark):
    docs = [("tic tac toe " * 30_000, "en")]
    got = rows_of(phrases.collocations(spark.createDataFrame(docs, "text string, lang string")))
    assert got and got == by_force(docs, 100, 5, 2000)


def test_filter_that_lets_all_pass_changes_nothing(spark, monkeypatch):
    docs = made(random.Random(9), 80)
    df = spark.createDataFrame(docs, "text string, lang string")
    monkeypatch.setattr(phrases, "passes", lambda bits, hashes: np.ones(len(hashes), bool))
    assert rows_of(phrases.collocations(df, 4)) == by_force(docs, 4, 5, 2000)


def test_scores_beyond_64_bits(spark, monkeypatch):
    rows = [("en", "a", 10**13 + 1, 1), ("en", "b", 10**13 + 3, 1), ("en", "a b", 10**13 - 7, 2)]
    every, totals = spark.createDataFrame(rows, "lang string, phrase string, f long, k int"), spark.createDataFrame([("en", 10**14 + 9)], "lang string, n long")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *_: (every, totals))
    (got,) = phrases.collocations(every.selectExpr("phrase text", "lang")).collect()
    assert got["score"] == 1000 * (10**13 - 7) * (10**14 + 9) // ((10**13 + 1) * (10**13 + 3))


@pytest.mark.parametrize("seed", range(20))
def test_states_are_the_sets_of_end_positions(seed):
    r = random.Random(seed)
    codes = np.array([r.choice([0, 1, 2, 3, 1, 2]) for _ in range(r.randint(1, 60))], np.int64)
    depth = r.randint(1, 5)
    reach = np.zeros(len(codes), np.int64)
    for i, c in enumerate(codes):
        reach[i] = (reach[i - 1] if i else 0) + 1 if c else 0
    ends = defaultdict(set)
    for i in range(len(codes)):
        for k in range(1, min(reach[i], depth) + 1):
            ends[tuple(codes[i - k + 1 : i + 1])].add(i)
    found = phrases.SuffixAutomaton(codes, reach, depth)
    classes = defaultdict(list)
    for p, at in ends.items():
        classes[frozenset(at)].append(p)
    longest = {max(ps, key=len): at for at, ps in classes.items()}
    told = {tuple(codes[e - n + 1 : e + 1]): (c, link) for n, e, c, link in zip(found.length, found.end, found.count, found.link)}
    assert {p: len(at) for p, at in longest.items()} == {p: c for p, (c, _) in told.items()}
    for p, (_, link) in told.items():
        shorter = [q for q in longest if q == p[len(p) - len(q) :] and len(q) < len(p)]
        expected = max(shorter, key=len, default=())
        assert (tuple(codes[found.end[link] - found.length[link] + 1 : found.end[link] + 1]) if link >= 0 else ()) == expected
    counted = {tuple(codes[e - k + 1 : e + 1]): c for k, es, cs in found.phrases(1, depth) for e, c in zip(es, cs)}
    assert counted == {p: len(at) for p, at in ends.items()}


def test_query_agrees_with_sql(spark):
    same(spark, "op12_phrases", QUERIES["op12_phrases"], SQL["op12_phrases"], SF)
