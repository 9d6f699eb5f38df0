"""The training-data operators against brute force, and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tests.conftest import same
from pyspark.sql import functions as F

from brindle.llm import bpe, common, components, html_extract, importance, jpeg_media, license_scan, mixing, queries, simhash, sketches, toxicity, url_filters

ODD = [(1, None, "a"), (2, "", None), (2, "", None), (3, "one", "b"), (None, "one two three four five six", "b"), (4, "x " * 5000, "a"), (4, "x " * 5000, "a"), (5, "é日本 😀\n\tz", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names clash with the operators' own."""
    return spark.createDataFrame(ODD, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("fp", "size", "id", "node", "score", "copies", "_copies", "_id", "_n", "row", "nth", "words", "_gone", "_kept", "_sha", "n_chars", "component", "key")})


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_agrees_with_sql(spark, name):
    same(spark, name, queries.QUERIES[name], queries.SQL[name], "/root/testdata/sf0.01")


def test_components_against_union_find(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500 + i) for i in range(50)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    want = {x: root(x) for p in pairs for x in p if root(x) != x}
    got = components.connected_components(spark.createDataFrame(pairs + [(None, 3)], "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_url_classes(spark):
    rows = [
        (1, "http://A.example.net/es/1", '<link rel="canonical" href="https://x.org/p?q=1#z">'), (2, "https://x.org/p?q=1", None), (3, "http://y.org/a/b?z", '<META http-equiv=refresh content="0; url=/c">'),
        (4, "http://y.org/c", "<link href='d' rel='shortlink canonical'>"), (5, "http://y.org/d", "<!-- <link rel=canonical href='http://x.org/p?q=1'> -->"), (6, None, None), (7, "nourl", ""), (7, "nourl", ""),
        (8, "http://z.net/fr/", "<link rel=canonical href='http://w.com/ok'>"), (9, "http://w.com/ok", "<link rel=canonical href='http://v.org/q'>"), (10, "http://v.org/q", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    for rules in (url_filters.RULES, url_filters.RULES + [("block", f"h{i}.x", "/") for i in range(300)]):
        got = sorted((r["page_id"], r["rule"], r["verdict"]) for r in url_filters.judge_urls(pages, rules).collect())
        want = {1: ("net/es/", "block"), 2: (None, "block"), 8: ("net/fr/", "block"), 9: ("com/", "allow"), 10: (None, "allow")}
        assert [(i, *want.get(i, (None, "allow"))) for i in (1, 2, 3, 4, 5, 6, 7, 7, 8, 9, 10)] == got
    assert url_filters.judge_urls(pages.limit(0), url_filters.RULES).count() == 0


def test_urls_without_host_and_long_hosts(spark):
    host = "h" * 5000 + ".org"
    rows = [(1, "http://b.net/fr/", "<link rel=canonical href='http://#x'>"), (2, None, ""), (3, "nourl", ""), (4, f"http://{host}/a/b?q", "<link rel=canonical href='/c'>"), (5, f"http://{host}/c", ""), (6, f"http://{host}", "<link rel=canonical href='d?e'>"), (7, f"http://{host}/a/b?q=/x", "<link rel=canonical href='?r'>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["verdict"], r["alias_of"]) for r in url_filters.judge_urls(pages, url_filters.RULES).collect()}
    assert got[1][0] == "block" and got[2] == got[3] == ("allow", None)
    assert got[4] == got[5] == ("allow", f"{host}/a/b?q")
    edges = {tuple(r) for r in url_filters.alias_edges(pages).collect()}
    assert edges == {(f"{host}/a/b?q", f"{host}/c"), (host, f"{host}/d?e"), (f"{host}/a/b?q=/x", f"{host}/a/b?r")}


def test_log_ratios_against_counts(spark):
    rng = random.Random(3)
    texts = [(i, None if i == 3 else "" if i == 4 else " ".join(rng.choices("red green blue, one! two café".split(), k=rng.randint(1, 30)))) for i in range(60)]
    marks = [(i, int(i % 3 == 0)) for i in range(0, 60, 2)]
    got = importance.log_ratios(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int"))
    raw, target = np.ones(importance.BUCKETS), np.zeros(importance.BUCKETS)
    for i, t in texts:
        h = [zlib.crc32(w.encode()) for w in re.findall(r"\w+|[^\w\s]+", (t or "").lower())]
        for b in [x % importance.BUCKETS for x in h] + [(x * 1_000_003 + y * 8_191 + 1) % importance.BUCKETS for x, y in zip(h, h[1:])]:
            raw[b] += 1
            target[b] += dict(marks).get(i, 0)
    raw /= raw.sum()
    target += importance.PRIOR * raw
    assert np.allclose(got, np.log(target / target.sum() / raw))


def test_quality_on_labels(spark):
    """Of labelled rows the good ones are kept, and what is dropped is mostly bad."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null")
    rows = queries.QUERIES["op3_quality"](spark, sf).join(labels, "doc_id").groupBy("quality", "selected").count().collect()
    n = {(r["quality"], r["selected"]): r["count"] for r in rows}
    assert n[1, True] >= 0.97 * (n[1, True] + n.get((1, False), 0))
    assert n[0, False] >= 0.9 * (n[0, False] + n.get((0, True), 0))


def _fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_all_pairs(spark, odd):
    rng = random.Random(2)
    base = " ".join(rng.choice("abcdefghij") * 3 for _ in range(400)).split()
    texts = [" ".join(base)]
    for _ in range(120):
        w = base[:]
        for _ in range(rng.choice([0, 1, 2, 6])):
            w[rng.randrange(len(w))] = str(rng.random())
        texts.append(" ".join(w))
    texts += [" ".join(str(rng.random()) for _ in range(60)) for _ in range(60)] + [None, "", "A b", "a B"]
    fps = [_fingerprint(t) for t in texts]
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = up[i], up[j]
                up = [min(a, b) if u in (a, b) else u for u in up]
    got = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(up))
    assert {r["doc_id"]: r["fp"] % 2**64 for r in got} == dict(enumerate(fps))
    assert simhash.near_duplicates(odd).count() == len(ODD) and simhash.near_duplicates(odd.limit(0)).count() == 0


def test_forest_and_strips_lose_no_link(spark, monkeypatch):
    rng = random.Random(4)
    center = rng.getrandbits(64)
    fps = {center}
    while len(fps) < 90:
        x = center
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    up = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = up[i], up[j]
                up = [min(a, b) if u in (a, b) else u for u in up]
    nodes = spark.createDataFrame([(i, [f - 2**64 if f >> 63 else f]) for i, f in enumerate(fps)], "id long, fps array<long>")
    for rows in (2048, 16):
        monkeypatch.setattr(simhash, "UNIT_ROWS", rows)
        links = simhash.link_fingerprints(nodes, 3)
        found = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
        assert [found.get(i, i) for i in range(len(fps))] == up


def test_drop_near_copies(spark, odd):
    rng = random.Random(5)
    base = [str(rng.random()) for _ in range(300)]
    near = base[:]
    near[150] = "changed"
    far = base[:150] + [str(rng.random()) for _ in range(150)]
    docs = spark.createDataFrame([(7, " ".join(base)), (3, " ".join(near)), (9, " ".join(base)), (5, " ".join(far)), (6, None), (8, "")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.drop_near_copies(docs).collect()) == [3, 5, 6]
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 4, 5]
    assert simhash.drop_near_copies(odd.limit(0)).count() == 0


def _resemblance(a, b):
    x, y = (set(zip(*(t.split()[i:] for i in range(5)))) for t in (a, b))
    return len(x & y) / len(x | y)


def test_drop_near_copies_of_each_kind_of_edit(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(30_000)}"
    kinds = {
        "append": lambda t, k: t + [word() for _ in range(k)],
        "cut": lambda t, k: t[:-k],
        "prepend": lambda t, k: [word() for _ in range(k)] + t,
        "replace": lambda t, k: t[:60] + [word() for _ in range(k // 2)] + t[60 + k // 2 :],
        "scatter": lambda t, k: [word() if i % 50 == 7 else w for i, w in enumerate(t)],
    }
    rows, twin = [], {}
    for kind, edit in kinds.items():
        for share in (0.1, 0.15, 0.19):
            for _ in range(8):
                text = [word() for _ in range(rng.randint(120, 300))]
                rows += [" ".join(text), " ".join(edit(text, int(share * len(text))))]
                twin[len(rows) - 1] = kind
    kept = {r["doc_id"] for r in simhash.drop_near_copies(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert kept == {i for i in range(len(rows)) if i not in twin or _resemblance(rows[i - 1], rows[i]) < 0.8}
    assert len(rows) - len(kept) > 100


def test_drop_near_copies_behind_links_that_fail(spark):
    rng = random.Random(13)
    lines = [" ".join(f"w{rng.randrange(30_000)}" for _ in range(6)) for _ in range(40)]
    orders = [rng.sample(lines, len(lines)) for _ in range(6)]
    first, second = " ".join(lines), " ".join([*lines[:-1], lines[-1] + " more"])
    docs = [*(" ".join(x) for x in orders), first, second]
    assert _resemblance(first, second) > 0.95 and all(_resemblance(x, y) < 0.8 for x in docs[:6] for y in (first, second))
    kept = simhash.drop_near_copies(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(7))


def test_drop_near_copies_without_broadcasts(spark, odd, monkeypatch):
    monkeypatch.setattr(common, "MOST_BROADCAST", 0)
    test_drop_near_copies(spark, odd)


def test_keys_of_similar_sets_meet(monkeypatch):
    """Of two sets of resemblance 0.8 the keys share one, with common shingles or without, at any size."""
    rng = np.random.default_rng(3)
    for n in (1, 4, 5, 9, 10, 50, 190, 200, 260, 1000, 5000):
        for part in (0.0, 0.3, 0.5, 0.9):
            both = np.unique(rng.integers(-(2**62), 2**62, n))
            own = int(0.25 * len(both) / 2)  # of each: half of what a resemblance of 0.8 allows
            a, b = (np.unique(np.concatenate([both, rng.integers(-(2**62), 2**62, own)])) for _ in range(2))
            common_ones = np.sort(both[rng.random(len(both)) < part])
            table = np.stack([common_ones, np.full(len(common_ones), 9)], axis=1)
            assert len(np.intersect1d(simhash._keys(a, table), simhash._keys(b, table)))
            with monkeypatch.context() as m:
                m.setattr(simhash, "KEYS", None)
                whole = simhash._keys(a, table)
                assert len(whole) == len(a) - int(np.ceil(0.8 * len(a) - 1e-9)) + 1 and len(np.intersect1d(whole, simhash._keys(b, table)))
            assert len(simhash._keys(a, table)) <= max(simhash.KEYS, len(a) - int(np.ceil(0.8 * len(a) - 1e-9)) + 1)


def _kept_by_brute_force(rows):
    """doc_ids that one-of-each-group leaves, by all pairs."""
    sets = {}
    for i, t in rows:
        words = (t or "").lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    up = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and (len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = sorted((up[i], up[j]))
                up = {k: a if v == b else v for k, v in up.items()}
    return {i for i in up if up[i] == i}


def test_pipeline_against_brute_force(spark):
    """Each stage on what the stage before it kept, of whole tables."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = lambda df: sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "quality", "near_duplicates", "mixing", "encoding"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    one = common.keep(stages["toxicity"](spark, docs, sf), "test")
    scorer = toxicity.Scorer(toxicity.fit(docs, labels))
    assert one.schema == docs.schema and texts(one) == [(i, t) for i, t in texts(docs) if scorer.score([t])[0] < 0.3]
    two = common.keep(stages["quality"](spark, one, sf), "test")
    chosen = {r["doc_id"] for r in importance.resample(one, importance.log_ratios(one, labels)).where("selected").collect()}
    assert two.schema == docs.schema and texts(two) == [x for x in texts(one) if x[0] in chosen]
    three = common.keep(stages["near_duplicates"](spark, two, sf), "test")
    left = _kept_by_brute_force(texts(two))
    assert three.schema == docs.schema and texts(three) == [x for x in texts(two) if x[0] in left] and len(left) < two.count()
    four = common.keep(stages["mixing"](spark, three, sf), "test")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(three).collect()}
    assert four.schema == docs.schema and texts(four) == sorted(x for x in texts(three) for _ in range(copies[x[0]]))
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})
    five = [(r["doc_id"], r["ids"]) for r in stages["encoding"](spark, four, sf).collect()]
    assert sorted(five) == sorted((i, other.encode_ordinary(t or "")) for i, t in texts(four))
    assert sorted((r["doc_id"], r["ids"]) for r in corpus_pipeline.run(spark, sf).collect()) == sorted(five)


def test_pipeline_stages_on_odd_rows(spark, odd, tmp_path):
    """Nulls, empties, repeats, clashing columns and no rows, with and without labels."""
    import corpus_pipeline

    for n, marks in enumerate(([], [(i, i % 2, i % 2) for i in range(1, 6)])):
        sf = tmp_path / str(n)
        spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(sf / "labels.parquet"))
        for rows in (odd, odd.limit(0)):
            docs = rows
            for name, stage in corpus_pipeline.STAGES[:-1]:
                out = common.keep(stage(spark, docs, str(sf)), "test")
                assert out.columns == odd.columns and out.dtypes == odd.dtypes, name
                assert out.exceptAll(docs).isEmpty() or name == "mixing"
                docs = out
            coded = corpus_pipeline.STAGES[-1][1](spark, docs, str(sf))
            assert coded.count() == docs.count()


def test_importance(spark, odd):
    rng = random.Random(6)
    good, bad = "river stone cloud garden winter music".split(), "$$$ ### buy!! win!! click!!".split()
    texts = [(i, " ".join(rng.choices(good if i % 4 else bad, k=80))) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 400, 3)], "doc_id long, quality int")
    chosen = {r["doc_id"]: r["selected"] for r in importance.resample(docs, importance.log_ratios(docs, labels)).collect()}
    assert all(chosen[i] == (i % 4 > 0) for i in chosen)
    ratios = importance.log_ratios(docs, labels)
    keyed = importance.resample(docs, ratios, k=37).collect()
    best = sorted(keyed, key=lambda r: -r["sample_key"])[:37]
    assert {r["doc_id"] for r in keyed if r["selected"]} == {r["doc_id"] for r in best}
    assert importance.resample(odd, importance.log_ratios(odd, labels)).count() == len(ODD)
    assert importance.keep_selected(odd.limit(0), labels).count() == 0
    assert importance.kth_largest(spark.createDataFrame([(x,) for x in [3.0, 1.0, 3.0, 2.0, 2.0]], "v double"), "v", 3) == 2.0


def test_licenses(spark, odd):
    mit = license_scan.TEMPLATES["MIT"][2]
    edited = mit.replace("charge", "fee", 1)
    texts = ["word " * 40 + "Licensed under the Apache License, Version 2.0. " + "more " * 40, edited.upper() + " end", "this is no license at all, just words under the sun", "Released under the MIT License.", " ".join(mit.split()[:20]), "pad " * 333 + mit]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(m["license"], round(m["containment"], 2)) for m in r["matches"]] for r in license_scan.scan_licenses(docs).collect()}
    assert got[0] == [("Apache-2.0", 1.0)] and got[2] == [] and got[3] == [("MIT", 1.0)] and got[4] == [] and got[5] == [("MIT", 1.0)]
    assert len(got[1]) == 1 and got[1][0][0] == "MIT" and 0.8 <= got[1][0][1] < 1
    assert [r["matches"] for r in license_scan.scan_licenses(odd).collect()] == [[]] * len(ODD) and license_scan.scan_licenses(odd.limit(0)).count() == 0


def test_license_versions_differ(spark):
    texts = ["Licensed under the Apache License, Version 1.1 and so on", "This work is licensed under the GNU General Public License, version 2 only", "Licensed under the Apache License, Version 2.0."]
    got = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = [[(m["license"], m["containment"]) for m in r["matches"]] for r in sorted(got, key=lambda r: r["doc_id"])]
    assert found == [[], [("GPL", 7 / 8)], [("Apache-2.0", 1.0)]]  # another version is one shingle of the notice's


def test_licenses_against_containment_everywhere(spark):
    """What is retrieved and verified against the largest containment in any stretch of the text, for edited templates."""
    rng = random.Random(17)
    flat = [(n, t) for n, ts in license_scan.TEMPLATES.items() for t in ts]
    texts = []
    for n, t in flat * 3:
        words = t.split()
        for _ in range(rng.choice([0, 0, 1, len(words) // 20])):
            words[rng.randrange(len(words))] = "edited"
        texts.append(" ".join(["pad"] * rng.randint(0, 30) + words + ["end"] * rng.randint(0, 30)))
    got = {r["doc_id"]: {m["license"] for m in r["matches"]} for r in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    missed = wanted = 0
    for i, text in enumerate(texts):
        sh = license_scan.template_shingles(text)
        want = set()
        for n, t in flat:
            own = license_scan.template_shingles(t)
            reach = 3 * len(own) + 16
            if max(len(set(own) & set(sh[a : a + reach])) for a in range(max(1, len(sh) - reach + 1))) >= 0.8 * len(set(own)):
                want.add(n)
        assert got[i] <= want
        wanted, missed = wanted + len(want), missed + len(want - got[i])
    assert wanted >= len(flat) * 2 and missed <= 0.02 * wanted


def test_license_notices_of_the_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: {m["license"] for m in r["matches"]} for r in license_scan.scan_licenses(docs).collect()}
    for r in docs.collect():
        text = r["text"] or ""
        want = {n for n, t in (("Apache-2.0", "Licensed under the Apache License, Version 2.0"), ("MIT", "Released under the MIT License"), ("GPL", "This work is licensed under the GNU General Public License, version 3"), ("CC-BY-NC", "Licensed under CC BY-NC 4.0")) if t in text}
        assert want <= got[r["doc_id"]] and (want or not got[r["doc_id"]])


def _sketch(text):
    words = [xxhash.xxh64_intdigest(w, 42) for w in (text or "").encode().split()]
    runs = [words[i : i + 5] for i in range(max(1, len(words) - 4))] if words else []

    def chain(run):
        seed = 42
        for v in run:
            seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), seed)
        return seed - 2**64 if seed >> 63 else seed

    return {chain(r) for r in runs}


def test_sketches_against_whole_sets(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    order = sorted(rows, reverse=True)
    for r in sketches.fingerprint_edits(docs).collect():
        i = order.index(r["doc_id"])
        own, after = rows[order[i]], rows[order[(i + 1) % len(order)]]
        cut = len(own) // 3
        edited = own[: len(own) - cut] + after[:cut]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(own)
        assert r["sketch"] == sorted(_sketch(own))[:128] and r["edited_sketch"] == sorted(_sketch(edited))[:128] and r["next_sketch"] == sorted(_sketch(after))[:128]
    assert sketches.fingerprint_edits(odd).count() == len(ODD) and sketches.fingerprint_edits(odd.limit(0)).count() == 0


def test_sketch_algebra(spark):
    a, b = " ".join(map(str, range(2000))), " ".join(map(str, range(1000, 3000)))
    row = spark.createDataFrame([(a, b)], "a string, b string").select(sketches.sketch(F.col("a")).alias("a"), sketches.sketch(F.col("b")).alias("b"))
    r = row.select(sketches.resemblance(F.col("a"), F.col("b")), sketches.containment(F.col("a"), F.col("b")), sketches.distinct_shingles(F.col("a"))).first()
    assert abs(r[0] - 1 / 3) < 0.15 and abs(r[1] - 0.5) < 0.2 and abs(r[2] / 1996 - 1) < 0.3
    parts = spark.createDataFrame([(" ".join(map(str, range(70))), " ".join(map(str, range(70, 150))), " ".join(map(str, range(150))))], "x string, y string, z string")
    x, y = (sketches.word_hashes(F.col(c)) for c in "xy")
    joined = sketches.merge(sketches.merge(sketches.sketch(F.col("x")), sketches.sketch(F.col("y"))), sketches.bottom_k(sketches.seam(x, y)))
    assert parts.select(joined == sketches.sketch(F.col("z"))).first()[0]


def test_html():
    chain = html_extract.default_chain()
    pages = html_extract.labelled_pages(200, seed=77)
    good = sum(html_extract.extract(p, chain) == "\n".join(g) for p, g in pages)
    assert good >= 180
    page = "<html><head><title>no</title></head><body><nav><a href=/>Home</a></nav><article><h1>T &amp; t</h1><p>One\n two <b>three</b>.<p>Four&nbsp;five.<div class='ad'>Buy now.</div></article><section class=comments><p>I agree with this.</p></section><footer>&copy; x</footer><script>var a='<p>z</p>'"
    assert html_extract.extract(page, chain) == "T & t\nOne two three.\nFour five."
    assert [html_extract.extract(p, chain) for p in (None, "", "<p", "<!-- <p>x</p>")] == [""] * 4
    assert len(html_extract.extract("<article>" + "<p>Some words in a line.</p>" * 20_000, chain).split("\n")) == 20_000


def test_html_goes_on_after_what_has_no_end():
    chain = html_extract.default_chain()
    body = "<p>The first words of the story stand here.</p>{}<p>And the last words of it are here, too.</p></article></body></html>"
    for odd in ("<svg width=3 />", "<object data=x />", "<canvas id=c>", "<select>", "<noscript>", "<svg><path d=1 /></svg>", "<iframe src=y></iframe>", "<math/>", "<template>"):
        page = "<html><body><nav><a href=/>Home</a></nav><article><h1>A title of some words</h1>" + body.format(odd)
        assert html_extract.extract(page, chain) == "A title of some words\nThe first words of the story stand here.\nAnd the last words of it are here, too.", odd


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(2)
    chain = html_extract.Chain()
    chain.weight, chain.bias, chain.move = rng.normal(size=html_extract.FEATURES), 0.1, rng.normal(size=(2, 2))
    for page, _ in html_extract.labelled_pages(12, seed=5):
        blocks = html_extract.blocks_of(page)[:9]
        own = chain.scores(blocks)
        score = lambda ys: sum(s for s, y in zip(own, ys) if y) + sum(chain.move[a, b] for a, b in zip(ys, ys[1:]))  # noqa: E731, B023
        best = max(itertools.product((0, 1), repeat=len(blocks)), key=score)
        assert score(chain.decode(blocks)) == pytest.approx(score(best))


def test_html_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (2, "u", "")], "page_id long, url string, html string").withColumn("text", F.lit(3))
    got = html_extract.extract_pages(pages, html_extract.default_chain()).collect()
    assert [(r["text"], r["n_chars"]) for r in got] == [("", 0)] * 3


def test_toxicity_learns_subwords(spark, odd):
    rng = random.Random(8)
    plain, bad = [f"{rng.choice('bdgklm')}{rng.choice('aeiou')}{rng.choice('nrst')}{rng.choice('aeiou')}" for _ in range(300)], ["horrible", "disgusting", "pathetic"]
    make = lambda t: " ".join(rng.choices(plain, k=60) + [rng.choice(bad) for _ in range(3 * t)])
    y = [i % 2 for i in range(400)]
    model = toxicity.train([make(t) for t in y], y)
    scorer = toxicity.Scorer(model)
    assert ((scorer.score([make(t) for t in y]) >= 0.3) == y).sum() >= 380
    assert np.greater(*scorer.score([make(0) + " horible disgustng patetic", make(0)]))
    once, twice = scorer.score(["horrible river stone", "horrible horrible horrible river stone"])
    assert twice > once
    got = toxicity.score_documents(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got) and got[0]["score"] == got[1]["score"]
    kept = toxicity.keep_clean(odd, model, threshold=1.1)
    assert kept.columns == odd.columns and sorted(kept.collect(), key=str) == sorted(odd.collect(), key=str)
    assert toxicity.keep_clean(odd.limit(0), model).count() == 0 and toxicity.score_documents(odd.limit(0), model).count() == 0
    assert toxicity.Scorer(toxicity.train([], [])).score(["x"])[0] < 0.01
    held = odd.select("doc_id", toxicity.held_out().alias("h")).collect()
    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in held)


def test_toxicity_reads_long_words_whole(monkeypatch):
    rng = random.Random(12)
    plain, bad = [f"{rng.choice('bdgklm')}{rng.choice('aeiou')}{rng.choice('nrst')}{rng.choice('aeiou')}" for _ in range(300)], ["horrible", "disgusting", "pathetic"]
    make = lambda t: "_".join(rng.choices(plain, k=60) + [rng.choice(bad) for _ in range(20 * t)])
    y = [i % 2 for i in range(400)]
    scorer = toxicity.Scorer(toxicity.train([make(t) for t in y], y))
    assert all(len(make(0)) > 200 for _ in range(9)) and ((scorer.score([make(t) for t in y]) >= 0.3) == y).sum() >= 380
    words = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n)) for n in (1, 2, 198, 300, 301, 2000)] + ["x" * 300 + "a", "x" * 300 + "b"]
    wanted = [sorted(_by_word(words[i : i + 1])[0]) for i in range(len(words))]
    assert [len(w) for w in wanted] == [sum(max(0, len(w) + 3 - n) for n in range(3, 7)) + 1 for w in words] and wanted[-1] != wanted[-2]
    for block in (7, 64, 1 << 16):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        assert [sorted(x) for x in _by_word(words)] == wanted


def _by_word(words):
    out = [[] for _ in words]
    for ids, owner in toxicity.subwords(words):
        for i, o in zip(ids.tolist(), owner.tolist()):
            out[o].append(i)
    return out


def test_equal_texts_score_equally_whatever_the_batch(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS), 0.1)
    words = ["".join(rng.choice(list("abcdeé日"), rng.integers(1, n))) for n in [9] * 60 + [300] * 6]
    texts = [" ".join(rng.choice(words, rng.integers(1, 30))) for _ in range(60)]
    alone = [toxicity.Scorer(model).score([t])[0] for t in texts]
    for size in (2, 7, 60):
        for part in range(0, 60, size):
            assert toxicity.Scorer(model).score(texts[part : part + size]).tolist() == alone[part : part + size]
    assert toxicity.Scorer(model).score(texts[::-1]).tolist() == alone[::-1]


def test_a_labelled_text_beyond_the_bound_is_passed_over(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_CHARS", 3000)
    rows = [(i, ("vile " if i % 2 else "fine ") * 20, i % 2) for i in range(24)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(i, "long " * 5000) for i in range(100, 130)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(i, 0) for i in range(100, 130)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    bad, good = toxicity.Scorer(model).score(["vile " * 20, "fine " * 20])
    assert bad > good and np.count_nonzero(model.effect)


def test_toxicity_gradient_against_differences():
    """A single step of training moves what it touches against the numerical gradient of the cross-entropy."""
    texts, y = ["bad awful word", "good kind word", "bad bad thing", "kind thing here"] * 3, [1, 0, 1, 0] * 3
    bags, shares = toxicity._bags(texts)
    rng = np.random.default_rng(0)
    emb, w = rng.normal(size=(toxicity.BUCKETS, 3)), rng.normal(size=(3, 2))

    def loss(e):
        z = np.stack([(e[b] * s[:, None]).sum(0) for b, s in zip(bags, shares)]) @ w
        return -(z[np.arange(len(y)), y] - np.log(np.exp(z).sum(1))).mean()

    z = np.stack([(emb[b] * s[:, None]).sum(0) for b, s in zip(bags, shares)]) @ w
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    for bucket in rng.choice(bags[0], 5):
        for k in range(3):
            near = emb.copy()
            near[bucket, k] += 1e-5
            by_rule = sum((p[i] @ w[k]) * shares[i][bags[i] == bucket].sum() for i in range(len(y))) / len(y)
            assert by_rule == pytest.approx((loss(near) - loss(emb)) / 1e-5, abs=1e-5)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = queries.QUERIES["op7_toxicity"](spark, "/root/testdata/sf0.1").join(labels.where("toxic is not null"), "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    hits = rows[rows["predicted"] == 1]
    assert (hits["toxic"] == 1).mean() > 0.8 and (rows[rows["toxic"] == 1]["predicted"] == 1).mean() > 0.75
    order = rows["score"].rank()
    n, m = (rows["toxic"] == 1).sum(), (rows["toxic"] == 0).sum()
    assert (order[rows["toxic"] == 1].sum() - n * (n + 1) / 2) / (n * m) > 0.93


def test_mixing_cells_and_targets(spark, odd):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 50])), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, many = ({r["doc_id"]: (r["copies"], r["target"]) for r in mixing.mix(docs, cell_rows=c).collect()} for c in (1_000_000, 7))
    assert one == many
    sums = {}
    for r in mixing.mix(docs).collect():
        s = sums.setdefault(r["source"], [0, r["target"], r["source_size"]])
        s[0] += r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 3
    assert all(abs(t - want) <= 50 + 1e-6 and want <= 3 * size for t, want, size in sums.values())
    assert math.isclose(sum(s[1] for s in sums.values()), sum(s[2] for s in sums.values()))
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(odd.limit(0)).count() == 0
    copies = sum(r["copies"] for r in mixing.mix(odd).collect())
    taken = mixing.take_copies(odd)
    assert taken.columns == odd.columns and taken.count() == copies


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(public_tokenizers.path(bpe.VOCABULARY))


def test_bpe_against_tiktoken(encoder):
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(10)
    kinds = ["abcdefgh", " \n\t", "éüñßçø", "日本語漢字", "😀👩‍🚀", "0123456789", "'s't.,!?<|endoftext|>", "the and ing tion "]
    for _ in range(1500):
        s = "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 60)))
        ids = encoder.encode(s)
        assert ids == other.encode_ordinary(s) and encoder.decode(ids) == s.encode()
        assert all("".join(bpe.decode_stream(encoder, ids, n)) == s for n in (1, 3, 1000))
    small = bpe.Transducer(ranks, most=50)
    for w in ("unbelievable", "xqzzkwj", "a" * 3000):
        assert small.encode(w.encode()) == other.encode_ordinary(w)
    for _ in range(3000):
        a, b = rng.randrange(4000), rng.randrange(4000)
        token = encoder.transducer.token
        assert encoder.transducer.neighbours(a, b) == (bpe.merge_by_rank(token[a] + token[b], ranks) == [a, b])


def test_utf8_machine():
    rng = random.Random(11)
    for _ in range(2000):
        raw = bytes(rng.choice([65, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xFF, 0xC0, 0xF4, 0x90]) for _ in range(rng.randint(0, 12)))
        state = bpe.Utf8Decoder()
        assert "".join(state.feed(raw[i : i + 1]) for i in range(len(raw))) + state.end() == raw.decode("utf-8", "replace")
        cut, state = rng.randint(0, len(raw)), bpe.Utf8Decoder()
        assert state.feed(raw[:cut]) + state.feed(raw[cut:]) + state.end() == raw.decode("utf-8", "replace")


def test_decoding_steps_over_every_byte(encoder, monkeypatch):
    rng, steps = random.Random(12), bpe.utf8_steps
    text = "".join(rng.choice("abc déß 日本語 😀👩‍🚀\n") for _ in range(3000))
    ids = encoder.encode(text)
    for at_once in (1, 7, 1 << 14):
        stepped = []
        monkeypatch.setattr(bpe, "utf8_steps", lambda state, chunk: (stepped.append(len(chunk)), steps(state, chunk))[1])
        machine = bpe.TokenMachine(encoder.transducer.token, most=0)  # forgets after each part: with single tokens, every byte of the text is stepped over anew
        assert "".join(machine.stream(ids, at_once)) == text
        assert sum(stepped) == len(text.encode()) if at_once == 1 else sum(stepped) >= sum(len(encoder.transducer.token[i]) for i in set(ids))
    kept = bpe.TokenMachine(encoder.transducer.token)
    monkeypatch.setattr(bpe, "utf8_steps", lambda state, chunk: (steps(state, chunk)[0], "?"))
    assert "".join(kept.stream(ids, 100)) == "?" * len(ids)  # nothing but the machine makes text
    monkeypatch.setattr(bpe, "utf8_steps", steps)
    for most in (0, 3, 1000):
        odd_ids = [rng.randrange(50_000) for _ in range(2000)]
        machine = bpe.TokenMachine(encoder.transducer.token, most)
        assert "".join(machine.stream(odd_ids, 5)) == encoder.decode(odd_ids).decode("utf-8", "replace")


def test_bpe_rows(spark, odd):
    path = public_tokenizers.path(bpe.VOCABULARY)
    got = bpe.encode_documents(odd, path).collect()
    assert got[0]["ids"] == [] and all(r["whole"] for r in got)
    digests = [(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encoding_digests(odd, path).collect()]
    packed = [np.array(r["ids"], dtype="<u4").tobytes() for r in got]
    assert digests == [(len(p) // 4, hashlib.sha256(p).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for p, (_, t, _) in zip(packed, ODD)]
    assert bpe.encoding_digests(odd.limit(0), path).count() == 0


def test_jpeg_round_trip(spark, odd):
    rng = random.Random(12)
    payloads = [bytes(64), b"\xff" * 128, rng.randbytes(64 * 100), rng.randbytes(64 * (jpeg_media.ROWS + 5))]
    stored = jpeg_media.store(payloads)
    assert [b"".join(t.tobytes() for t in x) for x in jpeg_media.read(stored)] == payloads
    got = jpeg_media.media_columns(odd).collect()
    for r, (_, text, _) in zip(got, ODD):
        n, payload = jpeg_media.payload_of(text)
        assert r["n_bytes"] == n and r["payload_bytes"] == len(payload) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media_bytes"] == len(r["media"])
    assert jpeg_media.media_columns(odd.limit(0)).count() == 0


def test_jpeg_with_ac_coefficients_and_no_restarts():
    """A stream of ours re-coded by hand: two blocks whose AC coefficients must be read over."""
    dc = jpeg_media.code_words(jpeg_media.DC_COUNTS, jpeg_media.DC_VALUES)
    ac_counts, ac_values = [0, 3] + [0] * 14, [0x00, 0x11, 0xF0]
    ac = jpeg_media.code_words(ac_counts, ac_values)
    bits = ""
    put = lambda pair: format(pair[0], f"0{pair[1]}b")
    bits += put(dc[3]) + "101" + put(ac[0xF0]) + put(ac[0x11]) + "1" + put(ac[0]) + put(dc[2]) + "00" + put(ac[0])
    raw = int(bits + "1" * (-len(bits) % 8), 2).to_bytes((len(bits) + 7) // 8, "big").replace(b"\xff", b"\xff\x00")
    seg = jpeg_media._segment
    head = b"\xff\xd8" + seg(0xE0, b"note") + seg(0xDB, bytes([0, 8] + [1] * 63)) + seg(0xC0, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0])) + seg(0xC4, bytes([0, *jpeg_media.DC_COUNTS, *jpeg_media.DC_VALUES])) + seg(0xC4, bytes([16, *ac_counts, *ac_values])) + seg(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    (thumb,) = jpeg_media.read([head + raw + b"\xff\xd9"])[0]
    assert thumb.tolist() == [[128 + 5, 128 + 5 - 3]]


@pytest.mark.parametrize("copies", [1, 60])
def test_jpeg_tables_of_each_image(copies):
    """The same bytes with another quantisation table beside them: each is read by its own."""
    (one,) = jpeg_media.store([bytes(range(64))])
    at = one.index(b"\xff\xdb") + 5  # the DC entry
    other = one[:at] + bytes([one[at] // 2]) + one[at + 1 :]
    alone = [jpeg_media.read([x])[0][0].tolist() for x in (one, other)]
    assert alone[0] != alone[1]
    assert [x[0].tolist() for x in jpeg_media.read([one, other] * copies)] == alone * copies


def test_average_hash():
    ramp = np.add.outer(np.arange(16), np.arange(16)).astype(np.uint8)
    assert jpeg_media.average_hash(ramp) == jpeg_media.average_hash(ramp.repeat(2, 0).repeat(2, 1)) != jpeg_media.average_hash(ramp[::-1])
