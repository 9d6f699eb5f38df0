"""The pipeline's filtering and mixing stages against code of their own: plain loops over words, counts and sorted lists."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from brindle.llm import common, importance, toxicity

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
M = (1 << 64) - 1
ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


@pytest.fixture(scope="module")
def kept(spark):
    """Rows (doc_id, text, source) that each of the first three stages keeps of the one before it."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name in (None, "toxicity", "quality"):
        docs = common.keep(STAGES[name](spark, docs, SF), "test") if name else docs
        out.append([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
    return out


def mixed(h):
    h = ((h ^ (h >> 32)) * ODD[1]) & M
    return h ^ (h >> 29)


def buckets(word):
    codes = [ord(c) + 1 for c in f"<{word}>"]
    for i in range(len(codes)):
        h = 0
        for n, c in enumerate(codes[i : i + 6], 1):
            h = ((h + c) * ODD[0]) & M
            h ^= h >> 31
            if n >= 3:
                yield mixed((h + n) & M) % toxicity.BUCKETS
    whole = sum(mixed((c * ODD[0] + i * ODD[2]) & M) * ODD[0] for i, c in enumerate(codes)) & M
    yield mixed(whole) % toxicity.BUCKETS


def test_toxicity_word_by_word(spark, kept):
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    known = {}

    def score(text):
        above, below = 0.0, float(toxicity.PADDING)
        for word, times in Counter((text or "").lower().split()).items():
            if word not in known:
                own = list(buckets(word))
                known[word] = (sum(model.effect[b] for b in own), len(own))
            above += (1 + math.log(times)) * known[word][0]
            below += (1 + math.log(times)) * known[word][1]
        return 1 / (1 + math.exp(-(model.bias + above / below)))

    clean = [i for i, t, _ in kept[0] if score(t) < 0.3]
    assert sorted(i for i, *_ in kept[1]) == sorted(clean) and 0 < len(clean) < len(kept[0])


def test_quality_count_by_count(spark, kept):
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    n = importance.BUCKETS

    def grams(text):
        h = [zlib.crc32(w.encode()) for w in re.findall(r"\w+|[^\w\s]+", (text or "").lower())]
        return [x % n for x in h] + [(x * 1_000_003 + y * 8_191 + 1) % n for x, y in zip(h, h[1:])]

    raw, target = np.ones(n), np.zeros(n)
    for i, text, _ in kept[1]:
        for b in grams(text):
            raw[b] += 1
            target[b] += i in good
    raw /= raw.sum()
    target += importance.PRIOR * raw
    ratio = np.log(target / target.sum()) - np.log(raw)
    weight = {i: sum(ratio[b] for b in grams(t)) for i, t, _ in kept[1]}

    def noise(i):
        h = xxhash.xxh64_intdigest((20240607).to_bytes(4, "little"), xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42))
        return -math.log(-math.log(((h >> 11) + 0.5) / 2**53))

    k = sum(w > -importance.TOLERANCE for w in weight.values())
    chosen = sorted(weight, key=lambda i: -(weight[i] + noise(i)))[:k]
    assert sorted(i for i, *_ in kept[2]) == sorted(chosen) and 0 < k < len(weight)


def test_mixing_list_by_list(spark, kept):
    docs = common.keep(STAGES["near_duplicates"](spark, STAGES["quality"](spark, STAGES["toxicity"](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF), SF), SF), "test")
    rows = [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in docs.collect()]
    sizes = defaultdict(int)
    for _, s, z in rows:
        sizes[s] += z
    names = sorted(sizes)  # no source is null here
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        free -= over
    want = Counter()
    for s in names:
        offset = int(hashlib.md5(s.encode()).hexdigest()[:8], 16) / 2**32
        order = sorted((z, hashlib.md5(str(i).encode()).hexdigest(), i) for i, x, z in rows if x == s)
        rate = target[s] / sizes[s]
        for place, (_, _, i) in enumerate(order, 1):
            want[i] += min(3, math.floor(place * rate + offset) - math.floor((place - 1) * rate + offset))
    got = Counter(r["doc_id"] for r in STAGES["mixing"](spark, docs, SF).collect())
    assert got == +want and max(got.values()) > 1
    for s in names:
        taken = sum(got[i] * z for i, x, z in rows if x == s)
        assert abs(taken - target[s]) <= max(z for _, x, z in rows if x == s) * 3
