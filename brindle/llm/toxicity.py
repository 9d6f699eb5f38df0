"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, forget, keep, let_go, sliced, table, tidy

#: Most labelled rows of each class that the model is trained on, by hash of doc_id, and most characters of them together.
MOST_TOXIC, MOST_CLEAN, MOST_CHARS = 1000, 2000, 40_000_000
#: Hash buckets of subwords, their least and greatest length in characters with the word's < and >, and dimensions.
BUCKETS, SHORTEST, LONGEST, DIMENSIONS = 1 << 17, 3, 6, 8
STEPS, BATCH, RATE, DECAY = 1100, 32, 0.5, 1e-6
#: A bucket takes part if so many training texts have it.
LEAST_TEXTS = 3
#: From this score on a document counts as toxic.
THRESHOLD = 0.3
#: Neutral subwords that each text is averaged with, so that a few words alone decide little.
PADDING = 200
#: Words remembered by a worker, characters whose subwords are hashed at once, and texts whose bags stand in one array.
MOST_WORDS, BLOCK, TEXTS = 200_000, 1 << 16, 256

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[1]
    return h ^ (h >> np.uint64(29))


def subwords(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, places in words) of the character n-grams of each <word> and of each whole word, in blocks of whole words; a word
    longer than a block is cut at fixed distances from its own beginning. So a word's n-grams come in one order whatever
    stands beside it. The hash of an n-gram is of its code points alone."""
    if not words:
        return
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    ends = np.cumsum(lengths)
    whole = np.zeros(len(words), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for start, stop in _blocks(ends - lengths, ends):
            part = codes[start : stop + LONGEST - 1].astype(np.uint64) + np.uint64(1)  # n-grams of a long word may end in the next block
            at = np.arange(start, stop)
            owner = np.searchsorted(ends, at, "right")
            left = ends[owner] - at
            part = np.concatenate([part, np.zeros(len(at) + LONGEST - 1 - len(part), dtype=np.uint64)])
            h = np.zeros(len(at), dtype=np.uint64)
            for n in range(1, LONGEST + 1):
                h = (h + part[n - 1 : n - 1 + len(at)]) * _ODD[0]
                h ^= h >> np.uint64(31)
                if n >= SHORTEST:
                    fits = left >= n
                    yield (_mixed(h[fits] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int32), owner[fits]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            signs = _mixed(part[: len(at)] * _ODD[0] + (lengths[owner] - left).astype(np.uint64) * _ODD[2]) * _ODD[0]
            whole[owner[first]] += np.add.reduceat(signs, first)
        yield (_mixed(whole) % np.uint64(BUCKETS)).astype(np.int32), np.arange(len(words))


def _blocks(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of whole words of at most BLOCK characters, and pieces of so many of a longer word."""
    first = 0
    while first < len(ends):
        begin = int(starts[first])
        last = max(int(np.searchsorted(ends, begin + BLOCK, "right")), first + 1)
        for at in range(begin, int(ends[last - 1]), BLOCK):
            yield at, min(at + BLOCK, int(ends[last - 1]))
        first = last


def tokens(text: str | None) -> dict[str, int]:
    """The words of a text and how often each comes, in order, so that sums don't depend on the process."""
    return Counter(text.lower().split()) if text else {}


def weights_of(counts: dict[str, int]) -> np.ndarray:
    """What a word counts for: the first time fully, repeats ever less, as a text of many lines may repeat one."""
    return 1 + np.log(np.fromiter(counts.values(), dtype=float, count=len(counts)))


@dataclass
class Model:
    """What scoring needs: of each bucket the embedding's product with the difference of the two classes' weights, and of the biases."""

    effect: np.ndarray
    bias: float


class Scorer:
    """Scores with a model. A word's subwords are summed once; what is classified is the mean over a text's subwords and the padding."""

    def __init__(self, model: Model):
        self.model, self.words = model, {}

    def learn(self, texts: list[dict[str, int]]) -> None:
        """Sums the subwords of the words that are new, all at once."""
        if len(self.words) > MOST_WORDS:
            self.words.clear()
        known = self.words
        new = list(dict.fromkeys(w for t in texts for w in t if w not in known))
        sums, sizes = np.zeros(len(new)), np.zeros(len(new))
        for ids, owner in subwords(new):
            sums += np.bincount(owner, weights=self.model.effect[ids], minlength=len(new))
            sizes += np.bincount(owner, minlength=len(new))
        known.update(zip(new, (sums + 1j * sizes).tolist()))

    def score(self, texts: list[str | None]) -> np.ndarray:
        bags = [tokens(t) for t in texts]
        self.learn(bags)
        logits = np.full(len(bags), self.model.bias)
        for i, bag in enumerate(bags):
            if bag:
                both = weights_of(bag) @ np.fromiter(map(self.words.__getitem__, bag), dtype=complex, count=len(bag))
                logits[i] += both.real / (both.imag + PADDING)  # real: the sum of effects; imaginary: the number of subwords
        return 1 / (1 + np.exp(-np.clip(logits, -50, 50)))


def _bags(texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each text its distinct buckets and their shares of its subwords and the padding."""
    parts = []  # of TEXTS texts each: their buckets and shares end to end, in arrays large enough to be given back to the system
    for i in range(0, len(texts), TEXTS):
        counts = [tokens(t) for t in texts[i : i + TEXTS]]
        number = {w: n for n, w in enumerate(dict.fromkeys(w for c in counts for w in c))}
        found = list(subwords(list(number)))
        own = np.concatenate([np.zeros(0, dtype=np.int64), *(p[1] for p in found)])
        flat = np.concatenate([np.zeros(0, dtype=np.int32), *(p[0] for p in found)])[np.argsort(own, kind="stable")]
        sizes = np.bincount(own, minlength=len(number))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        some = [_bag(c, [number[w] for w in c], flat, starts, sizes) for c in counts]
        parts.append((np.concatenate([x[0] for x in some]), np.concatenate([x[1] for x in some]), np.array([len(x[0]) for x in some])))
    frequent = sum((np.bincount(p[0], minlength=BUCKETS) for p in parts), np.zeros(BUCKETS, dtype=np.int64)) >= LEAST_TEXTS
    bags, shares = [], []
    for k, (buckets, share, lengths) in enumerate(parts):
        met = frequent[buckets]
        cuts = np.cumsum(np.add.reduceat(met, np.cumsum(lengths) - lengths) * (lengths > 0) if len(buckets) else lengths)[:-1] if len(lengths) else []
        parts[k] = None
        for b, s in zip(np.split(buckets[met], cuts), np.split(share[met], cuts)):
            bags.append(b if len(b) else np.zeros(1, dtype=np.int32))
            shares.append(s if len(b) else np.zeros(1, dtype=np.float32))
    return bags, shares


def _bag(counts: dict[str, int], own: list[int], flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not own:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32)
    each = np.repeat(weights_of(counts), sizes[own])
    uniq, place = np.unique(np.concatenate([flat[starts[i] : starts[i + 1]] for i in own]), return_inverse=True)
    return uniq, (np.bincount(place, weights=each, minlength=len(uniq)) / (each.sum() + PADDING)).astype(np.float32)


def train(texts: list[str | None], labels: list[int], seed: int = 7) -> Model:
    """Embeddings and softmax weights learnt together by AdaGrad on the cross-entropy. With one class or none, each score is its share."""
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS), 50.0 if labels and labels[0] else -50.0)
    rng = np.random.default_rng(seed)
    bags, counts = _bags(texts)
    y = np.array(labels)
    emb = (rng.random((BUCKETS, DIMENSIONS), dtype=np.float32) - 0.5) / DIMENSIONS
    w, b = (rng.random((DIMENSIONS, 2)) - 0.5).astype(np.float32), np.zeros(2, dtype=np.float32)
    sq_e, sq_w, sq_b = np.full((BUCKETS, DIMENSIONS), 1e-8, dtype=np.float32), np.full((DIMENSIONS, 2), 1e-8), np.full(2, 1e-8)
    order = np.zeros(0, dtype=np.int64)
    for _ in range(STEPS):
        if len(order) < BATCH:
            order = np.concatenate([order, rng.permutation(len(y))])
        rows, order = order[:BATCH], order[BATCH:]
        ids, share = np.concatenate([bags[r] for r in rows]), np.concatenate([counts[r] for r in rows])
        lengths = np.array([len(bags[r]) for r in rows])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        mean = np.add.reduceat(emb[ids] * share[:, None], starts)
        z = mean @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(rows)), y[rows]] -= 1
        g = p / len(rows)
        g_w, g_b, g_mean = mean.T @ g, g.sum(0), g @ w.T
        touched = np.flatnonzero(np.bincount(ids, minlength=BUCKETS))
        weighted = np.repeat(g_mean, lengths, axis=0) * share[:, None]
        g_e = np.stack([np.bincount(ids, weights=weighted[:, k], minlength=BUCKETS)[touched] for k in range(DIMENSIONS)], axis=1).astype(np.float32) + DECAY * emb[touched]
        sq_e[touched] += g_e**2
        emb[touched] -= RATE * g_e / np.sqrt(sq_e[touched])
        sq_w += g_w**2
        sq_b += g_b**2
        w -= (RATE / 5 * g_w / np.sqrt(sq_w)).astype(np.float32)
        b -= (RATE / 5 * g_b / np.sqrt(sq_b)).astype(np.float32)
    effect = (emb @ (w[:, 1] - w[:, 0])).astype(np.float64)
    met = np.zeros(BUCKETS, dtype=bool)
    met[np.concatenate(bags)] = True
    return Model(np.where(met, effect, 0.0), float(b[1] - b[0]))  # what training has not met is neutral


def held_out() -> F.Column:
    """Whether a doc_id's row is kept from training: the CRC-32 of its text form leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of labels (doc_id, toxic) on docs (doc_id, text), without held-out rows.

    At most MOST_TOXIC and MOST_CLEAN labelled rows are collected, those of smallest hash of doc_id, and of these the first
    that have MOST_CHARS characters together; a row that alone has more is passed over. Rows with a null label or doc_id don't count; a doc_id labelled twice counts
    by its larger label.
    """
    known = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = [known.where(is_).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for is_, n in (("toxic = 1", MOST_TOXIC), ("toxic = 0", MOST_CLEAN))]
    chosen = F.broadcast(some[0].union(some[1]))  # MOST_TOXIC + MOST_CLEAN rows at most
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select(F.xxhash64("doc_id").alias("place"), "doc_id", "text", "toxic")
    rows = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= MOST_CHARS)
    sample = keep(rows.orderBy("place", "doc_id", "text").limit(MOST_TOXIC + MOST_CLEAN), "sample")
    sizes = sample.select(F.coalesce(F.length("text"), F.lit(0)).alias("n"), "place").orderBy("place").toPandas()
    fits = sizes["place"][sizes["n"].cumsum() <= MOST_CHARS]
    if len(fits) < len(sizes):
        sample = sample.where(F.col("place") <= int(fits.max()) if len(fits) else F.lit(False))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        let_go()
        rows = rows.sort_values(["place", "doc_id", "text"], kind="stable", na_position="first")
        model = train(rows["text"].tolist(), rows["toxic"].astype(int).tolist())
        return pd.DataFrame({"effect": [model.effect], "bias": [model.bias]})

    # one task, of the bounded sample: an executor's memory rather than the driver's
    learnt = sample.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, "effect array<double>, bias double").collect()
    forget(sample)
    return Model(np.array(learnt[0]["effect"]), learnt[0]["bias"]) if learnt else train([], [])


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for each row of docs (doc_id, text). Null and empty texts get the score of no words at all.
    Texts are read whole, words of any length too. Repeated rows get equal scores; other columns are not carried; an empty
    table gives no rows."""

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        scorer = Scorer(model)
        for x in sliced(batches):
            scores = scorer.score(x["text"].tolist())
            yield pd.DataFrame({"doc_id": x["doc_id"].to_numpy(), "score": scores, "predicted": (scores >= threshold).astype(np.int32)})

    return batched(docs.select("doc_id", "text")).mapInPandas(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns as they are, that score below the threshold; nulls, empty and repeated rows and an empty
    table as in score_documents."""
    at = docs.columns.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        scorer = Scorer(model)
        for x in batches:
            texts = pd.DataFrame({"text": x.column(at).to_pylist()})
            scores = [scorer.score(part["text"].tolist()) for part in sliced([texts])]
            yield x.filter(pa.array(np.concatenate([np.zeros(0), *scores]) < threshold))

    return batched(docs).mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
