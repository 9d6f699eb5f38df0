"""Phrase collocation mining with generalised suffix automata.

A shard is a bounded stretch of a partition's words of one language. Its generalised suffix automaton (Blumer et al., 1985) has
a state for each set of end positions that some phrase has; the phrases of a state are the suffixes of its longest that are
longer than the longest of the state it links to. The links form the compact trie of the phrases read backwards, so up to a
bounded depth states, links and counts of end positions come from sorting the positions by the words before them. Each shard
tells its phrases with their counts, and the counts are added over all shards by Spark.

No phrase is more frequent than its parts. So words are counted first, then hashes of the pairs of frequent words, then
phrases of 2 to 5 words all of whose pairs are frequent. What is frequent enough goes to the shards as a filter of bounded size
(one bit a hash): it lets some others pass and never loses one, and what is counted last are the phrases themselves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, beside, forget, keep, table, tidy

LEAST, LONGEST, FIRST = 100, 5, 2000
#: Words of a shard.
SHARD_WORDS = 1 << 19
#: Bytes of a text that are cut into words at once.
SLICE_BYTES = 1 << 20
#: Bits of a filter of frequent phrases: 2 to this power.
FILTER_BITS = 27
#: Phrases that a shard tells in one batch.
BATCH_PHRASES = 1 << 16

#: A-Z lower-cased; a full stop for whatever ends a piece, a blank for a tab.
MAPPED = bytes.maketrans(UPPER.encode() + b",;:!?\n\x0b\x0c\r\t", LOWER.encode() + b"." * 9 + b" ")


class SuffixAutomaton:
    """The states of the generalised suffix automaton of runs of words, up to a depth: of each, its longest phrase's length, its
    link (a state's number; -1: the start), how many positions its phrases end at, and one of these.

    codes: numbers of words, from 1; reach: how many words of its run end at each position, itself included (0: not counted, as
    nothing ends there). Sorted by the words read backwards, the positions whose last k words agree are neighbours. Those groups
    are the phrases of k words; a group that is as large as the group of k - 1 words around it has the same end positions."""

    def __init__(self, codes: np.ndarray, reach: np.ndarray, depth: int):
        ends = np.flatnonzero(reach)
        span = np.minimum(reach[ends], depth)
        bits = max(int(codes.max(initial=0)).bit_length(), 1)
        fit = max(62 // bits, 1)
        back = [np.where(span > k, codes[np.maximum(ends - k, 0)], 0).astype(np.int64) for k in range(depth)]
        keys = []
        for begin in range(0, depth, fit):
            key = np.zeros(len(ends), np.int64)
            for words in back[begin : begin + fit]:
                key = key << bits | words
            keys.append(key)
        order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
        ends, span = ends[order], span[order]
        n = len(ends)
        self.length, self.link, self.count, self.end = [np.zeros(0, np.int64)] * 4
        differs = np.zeros(n, bool)
        around = np.zeros(n, np.int64)  # the size of the group of one word less at each row, and the number of its state
        state = np.full(n, -1, np.int64)
        parts: list[tuple] = []
        made = 0
        for k in range(depth):
            words = back[k][order]
            differs[1:] |= words[1:] != words[:-1]
            differs[:1] = True
            long = span > k
            heads = np.flatnonzero(differs & long)  # rows of equal last words lie together, shorter runs first
            if not len(heads):
                break
            group = np.cumsum(differs) - 1
            sizes = np.bincount(group[long], minlength=group[-1] + 1)[group[heads]]
            same = (sizes == around[heads]) & (state[heads] >= 0)
            number = np.where(same, state[heads], made + np.cumsum(~same) - 1)
            new = heads[~same]
            parts.append((np.full(len(new), k + 1), state[new], sizes[~same], ends[new]))
            made += len(new)
            self._grow(parts)
            self.length[number[same]] = k + 1
            of = np.zeros(group[-1] + 1, np.int64)
            of[group[heads]] = number
            size = np.zeros(group[-1] + 1, np.int64)
            size[group[heads]] = sizes
            state = np.where(long, of[group], -1)
            around = np.where(long, size[group], 0)

    def _grow(self, parts: list[tuple]) -> None:
        new = parts.pop()
        self.length, self.link, self.count, self.end = [np.concatenate(x) for x in zip((self.length, self.link, self.count, self.end), new)]

    def phrases(self, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, a position where it ends and count of each phrase of low to high words: of each state those longer than its link's."""
        shorter = np.where(self.link >= 0, self.length[self.link], 0)
        for k in range(low, high + 1):
            held = (shorter < k) & (k <= self.length)
            yield k, self.end[held], self.count[held]


def words_of_bytes(text: str) -> Iterator[list[bytes]]:
    """The words of a text in order, a full stop for each end of a piece, in lists of some SLICE_BYTES."""
    data, at = text.encode().translate(MAPPED), 0
    while at < len(data):
        end = data.find(b" ", at + SLICE_BYTES)
        end = len(data) if end < 0 else end
        yield data[at:end].replace(b".", b" . ").split()
        at = end


class _Codes(dict):
    """Numbers of words by when they are first met, from 1; a full stop is 0."""

    def __init__(self) -> None:
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their bit in a filter."""
    at = hashes & ((1 << FILTER_BITS) - 1)
    return bits[at >> 3] >> (at & 7) & 1 == 1


def pair_hashes(known: list[bytes], lang: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair of words, given by their places in known, and of the language."""
    seed = xxhash.xxh32_intdigest(lang.encode())
    words = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in known), np.uint64, len(known))
    mixed = (words[first] ^ words[first] >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + words[second]
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed ^ mixed >> np.uint64(29)).view(np.int64)


class Shard:
    """Words of one language, coded as they come; a piece that two shards share leaves its last words to the next one as context."""

    def __init__(self, lang: str, low: int, high: int, words: np.ndarray | None, pairs: np.ndarray | None):
        self.lang, self.low, self.high, self.words, self.pairs = lang, low, high, words, pairs
        self.context: list[bytes] = []
        self.clear()

    def clear(self) -> None:
        self.codes = _Codes()
        self.parts = [np.fromiter(map(self.codes.__getitem__, self.context), np.int32, len(self.context))]
        self.size = 0

    def feed(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.codes.__getitem__, words), np.int32, len(words)))
        self.size += len(words)
        self.context = (self.context + words[1 - self.high :])[1 - self.high :] if self.high > 1 else []

    def counts(self) -> tuple[np.ndarray, list[bytes], SuffixAutomaton | None]:
        """The codes, the words that they stand for and the automaton; the shard is empty then."""
        codes, known, taken = np.concatenate(self.parts), list(self.codes), len(self.parts[0])
        self.clear()
        if len(codes) == taken:
            return codes, known, None
        follows = (codes[1:] > 0) & (codes[:-1] > 0)
        if self.words is not None:
            good = np.zeros(len(known), bool)
            good[1:] = passes(self.words, np.fromiter(map(zlib.crc32, known[1:]), np.int64, len(known) - 1))
            follows &= good[codes[1:]] & good[codes[:-1]]
        if self.pairs is not None:
            at = np.flatnonzero(follows)
            follows[at] = passes(self.pairs, pair_hashes(known, self.lang, codes[at], codes[at + 1]))
        place = np.arange(len(codes))
        begins = np.maximum.accumulate(np.where(np.concatenate([[True], ~follows]), place, 0))
        reach = np.where(codes > 0, place - begins + 1, 0)
        reach[:taken] = 0  # counted by the shard before
        reach[reach < self.low] = 0
        return codes, known, SuffixAutomaton(codes, reach, self.high)

    def phrases(self) -> Iterator[pa.RecordBatch]:
        codes, known, automaton = self.counts()
        for k, ends, counts in automaton.phrases(self.low, self.high) if automaton else ():
            for begin in range(0, len(ends), BATCH_PHRASES):
                some = ends[begin : begin + BATCH_PHRASES]
                columns = [map(known.__getitem__, codes[some - back].tolist()) for back in range(k - 1, -1, -1)]
                told = list(columns[0] if k == 1 else map(b" ".join, zip(*columns)))
                lang = pa.array([self.lang]).take(pa.array(np.zeros(len(told), np.int8)))
                yield pa.record_batch([lang, pa.array(told, pa.binary()).cast(pa.string()), pa.array(counts[begin : begin + BATCH_PHRASES], pa.int64())], ["lang", "phrase", "f"])

    def hashed_pairs(self) -> Iterator[pa.RecordBatch]:
        codes, known, automaton = self.counts()
        for _, ends, counts in automaton.phrases(2, 2) if automaton else ():
            yield pa.record_batch([pa.array(pair_hashes(known, self.lang, codes[ends - 1], codes[ends])), pa.array(counts, pa.int64())], ["h", "f"])


def shard_counts(docs: DataFrame, low: int, high: int, words: Broadcast | None = None, pairs: Broadcast | None = None, hashed: bool = False) -> DataFrame:
    """lang, phrase and f, its occurrences in a shard, for the phrases of low to high words (words and pairs: broadcast filters); hashed: h and
    f of the pairs alone."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [None if x is None else np.frombuffer(x.value, np.uint8) for x in (words, pairs)]
        shards: dict[str, Shard] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for shard in shards.values():
                yield from shard.hashed_pairs() if hashed else shard.phrases()

        held = 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                lang = lang.as_py()
                shard = shards.get(lang)
                if shard is None:
                    shard = shards[lang] = Shard(lang, low, high, *filters)
                for part in words_of_bytes(text.as_py()):
                    shard.feed(part)
                    held += len(part)
                    if held >= SHARD_WORDS:
                        yield from flush()
                        held = 0
                shard.feed([b"."])
        yield from flush()

    plain = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.mapInArrow(run, "h long, f long" if hashed else "lang string, phrase string, f long")


def counted(parts: DataFrame, least: int) -> DataFrame:
    """Counts added over all shards, of what occurs often enough."""
    return parts.groupBy(*[c for c in parts.columns if c != "f"]).agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def filter_of(hashes: DataFrame) -> Broadcast:
    """A broadcast filter of hashes (h): the bit of each, cut to FILTER_BITS, is set, so its size is bounded."""
    at = hashes.select(F.col("h").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).alias("_at"))
    rows = at.select(F.shiftright("_at", 6).cast("int").alias("at"), F.expr("shiftleft(1L, cast(_at & 63 as int))").alias("bit"))
    set_ = rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << FILTER_BITS - 6, np.int64)
    bits[set_["at"].to_numpy()] = set_["bits"].to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(bits.tobytes())


def n_words(phrase: Column) -> Column:
    return F.size(F.split(phrase, " "))


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Two kept tables: lang, phrase, f and k (its words) of the phrases of up to longest words that occur least times, and lang and n,
    all word occurrences."""
    words = keep(shard_counts(docs, 1, 1).groupBy("lang", "phrase").agg(F.sum("f").alias("f")), "words")
    totals = keep(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    single = words.where(F.col("f") >= least)
    first = filter_of(single.select(F.crc32(F.col("phrase").cast("binary")).alias("h")))
    pairs = filter_of(counted(shard_counts(docs, 2, 2, first, hashed=True), least))
    every = single.unionByName(counted(shard_counts(docs, 2, longest, first, pairs), least))
    every = keep(every.withColumn("k", n_words(F.col("phrase"))), "phrases")
    forget(words)
    return every, totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, first: int = FIRST) -> DataFrame:
    """The first phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    docs: text and lang; null texts count as empty, a null lang is und. A-Z is lower-cased; `.,;:!?` and line ends cut a text into
    pieces, blanks and tabs those into words. A candidate is a phrase of 2 to longest words that occurs a >= least times. A cut after
    its first words gives l and r, the occurrences of both parts, and floor(1000 * a * n / (l * r)), in whole numbers; the cut of the
    lowest score counts, the shortest first part of equals. A candidate that occurs no more often than a longer one that holds it is
    dropped. Equal scores are ranked by a, then by phrase. Repeated rows count as often as they come; other columns, whatever their
    names, do not matter; an empty table gives no rows.
    """
    every, totals = frequent_phrases(docs, least, longest)
    part, k = F.col("phrase"), F.col("k")
    cut_by = lambda n: F.expr(f"substring_index(phrase, ' ', {n})")
    # a longer phrase as frequent as one inside it: then so are those between, and the links to one word less on either side find it
    longer = every.where("k > 2").select("lang", "f", F.explode(F.array(cut_by("1 - k"), cut_by("k - 1"))).alias("phrase"))
    above = longer.groupBy("lang", "phrase").agg(F.max("f").alias("top"))
    left = every.where("k > 1").join(above, ["lang", "phrase"], "left").where("top is null or top < f").select("lang", part, F.col("f").alias("a"), k)
    cuts = left.select("lang", part, "a", k, F.explode(F.sequence(F.lit(1), k - 1)).alias("cut")).withColumns({"_l": cut_by("cut"), "_r": cut_by("cut - k")})
    parts = beside(every.select("lang", "phrase", "f"))
    side = lambda name: parts.select("lang", F.col("phrase").alias(f"_{name}"), F.col("f").alias(name))
    whole = cuts.join(side("l"), ["lang", "_l"]).join(side("r"), ["lang", "_r"]).join(beside(totals), "lang")
    big = lambda c: F.col(c).cast("decimal(38,0)")
    scored = whole.withColumns({"_up": F.lit(1000).cast("decimal(38,0)") * big("a") * big("n"), "_down": big("l") * big("r")}).withColumn("score", F.expr("_up div _down"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("_x"))
    found = lowest.select("lang", "phrase", "a", F.col("_x.l").alias("l"), F.col("_x.r").alias("r"), "n", F.col("_x.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))  # a language may hold most phrases
    some = found.withColumn("_salt", salt).withColumn("_nth", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_nth") <= first)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) t(k))),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
inner_ AS (SELECT lang, array_to_string(string_split(phrase, ' ')[s:s + k - 2], ' ') AS phrase, f FROM f, range(1, 3) t(s) WHERE k > 2),
c AS (SELECT * FROM f WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = f.lang AND i.phrase = f.phrase AND i.f >= f.f)),
cut AS (SELECT lang, phrase, f AS a, k, unnest(range(1, k)) AS j FROM c),
s AS (SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, n.n, CAST(1000 AS HUGEINT) * c.a * n.n // (CAST(x.f AS HUGEINT) * y.f) AS score, j FROM cut c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(string_split(c.phrase, ' ')[1:j], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(string_split(c.phrase, ' ')[j + 1:c.k], ' ') JOIN n ON n.lang = c.lang),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) <= 2000
"""
