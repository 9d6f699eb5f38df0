"""SimHash near-duplicates through tables of distances to reference fingerprints (pivots).

A fingerprint's distances to many reference fingerprints are taken once, block by block: the Hamming distances to
reference j within each of BLOCKS groups of bits. Two fingerprints that differ in at most `radius` bits differ in
no bit at all in at least BLOCKS - radius of those groups, so there their coordinates differ by zero, for every
reference. Candidates are therefore the pairs with equal coordinates in some BLOCKS - radius blocks (an equi-join key for
each choice of blocks). Of those, pairs whose largest difference over the whole-fingerprint coordinates (the sums
over the blocks) exceeds the radius are discarded by the triangle inequality, and survivors are verified bit by bit.
No link is lost: both rules follow from the metric.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, beside, forget, keep, let_go, sliced, table, tidy, words_of
from .components import connected_components

#: Bits are cut into so many blocks, of 10 or 11 bits.
BLOCKS = 6
#: The reference fingerprints.
PIVOTS = np.array([xxhash.xxh64_intdigest(f"pivot {j}", 7) for j in range(16)], dtype=np.uint64)
#: A bucket above this many rows is cut into strips, and each pair of strips is a unit of its own.
UNIT_ROWS = 2048
#: In a group of up to this many rows each link is told; in a larger one the links of a shortest spanning forest.
SMALL_GROUP = 6
#: Shingles counted at once.
CHUNK = 1 << 15

_EDGES = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
_MASKS = np.array([((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(_EDGES, _EDGES[1:])], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bit i is 1 if over half of the hashes have it; 0 for none."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of k words, joined by spaces; fewer words are one shingle, none give none."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    runs = zip(*(words[i:] for i in range(k))) if len(words) >= k else [words]
    return np.fromiter((digest(join(x), 42) for x in runs), dtype=np.uint64)


def text_fingerprint(text: str | None, k: int = 3) -> int:
    return majority(shingle_hashes(words_of(text), k))


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, fp (long: the 64 bits) for each row."""

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for x in batches:
            yield pd.DataFrame({"doc_id": x["doc_id"], "fp": _signed([text_fingerprint(t, k) for t in x["text"]])})

    return batched(docs.select("doc_id", "text")).mapInPandas(run, "doc_id long, fp long")


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    """Another hash of each hash (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """Distances of each fingerprint to each pivot within each block: (rows, blocks, pivots)."""
    return np.bitwise_count((fp[:, None, None] ^ PIVOTS[None, None, :]) & _MASKS[None, :, None])


def pivot_keys(fp: np.ndarray, radius: int) -> np.ndarray:
    """(rows, choices): a key for each choice of BLOCKS - radius blocks, equal where the coordinates of those blocks are."""
    if not 0 <= radius < BLOCKS:
        raise ValueError(f"the radius must be below {BLOCKS}")
    weights = (np.uint64(1) << np.arange(0, 64, 4, dtype=np.uint64))[: len(PIVOTS)]
    with np.errstate(over="ignore"):
        packed = (pivot_table(fp).astype(np.uint64) * weights).sum(2, dtype=np.uint64)  # a block's row of the table: 16 x 4 bits
        keys = []
        for n, chosen in enumerate(combinations(range(BLOCKS), BLOCKS - radius)):
            key = np.full(len(fp), n, dtype=np.uint64)
            for b in chosen:
                key = _mix(key ^ packed[:, b], n)
            keys.append(key)
    return np.stack(keys, axis=1)


def _keyed(nodes: DataFrame, radius: int) -> DataFrame:
    """(key, id) for each node (id, fps: array of fingerprints) and each fingerprint's choices of blocks."""

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for x in batches:
            for i in range(0, len(x), 4096):
                part = x.iloc[i : i + 4096]
                fps = np.array(part["fps"].tolist(), dtype=np.int64).reshape(len(part), -1).view(np.uint64)
                ids = part["id"].to_numpy()
                for t in range(fps.shape[1]):
                    keys = _mix(pivot_keys(fps[:, t].copy(), radius), 100 + t)
                    yield pd.DataFrame({"key": keys.view(np.int64).ravel(), "id": np.repeat(ids, keys.shape[1])})

    return nodes.select("id", "fps").mapInPandas(run, "key long, id long")


def _forest(fps: np.ndarray, far: int) -> list[tuple[int, int]]:
    """Links of a shortest spanning forest over rows of fingerprints, of those no longer than far (Prim)."""
    table_ = np.bitwise_count(fps[:, :, None] ^ PIVOTS).sum(1, dtype=np.int16)  # coordinates over all the bits
    n, out = len(fps), []
    near, via = np.full(n, 9999, dtype=np.int64), np.full(n, -1)
    todo = np.arange(n)
    at = 0
    while len(todo) > 1:
        todo = todo[todo != at]
        may = todo[np.abs(table_[todo] - table_[at]).max(1) <= far]
        d = np.bitwise_count(fps[may] ^ fps[at]).sum(1, dtype=np.int64)
        better = (d <= far) & (d < near[may])
        near[may[better]], via[may[better]] = d[better], at
        at = todo[np.argmin(near[todo])]
        if near[at] <= far:
            out.append((int(via[at]), int(at)))
    return out


def _links(ids: np.ndarray, key: np.ndarray, fps: np.ndarray, far: int) -> tuple[list, list]:
    """Links within the groups of equal key (rows are sorted by it)."""
    starts = np.flatnonzero(np.r_[True, np.any(key[1:] != key[:-1], axis=1)])
    sizes = np.diff(np.r_[starts, len(key)])
    a_out, b_out = [], []
    small = np.repeat(sizes <= SMALL_GROUP, sizes)
    group = np.repeat(np.arange(len(starts)), sizes)
    coords = np.bitwise_count(fps[:, :, None] ^ PIVOTS).sum(1, dtype=np.int16)
    for step in range(1, SMALL_GROUP):
        a = np.flatnonzero(small[:-step] & (group[:-step] == group[step:]))
        b = a + step
        may = np.abs(coords[a] - coords[b]).max(1, initial=0) <= far
        a, b = a[may], b[may]
        true = np.bitwise_count(fps[a] ^ fps[b]).sum(1) <= far
        a_out.append(ids[a[true]])
        b_out.append(ids[b[true]])
    for g in np.flatnonzero(sizes > SMALL_GROUP):
        at = slice(starts[g], starts[g] + sizes[g])
        if pairs := _forest(fps[at], far):
            own = ids[at]
            a_out.append(own[[p[0] for p in pairs]])
            b_out.append(own[[p[1] for p in pairs]])
    return a_out, b_out


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pd.DataFrame:
    a, b = np.concatenate(a), np.concatenate(b)
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def _in_units(rows: DataFrame, count: str) -> DataFrame:
    """Rows with key, id and the count of their key, each once for every unit that it belongs to: a pair of strips of its key."""
    strips = F.ceil(F.col(count) / UNIT_ROWS).cast("long")
    shared = rows.withColumn("s", strips).withColumn("i", F.pmod(F.xxhash64("id"), "s"))
    return shared.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1))).withColumn("unit", F.least("i", "j") * F.col("s") + F.greatest("i", "j"))


def _by_unit(told: Callable[[pd.DataFrame], Iterator[pd.DataFrame]]) -> Callable:
    """For mapInPandas: told of whole groups of equal key and unit, of rows sorted by them."""

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        held = None
        for x in batches:
            x = x if held is None else pd.concat([held, x], ignore_index=True)
            key = x[["key", "unit"]].to_numpy()
            last = np.flatnonzero(np.any(key != key[-1], axis=1))
            cut = last[-1] + 1 if len(last) else 0  # the last group may go on in the next batch
            held = x.iloc[cut:]
            yield from told(x.iloc[:cut])
        if held is not None:
            yield from told(held)

    return run


def link_fingerprints(nodes: DataFrame, radius: int, far: int | None = None) -> DataFrame:
    """Distinct links (a, b) that join the same nodes as all links do: pairs of nodes (id long, unique; fps array<long>)
    of which some fingerprint is within radius, and all their fingerprints together within far (radius if None) bits.

    Of a large group only the links of a shortest spanning forest are told, so their number follows the number of
    nodes, not its square. A bucket above UNIT_ROWS rows is cut into strips, and each pair of strips is compared
    by a unit of at most two strips, wherever it runs.
    """
    far = radius if far is None else far
    keyed = _keyed(nodes, radius)
    counted = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    units = _in_units(keyed.join(counted, "key"), "n").select("key", "unit", "id")
    placed = units.join(nodes.select("id", "fps"), "id").repartition("key", "unit").sortWithinPartitions("key", "unit", "id")

    def told(x: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if len(x) > 1:
            fps = np.array(x["fps"].tolist(), dtype=np.int64).reshape(len(x), -1).view(np.uint64)
            a, b = _links(x["id"].to_numpy(), x[["key", "unit"]].to_numpy(), fps, far)
            yield _pairs(a, b)

    return placed.mapInPandas(_by_unit(told), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp, component_id for each row of docs (doc_id, text): the smallest doc_id that links of at most radius
    differing bits lead to.

    Rows of equal fingerprint are one node, so copies cost no pairs. Null and empty texts have no shingle and the
    fingerprint 0, and link like any other. Repeated rows stay, each with its component; a row whose doc_id is null
    takes its component from the rest, and is null if all of the component are. No rows give no rows.
    """
    own = keep(fingerprints(docs, k), "fingerprints")
    nodes = keep(own.groupBy("fp").agg(F.min("doc_id").alias("id")), "nodes")
    links = link_fingerprints(nodes.where("id is not null").select("id", F.array("fp").alias("fps")), radius)
    found = connected_components(links)
    classes = nodes.join(found, nodes["id"] == found["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return own.join(classes, "fp").select("doc_id", "fp", "component_id")


#: Of the stage: words of a shingle and the least resemblance.
SHINGLE, RESEMBLANCE = 5, 0.8
#: Shingles that are told to be common: one row in so many is looked at, and so many shingles are remembered at most.
COMMON_SAMPLE, COMMON_LEAST, COMMON_MOST = 16, 8, 20_000
#: 0: every text has its whole prefix as keys, by which every two texts of RESEMBLANCE share one. Above 0, texts most of whose shingles (a share of OWN) are
#: not common have so many keys at most, and pairs may be missed.
KEYS: int | None = 0
OWN = 0.6
#: Pairs that a task holds before it hands them on.
PAIRS_HELD = 1 << 18
#: Rounds of prefix_pairs: how far apart in a key's order of size the ends of a pair may be; None: anywhere.
ROUNDS = (8, 64, None)


def _word_fingerprint(words: list[bytes], seen: dict) -> int:
    """A fingerprint of the set of words: a small edit changes few of them."""
    digest = xxhash.xxh64_intdigest
    own = []
    for w in set(words):
        if (h := seen.get(w)) is None:
            if len(seen) > 100_000:
                seen.clear()
            h = seen[w] = digest(w, 42)
        own.append(h)
    return majority(np.array(own, dtype=np.uint64))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """Rows of docs, one of each group of copies: the one with the smallest doc_id.

    A group is a component of links: pairs of texts whose sets of five-word shingles have a resemblance of RESEMBLANCE
    or more; each is found. Texts of equal SHA-256 are one node (its smallest doc_id). The links come in
    rounds, each verified on the sets. The first takes pairs whose SimHash fingerprints of the word sets lie within 3
    bits, through pivot tables, a forest of each bucket; the next take neighbours of equal prefix keys. They join large
    groups cheaply. The last tries every other pair that can reach RESEMBLANCE and whose ends are still in different
    components (prefix_pairs). Sets are made only of the texts of a round's pairs.

    Null and empty texts are copies of each other (null as empty). A row with a null doc_id stays. Rows that repeat
    a doc_id stay or go together. All columns are carried. An empty table gives no rows.
    """
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    hashed = keep(_hashed(texts, _common(texts)).withColumn("row", F.monotonically_increasing_id()), "hashed")
    owner = keep(hashed.groupBy("sha").agg(F.min(F.struct("doc_id", "row")).alias("x")).select("sha", F.col("x.doc_id").alias("id"), "x.row"), "owners")
    nodes = keep(hashed.drop("sha").join(owner.select("row", "id"), "row").select("id", "fp", "n", "keys"), "nodes")
    tried = keep(link_fingerprints(nodes.select("id", F.array("fp").alias("fps")), 3), "pairs")
    links = verified(texts, tried)
    every = nodes.select("id", "n", F.posexplode("keys").alias("place", "key"))
    shared = every.groupBy("key").count().where("count > 1").select("key")
    keyed = keep(every.join(shared, "key"), "keys")
    found = connected_components(links)
    for steps in ROUNDS:
        more = keep(prefix_pairs(keyed, found, steps).join(tried, ["a", "b"], "left_anti"), "pairs")
        if more.isEmpty():
            forget(more)
            continue
        new = verified(texts, more)
        both, past = keep(links.union(new), "links"), keep(tried.union(more), "pairs")
        forget(links, new, tried, more, found)
        links, tried, found = both, past, connected_components(both)
    names = owner.join(found, owner["id"] == found["node"], "left").select("sha", F.coalesce("component", "id").alias("_kept"))
    gone = keep(hashed.select("doc_id", "sha").join(names, "sha").where("doc_id <> _kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    forget(hashed, owner, nodes, tried, links, keyed, found)
    return docs.join(beside(gone), docs["doc_id"] == gone["_gone"], "left_anti")


def _set_of(words: list[bytes]) -> np.ndarray:
    """The sorted hashes of a text's set of shingles."""
    return np.unique(shingle_hashes(words, SHINGLE)).view(np.int64)


def _common(texts: DataFrame) -> np.ndarray:
    """(hash, count) of the most common shingles, in order of hash, as a sample of the rows shows them; COMMON_MOST at most."""

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for x in sliced(batches):
            yield pd.DataFrame({"sh": np.concatenate([_set_of(words_of(t)) for t in x["text"]])})

    some = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(COMMON_SAMPLE)) == 0).select("text")
    counts = batched(some).mapInPandas(run, "sh long").groupBy("sh").count().where(F.col("count") >= COMMON_LEAST)
    top = counts.orderBy(F.desc("count"), "sh").limit(COMMON_MOST).collect()
    return np.array(sorted((r["sh"], r["count"]) for r in top), dtype=np.int64).reshape(-1, 2)


def _hashed(texts: DataFrame, common: np.ndarray) -> DataFrame:
    """doc_id, sha (of the text), fp (of its word set), n (shingles) and keys (_keys) for each row of texts (doc_id, text)."""

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        seen: dict[bytes, int] = {}
        for x in sliced(batches):
            rows = []
            for doc_id, text in zip(x["doc_id"], x["text"]):
                words = words_of(text)
                sh = _set_of(words)
                rows.append((doc_id, hashlib.sha256((text or "").encode()).digest(), _signed([_word_fingerprint(words, seen)])[0], len(sh), _keys(sh, common)))
            yield pd.DataFrame(rows, columns=["doc_id", "sha", "fp", "n", "keys"])

    return batched(texts).mapInPandas(run, "doc_id long, sha binary, fp long, n int, keys array<long>")


def _keys(sh: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order of (how common, hash): its prefix, or KEYS of it where that is set.

    Two sets of RESEMBLANCE share one of the prefix, one shingle more than such a set may lack, whatever the order, as long as
    it is one for all. With KEYS, where a share of OWN or more of the shingles is not common, at most 0.25 / OWN of
    the two sets' shingles that aren't common is in one of them only, and as these are in the order of their hashes,
    the chance that none of the first KEYS is in both is below (0.25 / OWN) ** KEYS for hashes drawn at random; sets made to that end miss each other.
    """
    if not len(sh):
        return np.zeros(1, dtype=np.int64)  # all empty sets are equal
    rank = np.zeros(len(sh), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common[:, 0], sh), len(common) - 1)
        rank = np.where(common[at, 0] == sh, common[at, 1], 0)
    most = len(sh) - int(np.ceil(RESEMBLANCE * len(sh) - 1e-9)) + 1
    if KEYS and (rank == 0).mean() >= OWN:
        most = min(most, KEYS)
    return sh[np.lexsort((sh, rank))[:most]]


def _reachable(key: np.ndarray, component: np.ndarray, n: np.ndarray, place: np.ndarray, steps: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows a, b of equal key (rows are sorted by it) and different components whose sets may reach RESEMBLANCE if
    this key is the first that they share: then at most what follows it in the shorter rest is shared too. With steps,
    only rows so near to each other."""
    starts = np.flatnonzero(np.r_[True, np.any(key[1:] != key[:-1], axis=1)])
    sizes = np.diff(np.r_[starts, len(key)])
    last = np.repeat(starts + sizes, sizes)
    left, step = np.arange(len(key)), 1
    while (steps is None or step <= steps) and len(left := left[left + step < last[left]]):
        a, b = left, left + step
        most = np.minimum(n[a] - place[a], n[b] - place[b])
        may = (component[a] != component[b]) & (most + 1e-6 >= RESEMBLANCE * (n[a] + n[b] - most))
        yield a[may], b[may]
        step += 1


def prefix_pairs(keyed: DataFrame, found: DataFrame, steps: int | None = None) -> DataFrame:
    """Distinct pairs (a, b) of ids in different components that may have a resemblance of RESEMBLANCE: of keyed (key, id, n, place: see
    _keys) and the components found so far (node, component; other ids are alone). No pair that has it is left out, unless steps
    limits how far apart its rows may lie in the order of size within a key, so that pairs don't outnumber the rows.

    Keys within one component are done; a key of more than UNIT_ROWS rows is cut into strips.
    """
    labelled = keyed.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    counted = labelled.groupBy("key").agg(F.count("*").alias("rows"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key", "rows")
    placed = _in_units(labelled.join(counted, "key"), "rows").select("key", "unit", "id", "n", "place", "component")
    placed = placed.repartition("key", "unit").sortWithinPartitions("key", "unit", "n", "id")

    def told(x: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ids, a_out, b_out, held = x["id"].to_numpy(), [], [], 0
        for a, b in _reachable(x[["key", "unit"]].to_numpy(), x["component"].to_numpy(), x["n"].to_numpy(), x["place"].to_numpy(), steps):
            a_out.append(ids[a])
            b_out.append(ids[b])
            held += len(a)
            if held > PAIRS_HELD:
                yield _pairs(a_out, b_out)
                a_out, b_out, held = [], [], 0
        if held:
            yield _pairs(a_out, b_out)

    return placed.mapInPandas(_by_unit(told), "a long, b long").distinct()


def _sets(texts: DataFrame) -> DataFrame:
    """id, n, sh and low for each row of texts (doc_id, text): the hashes of its set of shingles, their number, and their distinct lowest 16 bits."""

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for x in sliced(batches):
            sh = [_set_of(words_of(t)) for t in x["text"]]
            yield pd.DataFrame({"id": x["doc_id"].to_numpy(), "n": [len(s) for s in sh], "sh": sh, "low": [np.unique(s.astype(np.int16)) for s in sh]})

    return batched(texts.select("doc_id", "text")).mapInPandas(run, "id long, n int, sh array<long>, low array<short>")


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of kept pairs (a, b: doc_ids) those whose texts (doc_id, text) have sets of a resemblance of RESEMBLANCE or more; both empty counts as equal.

    Sets are made of the texts in pairs alone. Their low bits, a quarter of the bytes, go first: as many hashes are shared as lowest
    bits at most, and as a set has more of the one than of the other. What they leave is decided on the sets."""
    ends = keep(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ends")
    sets = keep(_sets(texts.join(beside(ends), "doc_id", "left_semi")), "sets")

    def with_both(pairs: DataFrame, column: str) -> DataFrame:
        sides = (sets.select(F.col("id").alias(end), F.col("n").alias(f"n{end}"), F.col(column).alias(f"s{end}")) for end in "ab")
        return pairs.join(next(sides), "a").join(next(sides), "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))

    def enough(common: Column) -> Column:
        return common >= F.lit(RESEMBLANCE) * (F.col("na") + F.col("nb") - common)

    most = F.col("common") + F.least(F.col("na") - F.size("sa"), F.col("nb") - F.size("sb"))
    near = keep(with_both(pairs, "low").where(enough(most)).select("a", "b").distinct(), "pairs")
    links = keep(with_both(near, "sh").where(enough(F.col("common"))).select("a", "b").distinct(), "links")
    forget(ends, sets, near)
    return links


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
