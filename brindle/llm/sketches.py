"""Bottom-k sketches of shingle hashes, as DataFrame expressions.

A sketch is an ascending array<bigint> of the k smallest distinct shingle hashes. Sketches of parts merge into the
sketch of the whole (given the shingles across the seams, see `seam`), and two sketches estimate resemblance,
containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, table

#: Sketch size and words in a shingle.
K, SHINGLE = 128, 5


def let(value: Column, use) -> Column:
    """use(value), with value computed once: a lambda's body would compute it again for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_hashes(text: Column) -> Column:
    """array<bigint>: the hash of each word; null and empty texts have none."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(words: Column, shingle: int = SHINGLE) -> Column:
    """The hash of each run of so many word hashes; a shorter text is one shingle, an empty one has none."""


    def runs(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (shingle - 1), F.lit(1)))
        return F.when(F.size(w) > 0, F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + (j - 1)) for j in range(shingle)])))

    return F.coalesce(let(words, runs), F.array().cast("array<bigint>"))


def bottom_k(hashes: Column, k: int = K) -> Column:
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    return bottom_k(shingle_hashes(word_hashes(text), shingle), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of the sets that a and b were drawn from."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of |A and B| / |A or B|: the share of the merged sketch that both have. Two empty sets are alike (1)."""


    def share(both: Column) -> Column:
        common = F.size(F.array_intersect(F.array_intersect(both, a), b))
        return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common / F.size(both))

    return let(merge(a, b, k), share)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles: exact below k, else (k - 1) over the k-th hash's place in the hash range."""
    place = (F.element_at(a, -1).cast("double") + F.lit(float(2**63))) / F.lit(float(2**64))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of |A and B| / |A|, at most 1; an empty A is contained in anything."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def seam(left: Column, right: Column, shingle: int = SHINGLE) -> Column:
    """Hashes of the shingles that cross from one part's word hashes into the next part's, of parts of shingle words or more."""
    n = F.lit(shingle - 1)
    edge = F.concat(F.slice(left, -n, n), F.slice(right, F.lit(1), n))
    return shingle_hashes(edge, shingle)


def as_text(a: Column) -> Column:
    """The sketch as a string: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def next_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id) for each distinct doc_id that isn't null: in descending order, the last one's next is the first.

    doc_ids are dealt to ranges and ordered within each; a table of one row a range bridges them; its size is the number of shuffle partitions, whatever the data.
    """
    ids = docs.select("doc_id").where("doc_id is not null").distinct()
    dealt = keep(ids.repartitionByRange(F.desc("doc_id")).withColumn("part", F.spark_partition_id()), "ranges")
    edges = dealt.groupBy("part").agg(F.max("doc_id").alias("first"))  # a row a partition
    bridges = F.broadcast(edges.selectExpr("part", "lead(first) over (order by first desc) as after", "max(first) over () as top"))
    own = dealt.withColumn("n", F.expr("lead(doc_id) over (partition by part order by doc_id desc)"))
    return own.join(bridges, "part").select("doc_id", F.coalesce("n", "after", "top").alias("next_id"))


def fingerprint_edits(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Sketches of each text, of an edited form of it and of the next document's text, and their resemblances.

    docs has doc_id and text; the edited text has the last third replaced by the head of the next document's (see
    next_documents). Null texts count as empty. A single document is its own next. Where doc_ids repeat, each row
    is kept, and the next text is that of the smallest text with the next doc_id; rows with a null doc_id have an
    empty next text. Other columns are not carried. An empty table gives no rows.
    """
    every = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = every.where("doc_id is not null")
    nexts = next_documents(docs)
    need = own.groupBy("doc_id").agg(F.max(F.floor(F.length("text") / 3)).alias("need")).join(nexts, "doc_id").select(F.col("next_id").alias("from_id"), F.col("doc_id").alias("for_id"), "need")
    lent = own.join(need, own["doc_id"] == need["from_id"]).select("for_id", F.expr("substring(text, 1, cast(need as int))").alias("lent"), sketch(F.col("text"), k, shingle).alias("next_sketch"))
    lent = lent.groupBy("for_id").agg(F.min(F.struct("lent", "next_sketch")).alias("x")).select("for_id", "x.lent", "x.next_sketch") if _repeats(docs) else lent
    # both joins deal the texts by doc_id with the same filter, so that Spark shuffles them once
    both = own.join(lent, own["doc_id"] == lent["for_id"])
    both = both.drop("for_id").unionByName(every.where("doc_id is null").withColumn("lent", F.lit("")).withColumn("next_sketch", F.array().cast("array<bigint>")))
    cut = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.substring(F.coalesce("lent", F.lit("")), F.lit(1), cut))
    rows = both.select("doc_id", F.length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"), F.coalesce("next_sketch", F.array().cast("array<bigint>")).alias("next_sketch"))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("text"), k, shingle).alias("sketch"), sketch(F.col("edited"), k, shingle).alias("edited_sketch"), "next_sketch")


def _repeats(docs: DataFrame) -> bool:
    """Whether a doc_id stands in several rows."""
    n, distinct = docs.where("doc_id is not null").groupBy("doc_id").count().agg(F.sum("count"), F.count("*")).first()
    return (n or 0) != distinct


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fingerprint_edits(table(spark, sf_dir, "documents"))
    near = [resemblance(F.col("sketch"), F.col(c)).alias(name) for c, name in (("edited_sketch", "near_edited"), ("next_sketch", "near_next"))]
    more = [distinct_shingles(F.col("sketch")).alias("distinct_shingles"), containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_contained")]
    return x.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"), *near, *more)
