"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, keep, table

#: Weights of the sources by code point order, repeating; a target stops at so many times its source's size.
WEIGHTS, MOST_REPEATS = (5, 2, 1), 3
#: Documents of a cell within which places are counted by a window.
CELL_ROWS = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row a source.

    The sizes' total is shared by weight. A source whose share exceeds most times its size stops there, and the
    excess is shared again by weight among the rest until none exceeds: with the sources in order of limit over weight,
    those before the first that its share fits are stopped. A source without words has the target 0.
    """
    order = "source is null, source"
    ranked = sizes.withColumn("w", F.expr(f"element_at(array({', '.join(map(str, weights))}), cast((row_number() over (order by {order}) - 1) % {len(weights)} as int) + 1)"))
    run = ranked.withColumn("most", F.col("source_size") * most).withColumn("total", F.expr("sum(source_size) over ()"))
    by_ratio = f"order by most / w, {order}"
    run = run.withColumn("stopped", F.expr(f"coalesce(sum(most) over ({by_ratio} rows between unbounded preceding and 1 preceding), 0)"))
    run = run.withColumn("rest_w", F.expr(f"sum(w) over ({by_ratio} rows between current row and unbounded following)"))
    run = run.withColumn("fits", F.expr("(total - stopped) * w <= most * rest_w"))
    run = run.withColumn("level", F.expr("max(case when fits then struct(-stopped as s, rest_w as r) end) over ()"))
    share = F.col("w") * (F.col("total") + F.col("level.s")) / F.col("level.r")
    stops = F.col("level").isNull() | (F.col("stopped") < -F.col("level.s"))
    return run.select("source", "source_size", F.when(stops, F.col("most").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for each row of docs (doc_id, text, source).

    Each document of a source is expected target / source_size times. In the order of size, then MD5 of doc_id, the
    expected copies are summed; with an offset drawn from the source's name, a document is taken once for each whole number
    that its stretch of the sums crosses: as often as expected, rounded up or down. As neighbours in that order are of
    like size, a source's words come near its target.

    Places in a source are counted in two steps, so no task holds a whole source: a window over the sums of cells (a
    source's documents of one size, dealt by MD5 into cells of about cell_rows), then one within each cell.

    Null and empty texts have size 0. A null source is a source of its own, last in order. Rows with equal doc_id
    and size are interchangeable; a null doc_id sorts first. An empty table gives no rows. Other columns are not carried.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    sized = keep(docs.select("doc_id", "source", size.alias("size")), "sizes")
    by_size = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    targets = source_targets(by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most)
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    head = lambda c: F.conv(F.substring(c, 1, 8), 16, 10).cast("long")
    cells = F.ceil(F.col("n") / cell_rows).cast("long")
    at = sized.withColumn("md", digest).join(by_size.withColumnsRenamed({"source": "s_", "size": "z_"}), F.expr("source <=> s_ and size = z_"))
    at = at.withColumn("cell", F.floor(head("md") * cells / F.lit(2**32)))
    before = at.groupBy("source", "size", "cell").agg(F.count("*").alias("c"))
    before = before.withColumn("before", F.expr("coalesce(sum(c) over (partition by source order by size, cell rows between unbounded preceding and 1 preceding), 0)"))
    placed = at.withColumn("within", F.expr("row_number() over (partition by source, size, cell order by md, doc_id)"))
    b = before.select(F.col("source").alias("bs"), F.col("size").alias("bz"), F.col("cell").alias("bc"), "before")
    ranked = placed.join(b, F.expr("source <=> bs and size = bz and cell = bc")).select("doc_id", "source", "size", (F.col("before") + F.col("within")).alias("place"))
    t = targets.withColumnRenamed("source", "ts")
    rated = ranked.join(t, F.expr("source <=> ts")).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    offset = head(F.md5(F.coalesce("source", F.lit("")).cast("binary"))) / F.lit(float(2**32))
    copies = F.floor(F.col("place") * F.col("rate") + offset) - F.floor((F.col("place") - 1) * F.col("rate") + offset)
    return rated.select("doc_id", "source", "size", "source_size", "target", F.least(copies, F.lit(most)).alias("copies"))


def take_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, each as many times as mix takes it. Rows of equal doc_id, source and size get one of
    the numbers of copies that these rows have in the mix each."""
    counts = mix(docs, **options)
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    # docs may have columns of any name, so they travel as one struct
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    counts = counts.select(F.col("doc_id").alias("id"), F.col("source").alias("src"), F.col("size").alias("words"), "copies")
    n, distinct = counts.groupBy("id").count().agg(F.sum("count"), F.count("*")).first()
    if n is None or n == distinct:
        joined = own.join(counts.select("id", "copies"), F.expr("row.doc_id <=> id"))
    else:
        counts = counts.withColumn("nth", F.expr("row_number() over (partition by id, src, words order by copies)"))
        own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), size.alias("z"))
        own = own.withColumn("n", F.expr("row_number() over (partition by row.doc_id, row.source, z order by row.doc_id)"))
        joined = own.join(counts, F.expr("row.doc_id <=> id and row.source <=> src and z = words and n = nth"))
    taken = joined.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long"))))
    return taken.select("row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: The same by one window over each source.
SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS most,
         sum(source_size) OVER () AS total FROM s
), x AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY most / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
         sum(w) OVER (ORDER BY most / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w
), l AS (
  SELECT min(stopped) AS stopped, max(rest) AS rest FROM x WHERE (total - stopped) * w <= most * rest
), t AS (
  SELECT x.source, source_size, CASE WHEN l.stopped IS NULL OR x.stopped < l.stopped THEN CAST(most AS DOUBLE)
         ELSE CAST(w * (total - l.stopped) AS DOUBLE) / CAST(l.rest AS DOUBLE) END AS target FROM x, l
), r AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, md5(CAST(d.doc_id AS VARCHAR)), d.doc_id) AS place,
         CAST(CAST('0x' || substr(md5(coalesce(d.source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS shift
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, size, source_size, target,
       CAST(size * least(floor(place * rate + shift) - floor((place - 1) * rate + shift), 3) AS BIGINT) AS taken FROM r
"""
