"""Queries over names, pairs, sets and splits; the cohort is made from orders (a volume each) of customers (subjects)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import folds, intervals, pairing, sampling
from .catalogue import query, table

BASE = """c AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS session,
 (year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1 AS age, lower(o_orderstatus) AS weighting FROM orders),
cohort AS (SELECT *, CAST(o_custkey AS VARCHAR) || '_' || CAST(session AS VARCHAR) || '_' || CAST(age AS VARCHAR) || '_' || weighting AS stem FROM c)"""
WITH = "WITH " + BASE + " "


def cohort(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf, "orders").withColumn("session", F.row_number().over(w).cast("long")).withColumn("age", (F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate") - 1).withColumn("weighting", F.lower("o_orderstatus"))
    return o.select("o_orderkey", "o_custkey", "o_totalprice", "session", "age", "weighting", F.concat_ws("_", "o_custkey", "session", "age", "weighting").alias("stem"))


@query("strip_ext", "SELECT page_id, regexp_replace(regexp_extract(url || '.nii.gz', '[^/]*$'), '(?i)\\.(nii\\.gz|nii|mgz|mha|mhd|nrrd)$', '') AS stem FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", N.strip_ext(F.concat("url", F.lit(".nii.gz"))).alias("stem"))


@query("parse_stem", WITH + "SELECT o_orderkey, split_part(stem,'_',1) AS id, split_part(stem,'_',2) AS session, split_part(stem,'_',3) AS age, split_part(stem,'_',4) AS weighting, 4 AS n_tokens, true AS ok FROM cohort")
def _(spark, sf):
    return cohort(spark, sf).select("o_orderkey", *N.parsed(F.col("stem")))


def _odd_names(spark, sf):
    """Names with faults: parts dropped, added or emptied."""
    k = F.pmod("o_orderkey", F.lit(5))
    return cohort(spark, sf).select("o_orderkey", F.when(k == 0, F.concat("stem", F.lit("_x"))).when(k == 1, F.regexp_replace("stem", "_.*", "")).when(k == 2, F.regexp_replace("stem", "_[^_]*_", "__")).otherwise(F.col("stem")).alias("stem"))


ODD = "odd AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN stem || '_x' WHEN 1 THEN regexp_replace(stem, '_.*', '') WHEN 2 THEN regexp_replace(stem, '_[^_]*_', '__') ELSE stem END AS stem FROM cohort)"


@query("validate_stems", WITH + ", " + ODD + " SELECT o_orderkey, stem, CASE o_orderkey % 5 WHEN 0 THEN 'tokens:5' WHEN 1 THEN 'tokens:1' ELSE 'empty:session' END AS reason FROM odd WHERE o_orderkey % 5 < 3")
def _(spark, sf):
    return _odd_names(spark, sf).withColumn("reason", N.fault(F.col("stem"))).where("reason is not null")


@query("identity_keys", WITH + ", " + ODD + " SELECT o_orderkey, CASE WHEN split_part(stem,'_',1) <> '' THEN split_part(stem,'_',1) ELSE stem END AS subject, CASE WHEN split_part(stem,'_',1) <> '' AND split_part(stem,'_',2) <> '' THEN split_part(stem,'_',1) || '_' || split_part(stem,'_',2) ELSE stem END AS session_key FROM odd")
def _(spark, sf):
    return _odd_names(spark, sf).select("o_orderkey", N.group_key(F.col("stem"), "subject").alias("subject"), N.group_key(F.col("stem"), "session").alias("session_key"))


@query("group_key", WITH + "SELECT o_orderkey, split_part(stem,'_',1) AS g_subject, split_part(stem,'_',1) || '_' || split_part(stem,'_',2) AS g_session, stem AS g_volume FROM cohort")
def _(spark, sf):
    return cohort(spark, sf).select("o_orderkey", *[N.group_key(F.col("stem"), x).alias(f"g_{x}") for x in ("subject", "session", "volume")])


@query("subgroup_of", WITH + ", " + ODD + " SELECT o_orderkey, coalesce(nullif(lower(split_part(stem,'_',4)),''),'unknown') AS subgroup FROM odd")
def _(spark, sf):
    return _odd_names(spark, sf).select("o_orderkey", N.subgroup(N.field(F.col("stem"), 3)).alias("subgroup"))


@query("age_parse", "SELECT p_partkey, p_type AS age_tok, TRY_CAST(nullif(regexp_extract(p_name || '-' || CAST(p_size AS VARCHAR) || 'mo', '[-+]?[0-9]*\\.?[0-9]+'), '') AS DOUBLE) AS age_num FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("age_tok"), N.age_number(F.concat_ws("", "p_name", F.lit("-"), "p_size", F.lit("mo"))).alias("age_num"))


@query("describe_stems", WITH + "SELECT stem, split_part(stem,'_',1) AS id, split_part(stem,'_',2) AS session, CAST(age AS DOUBLE) AS age_num, weighting AS subgroup FROM cohort ORDER BY stem LIMIT 6")
def _(spark, sf):
    s = F.col("stem")
    return cohort(spark, sf).select("stem", N.field(s, 0).alias("id"), N.field(s, 1).alias("session"), N.age_number(N.field(s, 2)).alias("age_num"), N.subgroup(N.field(s, 3)).alias("subgroup")).orderBy("stem").limit(6)


@query("include_filter", "SELECT page_id, url FROM pages WHERE url LIKE 'https%/en/%' OR contains(url, 'blog')")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url").where(N.matches_any(F.col("url"), ["https*/en/*", "blog"]))


@query("include_bracket_glob", "SELECT c_custkey, c_name FROM customer WHERE c_name GLOB '*[0-4]?' OR c_name GLOB '*[!1-9][57]'")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_name").where(N.matches_any(F.col("c_name"), ["*[0-4]?", "*[!1-9][57]"]))


@query("identity_by_pattern", WITH + "SELECT o_orderkey, coalesce(nullif(regexp_extract(stem, '^([0-9]+)_', 1), ''), stem) AS subject, coalesce(lower(nullif(regexp_extract(stem, '_([a-z]+)$', 1), '')), 'unknown') AS subgroup FROM cohort")
def _(spark, sf):
    s = F.col("stem")
    return cohort(spark, sf).select("o_orderkey", F.coalesce(N.extracted(s, "^([0-9]+)_"), s).alias("subject"), N.subgroup(N.extracted(s, "_([a-z]+)$")).alias("subgroup"))


@query("weighting_filter", WITH + "SELECT o_orderkey, stem FROM cohort WHERE weighting = 'f'")
def _(spark, sf):
    return cohort(spark, sf).where(F.col("weighting") == "F".lower()).select("o_orderkey", "stem")


@query("age_range_filter", WITH + "SELECT o_orderkey, age FROM cohort WHERE age BETWEEN 12 AND 24")
def _(spark, sf):
    return cohort(spark, sf).where(F.col("age").between(F.least(F.lit(24), F.lit(12)), F.greatest(F.lit(24), F.lit(12)))).select("o_orderkey", "age")


@query("age_extremes", WITH + "SELECT stem, age FROM (SELECT *, row_number() OVER (ORDER BY age, stem) a, row_number() OVER (ORDER BY age DESC, stem) z FROM cohort) WHERE a = 1 OR z = 1")
def _(spark, sf):
    c = cohort(spark, sf).select("stem", "age")
    return c.orderBy("age", "stem").limit(1).union(c.orderBy(F.desc("age"), "stem").limit(1)).distinct()


@query("linspace_sample", WITH + "SELECT stem, pos FROM (SELECT stem, row_number() OVER (ORDER BY stem) - 1 AS pos, count(*) OVER () AS n FROM cohort) WHERE pos IN (SELECT CAST(floor(i * (n - 1) / 6.0) AS BIGINT) FROM range(7) r(i))")
def _(spark, sf):
    c = pairing.ranked(cohort(spark, sf).select("stem"), "pos", None, "stem")
    wanted = c.agg(F.count("*").alias("n")).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.floor(i * (F.col("n") - 1) / 6.0).cast("long"))).alias("pos")).distinct()
    return c.join(wanted, "pos", "left_semi").select("stem", "pos")


@query("shard_slice", WITH + "SELECT stem FROM (SELECT stem, row_number() OVER (ORDER BY stem) - 1 AS pos FROM cohort) WHERE pos % 8 = 3")
def _(spark, sf):
    return pairing.ranked(cohort(spark, sf).select("stem"), "pos", None, "stem").where(F.pmod("pos", F.lit(8)) == 3).select("stem")


@query("natural_sort", "SELECT c_name, row_number() OVER (ORDER BY CAST(regexp_extract(c_name, '[0-9]+') AS BIGINT), c_name) AS place FROM customer")
def _(spark, sf):
    placed = pairing.ranked(table(spark, sf, "customer").select("c_name"), "place", None, N.natural_key(F.col("c_name")), "c_name")
    return placed.withColumn("place", F.col("place") + 1)


@query("natural_rank", "SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY CAST(regexp_extract(s_name, '[0-9]+') AS BIGINT), s_name) - 1 AS pos FROM supplier")
def _(spark, sf):
    return pairing.ranked(table(spark, sf, "supplier"), "pos", "s_nationkey", N.natural_key(F.col("s_name")), "s_name", few=True).select("s_suppkey", "pos")


# joins and sets
@query("pair_inner", "SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def _(spark, sf):
    return pairing.pair_inner(table(spark, sf, "documents").select("doc_id", "n_chars"), table(spark, sf, "labels"), "doc_id")


@query("pair_anti_left", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return pairing.unpaired(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")


@query("pair_anti_right", "SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def _(spark, sf):
    return pairing.unpaired(table(spark, sf, "labels").select("doc_id", "quality"), table(spark, sf, "documents").where("lang = 'en'"), "doc_id")


@query("positional_pair", WITH + """, a AS (SELECT o_custkey, stem AS name_a, row_number() OVER (PARTITION BY o_custkey ORDER BY stem) - 1 AS pos FROM cohort),
 b AS (SELECT o_custkey, stem AS name_b, row_number() OVER (PARTITION BY o_custkey ORDER BY stem) - 1 AS pos FROM cohort WHERE o_orderkey % 7 <> 0)
 SELECT o_custkey, pos, name_a, name_b, coalesce(name_a = name_b, false) AS ok FROM a FULL JOIN b USING (o_custkey, pos)""")
def _(spark, sf):
    c = cohort(spark, sf)
    side = lambda df, name: pairing.ranked(df.select("o_custkey", F.col("stem").alias(name)), "pos", "o_custkey", name, hot=True)
    return pairing.pair_by_place(side(c, "name_a"), side(c.where("o_orderkey % 7 <> 0"), "name_b"), ["o_custkey", "pos"], "name_a", "name_b")


@query("fold_spec_absent", WITH + "SELECT stem FROM cohort WHERE o_orderkey % 3 = 0 AND stem NOT IN (SELECT stem FROM cohort WHERE o_orderkey % 2 = 0)")
def _(spark, sf):
    c = cohort(spark, sf)
    return pairing.unpaired(c.where("o_orderkey % 3 = 0").select("stem"), c.where("o_orderkey % 2 = 0"), "stem")


@query("fold_spec_unused", WITH + "SELECT stem FROM cohort WHERE o_orderkey % 2 = 0 AND stem NOT IN (SELECT stem FROM cohort WHERE o_orderkey % 3 = 0)")
def _(spark, sf):
    c = cohort(spark, sf)
    return pairing.unpaired(c.where("o_orderkey % 2 = 0").select("stem"), c.where("o_orderkey % 3 = 0"), "stem")


MANIFEST = "manifest AS (SELECT 's' || CAST(o_orderkey % 3 AS VARCHAR) AS split, CAST(row_number() OVER (PARTITION BY o_orderkey % 3 ORDER BY stem) - 1 AS VARCHAR) AS assigned_name, stem FROM cohort)"


def manifest(spark, sf):
    c = cohort(spark, sf).select(F.concat(F.lit("s"), F.pmod("o_orderkey", F.lit(3))).alias("split"), "stem")
    return pairing.ranked(c, "pos", "split", "stem", few=True).select("split", F.col("pos").cast("string").alias("assigned_name"), "stem")


@query("renumber", WITH + ", " + MANIFEST + " SELECT * FROM manifest")
def _(spark, sf):
    return manifest(spark, sf)


@query("manifest_resolve", WITH + ", " + MANIFEST + ", n AS (SELECT DISTINCT 's1' AS split, CAST(doc_id AS VARCHAR) AS assigned_name FROM documents) SELECT split, assigned_name, coalesce(stem, assigned_name) AS stem FROM n LEFT JOIN manifest USING (split, assigned_name)")
def _(spark, sf):
    n = table(spark, sf, "documents").select(F.lit("s1").alias("split"), F.col("doc_id").cast("string").alias("assigned_name")).distinct()
    return pairing.resolve(n, manifest(spark, sf))


@query("triple_join_missing", "SELECT doc_id, CASE WHEN doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en') THEN 'input' WHEN doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 1000) THEN 'target' END AS missing FROM labels")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return pairing.first_missing(d.where("lang = 'en'"), d.where("n_chars > 1000"), table(spark, sf, "labels").select("doc_id"), "doc_id")


@query("baseline_attach", "SELECT l.l_orderkey, l.l_linenumber, l.l_extendedprice, o.o_totalprice FROM lineitem l LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 2 = 0) o ON l.l_orderkey = o.o_orderkey")
def _(spark, sf):
    o = table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").join(o, "l_orderkey", "left")


@query("semi_flag", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 1 ELSE 0 END AS low_headroom FROM documents")
def _(spark, sf):
    return pairing.flagged(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").where("quality = 0"), "doc_id", "low_headroom")


@query("leak_check", WITH + "SELECT o_custkey, count(DISTINCT o_orderkey % 3) AS n_splits FROM cohort GROUP BY 1 HAVING count(DISTINCT o_orderkey % 3) > 1")
def _(spark, sf):
    return pairing.leaks(cohort(spark, sf).withColumn("split", F.pmod("o_orderkey", F.lit(3))), "o_custkey", "split")


@query("leak_by_level", WITH + """, t AS (SELECT *, o_orderkey % 5 = 0 AS test, CAST(o_custkey AS VARCHAR) AS g1, CAST(o_custkey AS VARCHAR) || '_' || CAST(session AS VARCHAR) AS g2 FROM cohort)
 SELECT 'subject' AS level, count(DISTINCT g1) AS seen FROM t WHERE test AND g1 IN (SELECT g1 FROM t WHERE NOT test) UNION ALL
 SELECT 'session', count(DISTINCT g2) FROM t WHERE test AND g2 IN (SELECT g2 FROM t WHERE NOT test) UNION ALL
 SELECT 'volume', count(DISTINCT stem) FROM t WHERE test AND stem IN (SELECT stem FROM t WHERE NOT test)""")
def _(spark, sf):
    c, out = cohort(spark, sf).withColumn("test", F.col("o_orderkey") % 5 == 0), None
    for level in ("subject", "session", "volume"):
        g = c.select("test", N.group_key(F.col("stem"), level).alias("g")).groupBy("g").agg(F.bool_or("test").alias("a"), F.bool_or(~F.col("test")).alias("b"))
        row = g.agg(F.count_if(F.col("a") & F.col("b")).alias("seen")).select(F.lit(level).alias("level"), "seen")
        out = row if out is None else out.union(row)
    return out


@query("schema_reconcile", "WITH h AS (SELECT p_name AS name, [p_size, p_size % 3] AS shape FROM part WHERE p_partkey % 3 <> 0), w AS (SELECT p_name AS name, [p_size, p_size % 2] AS shape FROM part WHERE p_partkey % 4 <> 0), hh AS (SELECT DISTINCT * FROM h), ww AS (SELECT DISTINCT * FROM w) SELECT CASE WHEN ww.shape IS NULL THEN 'unexpected' WHEN hh.shape IS NULL THEN 'missing' WHEN hh.shape = ww.shape THEN 'loaded' ELSE 'shape_mismatch' END AS status, count(*) AS n FROM hh FULL JOIN ww USING (name) GROUP BY 1")
def _(spark, sf):
    p = table(spark, sf, "part")
    side = lambda rule, m, prefix: p.where(rule).select(F.concat(F.lit(prefix), "p_name").alias("name"), F.array("p_size", F.col("p_size") % m).alias("shape")).distinct()
    return pairing.reconcile_shapes(side("p_partkey % 3 <> 0", 3, "module."), side("p_partkey % 4 <> 0", 2, "")).groupBy("status").agg(F.count("*").alias("n"))


@query("schema_coverage", "WITH h AS (SELECT DISTINCT p_name AS name, [p_size, p_size % 3] AS shape FROM part WHERE p_partkey % 3 <> 0 AND p_name NOT LIKE '%ed'), w AS (SELECT DISTINCT p_name AS name, [p_size, 1 + p_size % 2] AS shape FROM part WHERE p_partkey % 4 <> 0), m AS (SELECT w.shape[1] * w.shape[2] AS n, coalesce(h.shape = w.shape, false) AS hit FROM w LEFT JOIN h USING (name)), t AS (SELECT count(*) FILTER (hit) / count(*) AS tensors, sum(n) FILTER (hit) / sum(n) AS elements FROM m) SELECT round(tensors, 8) AS tensors, round(elements, 8) AS elements, round(least(tensors, elements), 8) AS guard FROM t")
def _(spark, sf):
    p = table(spark, sf, "part")
    have = p.where("p_partkey % 3 <> 0").select(F.concat(F.lit("module."), "p_name").alias("name"), F.array("p_size", F.col("p_size") % 3).alias("shape")).distinct()
    want = p.where("p_partkey % 4 <> 0").select(F.col("p_name").alias("name"), F.array("p_size", 1 + F.col("p_size") % 2).alias("shape")).distinct()
    found = pairing.coverage(pairing.reconcile_shapes(have, want, left_out=("ed",)))
    return found.select(*[F.round(c, 8).alias(c) for c in found.columns])


@query("scored_or_all", "WITH d AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AS low FROM documents) SELECT 'some' AS list, doc_id, NOT low AS scored FROM d UNION ALL SELECT 'every', doc_id, true FROM d")
def _(spark, sf):
    """Flagged rows don't count, unless all are flagged."""
    d = pairing.flagged(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").where("quality = 0"), "doc_id", "low")
    some, every = pairing.scored(d, "low"), pairing.scored(d.withColumn("low", F.lit(1)), "low")
    return some.select(F.lit("some").alias("list"), "doc_id", "scored").unionByName(every.select(F.lit("every").alias("list"), "doc_id", "scored"))


@query("set_intersect", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id").intersect(table(spark, sf, "labels").select("doc_id"))


@query("set_except", "SELECT l_partkey AS k FROM lineitem EXCEPT SELECT p_partkey FROM part WHERE p_size > 10")
def _(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k")).subtract(table(spark, sf, "part").where("p_size > 10").select("p_partkey"))


@query("set_union", "SELECT n_name AS k FROM nation UNION SELECT r_name FROM region")
def _(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_name").alias("k")).union(table(spark, sf, "region").select("r_name")).distinct()


@query("union_folds", "SELECT l_orderkey, 'a' AS fold, l_quantity AS x, NULL::DOUBLE AS y FROM lineitem WHERE l_orderkey % 2 = 0 UNION ALL SELECT l_orderkey, 'b', NULL, l_tax FROM lineitem WHERE l_orderkey % 2 = 1")
def _(spark, sf):
    x = table(spark, sf, "lineitem")
    return x.where("l_orderkey % 2 = 0").select("l_orderkey", F.lit("a").alias("fold"), F.col("l_quantity").alias("x")).unionByName(x.where("l_orderkey % 2 = 1").select("l_orderkey", F.lit("b").alias("fold"), F.col("l_tax").alias("y")), allowMissingColumns=True)


@query("incremental_anti", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT o_orderkey FROM orders)")
def _(spark, sf):
    return pairing.unpaired(table(spark, sf, "events").select("event_id"), table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id")), "event_id")


# groups and splits
@query("group_strata", WITH + "SELECT o_custkey, count(*) AS n, count(*) FILTER (weighting = 'f') AS n_f, count(*) FILTER (weighting = 'o') AS n_o FROM cohort GROUP BY 1")
def _(spark, sf):
    g = folds.group_strata(cohort(spark, sf), "o_custkey", "weighting")
    return g.select("o_custkey", "n", *[F.coalesce(F.try_element_at("strata", F.lit(x)), F.lit(0)).alias(f"n_{x}") for x in ("f", "o")])


@query("mixed_groups", WITH + "SELECT o_custkey, count(DISTINCT weighting) AS kinds FROM cohort GROUP BY 1 HAVING count(DISTINCT weighting) > 1")
def _(spark, sf):
    return cohort(spark, sf).groupBy("o_custkey").agg(F.countDistinct("weighting").alias("kinds")).where("kinds > 1")


@query("crosstab", WITH + "SELECT o_orderkey % 4 AS split, count(*) FILTER (weighting = 'f') AS f, count(*) FILTER (weighting = 'o') AS o, count(*) FILTER (weighting = 'p') AS p, count(*) AS total FROM cohort GROUP BY 1")
def _(spark, sf):
    c = cohort(spark, sf).withColumn("split", F.pmod("o_orderkey", F.lit(4)))
    return c.groupBy("split").pivot("weighting", ["f", "o", "p"]).count().na.fill(0).withColumn("total", F.col("f") + F.col("o") + F.col("p"))


@query("distinct_counts", WITH + "SELECT count(DISTINCT o_custkey) AS subjects, count(DISTINCT o_custkey * 100000 + session) AS sessions, (SELECT count(*) FROM (SELECT o_custkey FROM cohort GROUP BY 1 HAVING count(*) > 1)) AS repeats FROM cohort")
def _(spark, sf):
    c = cohort(spark, sf).groupBy("o_custkey").agg(F.count("*").alias("n"), F.countDistinct("session").alias("s"))
    return c.agg(F.count("*").alias("subjects"), F.sum("s").alias("sessions"), F.count_if(F.col("n") > 1).alias("repeats"))


@query("cohort_composition", WITH + "SELECT o_custkey, count(*) AS n, count(*) / CAST((SELECT count(*) FROM cohort) AS DOUBLE) AS share, count(*) / CAST((SELECT count(*) FROM cohort) AS DOUBLE) > 0.2 AS dominant FROM cohort GROUP BY 1")
def _(spark, sf):
    g = cohort(spark, sf).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("total")))).select("o_custkey", "n", (F.col("n") / F.col("total")).alias("share"), (F.col("n") / F.col("total") > 0.2).alias("dominant"))  # one row is broadcast


@query("topk_subjects", WITH + ", g AS (SELECT o_custkey, count(*) AS n FROM cohort GROUP BY 1) SELECT o_custkey, n FROM g ORDER BY n DESC, o_custkey LIMIT 5")
def _(spark, sf):
    return cohort(spark, sf).groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(5)


@query("composition_by_weighting", WITH + ", g AS (SELECT o_custkey, weighting, count(*) AS c FROM cohort GROUP BY 1, 2) SELECT o_custkey, CAST(sum(c) AS BIGINT) AS n, round(100.0 * sum(c) / (SELECT count(*) FROM cohort), 6) AS percent, string_agg(weighting || '=' || CAST(c AS VARCHAR), ',' ORDER BY weighting) AS by_weighting FROM g GROUP BY 1")
def _(spark, sf):
    c = cohort(spark, sf).groupBy("o_custkey", "weighting").agg(F.count("*").alias("c"))
    kinds = F.array_sort(F.collect_list(F.struct("weighting", "c")))  # an entry a weighting
    g = c.groupBy("o_custkey").agg(F.sum("c").alias("n"), F.array_join(F.transform(kinds, lambda k: F.concat_ws("=", k["weighting"], k["c"])), ",").alias("by_weighting"))
    total = F.broadcast(g.agg(F.sum("n").alias("total")))  # one row
    return g.crossJoin(total).select("o_custkey", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("percent"), "by_weighting")


@query("topk_and_rest", WITH + ", g AS (SELECT o_custkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS r FROM cohort GROUP BY 1) SELECT CAST(o_custkey AS VARCHAR) AS subject, n FROM g WHERE r <= 5 UNION ALL SELECT 'further', count(*) FILTER (n <= 2) FROM g WHERE r > 5")
def _(spark, sf):
    """The five largest subjects, and how many others have two volumes at most."""
    g = cohort(spark, sf).groupBy("o_custkey").agg(F.count("*").alias("n"))
    top = g.orderBy(F.desc("n"), "o_custkey").limit(5)
    rest = g.join(F.broadcast(top), "o_custkey", "left_anti").agg(F.count_if(F.col("n") <= 2).alias("n"))  # five rows
    return top.select(F.col("o_custkey").cast("string").alias("subject"), "n").union(rest.select(F.lit("further"), "n"))


@query("cv_rotate", WITH + "SELECT o_orderkey, r.i AS round, CASE WHEN o_custkey % 5 = r.i THEN 'test' WHEN o_custkey % 5 = (r.i + 1) % 5 THEN 'val' ELSE 'train' END AS split FROM cohort, range(5) r(i)")
def _(spark, sf):
    return folds.rotate(cohort(spark, sf).withColumn("fold", F.pmod("o_custkey", F.lit(5))), 5).select("o_orderkey", "round", "split")


@query("random_subject_split", WITH + ", s AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) AS r FROM (SELECT DISTINCT o_custkey FROM cohort)) SELECT o_custkey, CASE WHEN r <= 10 THEN 'test' WHEN r <= 30 THEN 'val' ELSE 'train' END AS split FROM s")
def _(spark, sf):
    s = pairing.ranked(cohort(spark, sf).select("o_custkey").distinct(), "r", None, "o_custkey")
    return s.select("o_custkey", F.when(F.col("r") < 10, "test").when(F.col("r") < 30, "val").otherwise("train").alias("split"))


@query("head_split", "SELECT c_name, CASE WHEN row_number() OVER (ORDER BY CAST(regexp_extract(c_name, '[0-9]+') AS BIGINT), c_name) <= 7 THEN 'test' ELSE 'train' END AS split FROM customer")
def _(spark, sf):
    c = pairing.ranked(table(spark, sf, "customer").select("c_name"), "r", None, N.natural_key(F.col("c_name")), "c_name")
    return c.select("c_name", F.when(F.col("r") < 7, "test").otherwise("train").alias("split"))


@query("kfold_groups")
def _(spark, sf):
    return folds.kfold_groups(cohort(spark, sf), "o_custkey", "weighting", 5)


@query("quota_split")
def _(spark, sf):
    return folds.quota_split(cohort(spark, sf), "o_custkey", "weighting", {"f": 40, "o": 40, "p": 4})


@query("balance_weights", WITH + ", g AS (SELECT weighting, count(*) AS n, pow(1.0 / count(*), 0.5) AS w FROM cohort GROUP BY 1), h AS (SELECT weighting, n, least(w, min(w) OVER () * 3) AS weight FROM g) SELECT weighting, n, round(weight, 8) AS weight, round(n * weight / sum(n * weight) OVER (), 8) AS share FROM h")
def _(spark, sf):
    t = sampling.balance_weights(cohort(spark, sf), "weighting", 0.5, 3)
    return t.select("weighting", "n", F.round("weight", 8).alias("weight"), F.round("share", 8).alias("share"))


@query("cap_group_share", "WITH RECURSIVE g AS (SELECT c_mktsegment AS k, sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 9.0 ELSE 1.0 END) AS w FROM customer GROUP BY 1), s AS (SELECT k, w / sum(w) OVER () AS share FROM g), o AS (SELECT *, row_number() OVER (ORDER BY share DESC, k) - 1 AS i, sum(share) OVER (ORDER BY share DESC, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s), m AS (SELECT min(i) AS m FROM o WHERE share / rest * (1 - i * 0.25) <= 0.25 + 1e-12) SELECT k, round(CASE WHEN i < m.m THEN 0.25 ELSE share / (SELECT rest FROM o, m WHERE i = m.m) * (1 - m.m * 0.25) END, 8) AS share FROM o, m")
def _(spark, sf):
    g = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("k")).agg(F.sum(F.when(F.col("c_mktsegment") == "BUILDING", 9.0).otherwise(1.0)).alias("w"))
    return sampling.cap_shares(g, "k", "w", 0.25).select("k", F.round("share", 8).alias("share"))


@query("share_after_cap", WITH + "SELECT weighting, round(sum(1.0 + o_custkey % 3) / (SELECT sum(1.0 + o_custkey % 3) FROM cohort), 8) AS share FROM cohort GROUP BY 1")
def _(spark, sf):
    g = cohort(spark, sf).groupBy("weighting").agg(F.sum(1.0 + F.pmod("o_custkey", F.lit(3))).alias("w"))
    return g.select("weighting", F.round(F.col("w") / F.sum("w").over(Window.partitionBy()), 8).alias("share"))


@query("weighted_sample", "WITH c AS (SELECT c_custkey, 1 + c_custkey % 4 AS w, sum(1 + c_custkey % 4) OVER (ORDER BY c_custkey) AS hi, sum(1 + c_custkey % 4) OVER () AS total FROM customer) SELECT c_custkey, CAST(ceil(hi / CAST(total AS DOUBLE) * 500 - 0.5) - ceil((hi - w) / CAST(total AS DOUBLE) * 500 - 0.5) AS BIGINT) AS times FROM c")
def _(spark, sf):
    return sampling.even_draws(table(spark, sf, "customer").withColumn("w", 1 + F.pmod("c_custkey", F.lit(4))), "c_custkey", "w", 500)


@query("weighted_draws", WITH + """, w AS (SELECT stem, round(o_totalprice * 100) AS w FROM cohort), line AS (SELECT stem, sum(w) OVER (ORDER BY stem) - w AS low, sum(w) OVER () AS total FROM w),
d AS (SELECT i AS draw, CAST('0x' || substr(md5('5:' || i), 1, 13) AS BIGINT) / 4503599627370496.0 * (SELECT max(total) FROM line) AS u FROM range((SELECT count(*) FROM cohort)) t(i))
SELECT d.draw, line.stem FROM d ASOF JOIN line ON d.u >= line.low""")
def _(spark, sf):
    """An epoch of draws with replacement: as many as there are volumes, in proportion to their prices."""
    c = cohort(spark, sf).select("stem", F.round(F.col("o_totalprice") * 100).alias("w"))
    return intervals.draws_with_replacement(c, "stem", "w", c.count(), 5)


@query("interval_join", "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_acctbal >= c_acctbal AND s_acctbal < c_acctbal + 50 + c_custkey % 100")
def _(spark, sf):
    """Suppliers with the customers whose stretch of balances holds theirs."""
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("low"), (F.col("c_acctbal") + 50 + F.pmod("c_custkey", F.lit(100))).alias("high"))
    return intervals.holding(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", c, "low", "high").select("s_suppkey", "c_custkey")


@query("json_get", "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k, coalesce(CAST(json_extract(props, '$.absent') AS BIGINT), -1) AS d FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("k"), F.coalesce(F.get_json_object("props", "$.absent").cast("long"), F.lit(-1)).alias("d"))


@query("template_path", WITH + "SELECT o_orderkey, 'lowres-' || weighting || '/' || stem || '_prediction_' || CAST(session AS VARCHAR) || '.png' AS path FROM cohort")
def _(spark, sf):
    return cohort(spark, sf).select("o_orderkey", F.format_string("lowres-%s/%s_prediction_%d.png", "weighting", "stem", "session").alias("path"))


@query("dq_report", WITH + ", " + ODD + " SELECT CASE o_orderkey % 5 WHEN 0 THEN 'tokens' WHEN 1 THEN 'tokens' ELSE 'empty' END AS rule, 'error' AS severity, count(*) AS n FROM odd WHERE o_orderkey % 5 < 3 GROUP BY 1")
def _(spark, sf):
    bad = _odd_names(spark, sf).withColumn("reason", N.fault(F.col("stem"))).where("reason is not null")
    return bad.groupBy(F.substring_index("reason", ":", 1).alias("rule"), F.lit("error").alias("severity")).agg(F.count("*").alias("n"))


@query("status_counts", "SELECT CASE WHEN n_chars = 0 THEN 'failed' WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'skipped' ELSE 'ok' END AS status, count(*) AS n FROM documents GROUP BY 1")
def _(spark, sf):
    d = pairing.flagged(table(spark, sf, "documents").select("doc_id", "n_chars"), table(spark, sf, "labels"), "doc_id", "done")
    return d.groupBy(F.when(F.col("n_chars") == 0, "failed").when(F.col("done") == 1, "skipped").otherwise("ok").alias("status")).agg(F.count("*").alias("n"))


@query("repeat_rows", "SELECT doc_id, r.i AS copy FROM labels, range(4) r(i)")
def _(spark, sf):
    return table(spark, sf, "labels").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("copy"))
