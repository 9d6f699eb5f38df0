"""Queries over sinks and scans: what they write to the shared folder is read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.names import natural_key
from ..operators import pairing
from ..operators.ordering import stored
from ..sources import documents as D
from ..sources import tables as S
from ..sources import volume
from ..sources.nifti import NiftiSource
from ..streaming import stream
from .catalogue import query, table
from .cohort import WITH, cohort


@query("csv_round_trip", "SELECT 'v' || CAST(event_id AS VARCHAR) AS stem, 'f' || CAST(event_id % 3 AS VARCHAR) AS fold, CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE event_type END AS subgroup, CASE WHEN event_id % 7 <> 0 THEN value END AS pred FROM events")
def _(spark, sf):
    k, at = F.col("event_id"), S.scratch(spark, "metrics")
    rows = table(spark, sf, "events").select(F.concat(F.lit("v"), k).alias("stem"), F.when(k % 5 != 0, F.col("event_type")).alias("subgroup"), F.when(k % 7 != 0, F.col("value")).otherwise(float("nan")).alias("pred"), F.concat(F.lit("f"), k % 3).alias("fold"))
    S.write_metrics(rows, at, ["stem", "subgroup"], ["pred"], by="fold")
    read = volume.read_metrics(spark, [at], ["stem", "subgroup", "fold"], ["pred"])
    return read.select("stem", F.regexp_extract("fold", "([^=]*)$", 1).alias("fold"), "subgroup", "pred")


@query("folds_json_explode", WITH + "SELECT CAST(o_custkey % 3 AS VARCHAR) AS fold, CASE o_orderkey % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split, stem FROM cohort")
def _(spark, sf):
    split, at = F.pmod("o_orderkey", F.lit(4)), S.scratch(spark, "folds")
    assigned = cohort(spark, sf).select(F.pmod("o_custkey", F.lit(3)).cast("string").alias("fold"), F.when(split == 0, "test").when(split == 1, "val").otherwise("train").alias("split"), "stem")
    S.write_folds(assigned, at)
    return S.read_fold_lines(spark, at)


@query("list_round_trip", "SELECT DISTINCT c_mktsegment AS entry FROM customer")
def _(spark, sf):
    at = S.scratch(spark, "list")
    volume.write_list(table(spark, sf, "customer"), "c_mktsegment", at)
    return volume.read_list(spark, at)


@query("append_log", "SELECT event_id, value FROM events WHERE event_id % 4 < 2")
def _(spark, sf):
    e, at = table(spark, sf, "events").select("event_id", "value"), S.scratch(spark, "log")
    for part in range(2):
        S.append_log(e.where(F.col("event_id") % 4 == part), at)
    return spark.read.schema(e.schema).json(at)


@query("volume_round_trip", "SELECT 'v' || CAST(vec_id AS VARCHAR) AS stem, 64 AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings")
def _(spark, sf):
    """Each embedding as a volume of 4 x 4 x 4 in a file of its own, written and read again."""
    spark.dataSource.register(NiftiSource)
    at = S.scratch(spark, "volumes")
    v = table(spark, sf, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("stem"), F.array(*[F.lit(4)] * 3).alias("shape"), F.array(*[F.lit(1.0)] * 3).alias("spacing"), F.col("embedding").cast("array<float>").alias("data"))
    v.write.format("nifti").mode("append").save(at)
    read = spark.read.format("nifti").load(at).where("status = 'ok'")
    return read.select("stem", F.size("data").cast("long").alias("n"), F.round(A.total(F.col("data").cast("array<double>")), 4).alias("total"))


@query("header_scan", "SELECT 'v' || CAST(vec_id AS VARCHAR) AS stem, 64 AS n, CAST(1 + vec_id % 3 AS DOUBLE) AS width, true AS bare FROM embeddings WHERE CAST(vec_id AS VARCHAR) LIKE '1%'")
def _(spark, sf):
    """Extent and voxel size of the volumes of some names: other files are not opened, and of these only headers are read."""
    spark.dataSource.register(NiftiSource)
    at = S.scratch(spark, "volumes")
    v = table(spark, sf, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("stem"), F.array(*[F.lit(4)] * 3).alias("shape"), F.array(*[(1 + F.pmod("vec_id", F.lit(3))).cast("double")] * 3).alias("spacing"), F.col("embedding").cast("array<float>").alias("data"))
    v.write.format("nifti").mode("append").save(at)
    with stream.settings(spark, spark__sql__python__filterPushdown__enabled="true"):
        read = spark.read.format("nifti").option("push", "true").option("data", "false").load(at).where("stem like 'v1%'")
        kept = stored(read.select("stem", A.product(F.col("shape")).cast("long").alias("n"), F.col("spacing")[0].alias("width"), F.col("data").isNull().alias("bare")))
    return kept


@query("list_stems", "SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS stem, row_number() OVER (ORDER BY 'n' || CAST(n_nationkey AS VARCHAR)) - 1 AS place, row_number() OVER (ORDER BY n_nationkey) - 1 AS natural FROM nation")
def _(spark, sf):
    """Volumes of one folder, in the order of their characters and in that of their numbers."""
    spark.dataSource.register(NiftiSource)
    at, one = S.scratch(spark, "stems"), F.array(*[F.lit(1)] * 3)
    v = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("stem"), one.alias("shape"), one.cast("array<double>").alias("spacing"), F.array(F.lit(0.0)).cast("array<float>").alias("data"))
    v.write.format("nifti").mode("append").save(at)
    found = pairing.ranked(volume.list_stems(spark, at), "place", None, "stem")
    return pairing.ranked(found, "natural", None, natural_key(F.col("stem")), "stem")


@query("discover_files", "SELECT 'f' || CAST(i.i AS VARCHAR) AS folder FROM range(3) i(i)")
def _(spark, sf):
    """Tables one folder below the root are found, those deeper are not, as there are some."""
    at = S.scratch(spark, "found")
    for where in ("f0", "f1", "f2", "f1/deep"):
        table(spark, sf, "region").select("r_name").coalesce(1).write.option("header", True).csv(f"{at}/{where}")
    return S.discover(spark, at, "part-*.csv").select(F.regexp_extract("path", "([^/]+)/[^/]*$", 1).alias("folder"))


@query("index_names", "SELECT CAST(doc_id % 50 AS VARCHAR) AS stem, max('/d' || CAST(doc_id AS VARCHAR) || '/' || CAST(doc_id % 50 AS VARCHAR) || '.nii') AS path, count(*) AS copies FROM documents GROUP BY 1")
def _(spark, sf):
    stem = F.pmod("doc_id", F.lit(50)).cast("string")
    return S.index_names(table(spark, sf, "documents").select(stem.alias("stem"), F.concat(F.lit("/d"), "doc_id", F.lit("/"), stem, F.lit(".nii")).alias("path")))


@query("path_resolve", WITH + "SELECT stem, '/r/' || CAST(o_custkey % 3 AS VARCHAR) || '/prediction/' || stem || '.nii.gz' AS prediction, '/r/input/' || stem || '.nii.gz' AS input FROM cohort")
def _(spark, sf):
    fold = F.pmod("o_custkey", F.lit(3)).cast("string")
    return cohort(spark, sf).select("stem", *[S.resolved(F.col("stem"), fold, m, "/r").alias(m) for m in ("prediction", "input")])


@query("exemplars", WITH + ", d AS (SELECT weighting, stem, row_number() OVER (PARTITION BY weighting ORDER BY stem) AS k, count(*) OVER (PARTITION BY weighting) AS n FROM cohort) SELECT weighting, max(n) AS rows, string_agg(stem, ',' ORDER BY stem) AS first FROM d WHERE k <= 5 GROUP BY 1")
def _(spark, sf):
    return S.exemplars(cohort(spark, sf), "weighting", "stem", 5).select("weighting", "rows", F.array_join("first", ",").alias("first"))


@query("sorted_distinct", "SELECT DISTINCT lang FROM documents ORDER BY lang")
def _(spark, sf):
    return table(spark, sf, "documents").select("lang").distinct().orderBy("lang")


@query("leak_stamp", WITH + "SELECT 'subject' AS level, count(*) AS rows, count(DISTINCT o_custkey) AS groups, (SELECT count(*) FROM (SELECT o_custkey FROM cohort GROUP BY 1 HAVING count(DISTINCT o_orderkey % 3) > 1)) AS leaks, (SELECT count(*) FROM (SELECT o_custkey FROM cohort GROUP BY 1 HAVING count(DISTINCT o_orderkey % 3) > 1)) = 0 AS safe FROM cohort")
def _(spark, sf):
    c = cohort(spark, sf).select(F.col("o_custkey").alias("group"), F.pmod("o_orderkey", F.lit(3)).alias("split"))
    return S.stamped(c, "subject", pairing.leaks(c, "group", "split"))


@query("column_pick", "SELECT l_returnflag AS subgroup, l_orderkey AS stem, l_discount AS b_metric, l_tax AS c_metric FROM lineitem")
def _(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_tax").alias("c_metric"), F.col("l_discount").alias("b_metric"), F.col("l_orderkey").alias("stem"), F.col("l_returnflag").alias("subgroup"), F.lit("x").alias("_src"))
    return S.picked(x, ["subgroup", "absent", "stem"])


@query("sliding_windows", "SELECT w.i AS shift, event_type, time_bucket(INTERVAL '1 hour', ts - w.i * INTERVAL '30 minutes') + w.i * INTERVAL '30 minutes' AS start, count(*) AS n FROM events, range(2) w(i) GROUP BY 1, 2, 3")
def _(spark, sf):
    found = stream.sliding(table(spark, sf, "events"), "1 hour", "30 minutes")
    return found.select((F.minute("start") >= 30).cast("long").alias("shift"), "event_type", "start", "n")


@query("session_windows", "WITH l AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL '6 hours' AS opens FROM events), s AS (SELECT user_id, ts, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def _(spark, sf):
    return stream.sessions(table(spark, sf, "events"), "user_id", "6 hours")


def _manifest_documents(spark, sf):
    """A manifest for each order, a line each; that of every tenth breaks off. Returns the documents as they are read."""
    at, k = S.scratch(spark, "manifests"), F.col("o_orderkey")
    split = F.when(k % 4 == 0, "test").when(k % 4 == 1, "val").otherwise("train")
    entry = F.struct(F.concat(k % 3, F.lit(".nii.gz")).alias("assigned_name"), F.when(k % 5 > 0, F.col("stem")).alias("stem"))
    document = F.to_json(F.struct(F.create_map(F.lit("order"), k.cast("string")).alias("args"), F.create_map(split, F.array(entry)).alias("splits")))
    cohort(spark, sf).select(F.when(k % 10 == 9, F.substring(document, 1, 30)).otherwise(document).alias("value")).write.text(at)
    return D.read_documents(spark, at, D.MANIFEST, lines=True)


MANIFESTS = WITH + ", m AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split, CAST(o_orderkey % 3 AS VARCHAR) AS assigned_name, CASE WHEN o_orderkey % 5 > 0 THEN stem ELSE CAST(o_orderkey % 3 AS VARCHAR) END AS stem FROM cohort WHERE o_orderkey % 10 <> 9) "


@query("manifest_documents", MANIFESTS + "SELECT split, assigned_name, stem FROM m")
def _(spark, sf):
    return D.manifest_rows(_manifest_documents(spark, sf)).drop("file")


@query("broken_documents", "SELECT CASE WHEN o_orderkey % 10 = 9 THEN 'unreadable' ELSE 'ok' END AS status, count(*) AS n, CAST(sum(CASE WHEN o_orderkey % 10 <> 9 THEN 1 END) AS BIGINT) AS splits FROM orders GROUP BY 1")
def _(spark, sf):
    return _manifest_documents(spark, sf).groupBy("status").agg(F.count("*").alias("n"), F.sum(F.cardinality(F.map_keys("splits"))).alias("splits"))


@query("name_map", MANIFESTS + "SELECT assigned_name, max(stem) AS stem, false AS ambiguous FROM m WHERE split = 'val' GROUP BY 1")
def _(spark, sf):
    return D.name_map(D.manifest_rows(_manifest_documents(spark, sf)), "val")


@query("whole_triples", WITH + "SELECT stem, CASE WHEN o_orderkey % 7 = 0 THEN 'prediction' WHEN o_orderkey % 5 = 0 THEN 'target' END AS missing FROM cohort")
def _(spark, sf):
    """Of each volume's prediction, input and target the first that is not among the files."""
    c = cohort(spark, sf).select("o_orderkey", "stem", S.resolved_triples(F.col("stem"), F.pmod("o_custkey", F.lit(3)).cast("string"), "/r").alias("paths"))
    there = F.filter(F.array("paths.prediction", "paths.input", "paths.target"), lambda p: ~((F.col("o_orderkey") % 7 == 0) & p.contains("/prediction/")) & ~((F.col("o_orderkey") % 5 == 0) & p.contains("/target/")))
    return S.whole_triples(c.select("stem", "paths"), c.select(F.explode(there).alias("path"))).select("stem", "missing")
