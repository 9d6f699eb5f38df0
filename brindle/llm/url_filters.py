"""URL filters: rules for hosts and paths, and redirect equivalence for what no rule names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table
from .components import connected_components

#: (verdict, host, path) of the production filter.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: Up to this many rules are folded into one expression; a longer list is joined by host suffix.
FOLDED_RULES = 256


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    """What stands behind the first ://, empty for a null url or one without."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def match_rules(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """urls (with columns host, path) plus rule (host and path as one string) and ruling, null where no rule fits.

    A rule fits its host and the subdomains of that host where the path starts with the rule's path; the rule
    whose string is longest wins, then the one with the longer host.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1] + r[2]))
    if len(ordered) <= FOLDED_RULES:
        rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
        for verdict, host, path in reversed(ordered):
            fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
            rule, ruling = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruling)
        return urls.withColumn("rule", rule).withColumn("ruling", ruling)
    listed = urls.sparkSession.createDataFrame([(h, p, h + p, v, -i) for i, (v, h, p) in enumerate(ordered)], "rule_host string, rule_path string, rule string, ruling string, place int")
    labels = F.split("host", r"\.")
    suffix = F.expr("transform(sequence(1, size(_labels)), i -> array_join(slice(_labels, i, size(_labels)), '.'))")
    distinct = urls.select("host", "path").distinct()
    fit = distinct.withColumn("_labels", labels).withColumn("rule_host", F.explode(suffix)).join(listed, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = fit.groupBy("host", "path").agg(F.max_by("rule", "place").alias("rule"), F.max_by("ruling", "place").alias("ruling"))
    return urls.join(best, ["host", "path"], "left")


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): keys of a page's url and of the url that its canonical link or its refresh redirect names.

    Only tags outside comments count. A relative target is resolved against the page's url. Pages without a url,
    or whose html is null or has no such tag, give no edge.
    """
    some = pages.where(F.col("html").rlike(r"(?i)<link|<meta") & F.col("html").rlike(r"(?i)canonical|http-equiv") & F.col("url").contains("://"))
    tags = F.regexp_extract_all(F.regexp_replace("html", r"(?s)<!--.*?-->", ""), F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))
    found = some.select("url", F.explode(tags).alias("tag"))
    quoted = lambda name: F.regexp_extract("tag", rf"""(?i)\b{name}\s*=\s*(?:["']\s*)?([^"'>]*)""", 1)
    canonical = F.col("tag").rlike(r"""(?i)^<link\b[^>]*\brel\s*=\s*["']?[^"'>]*\bcanonical\b""")
    refresh = F.col("tag").rlike(r"""(?i)^<meta\b[^>]*\bhttp-equiv\s*=\s*["']?\s*refresh\b""")
    target = F.when(canonical, quoted("href")).when(refresh, F.regexp_extract("tag", r"""(?i)\burl\s*=\s*["']?([^"'>]*)""", 1))
    named = found.select("url", F.trim(F.regexp_replace(target, "&amp;", "&")).alias("to"))
    # what of the page's url stays before a target of this form
    origin = F.regexp_extract("url", r"(?s)^[^?#]*?://[^/?#]*", 0)
    to, page = F.col("to"), F.regexp_extract("url", r"(?s)^[^#]*", 0)
    folder = F.concat(origin, F.regexp_extract(F.substr("url", F.length(origin) + 1), r"(?s)^[^?#]*/", 0))
    before = F.when(to.contains("://"), "").when(to.startswith("//"), "http:").when(to.startswith("/"), origin).when(to.startswith("?"), F.regexp_extract("url", r"(?s)^[^?#]*", 0)).when(to.startswith("#"), page)
    before = before.otherwise(F.when(folder == origin, F.concat(origin, F.lit("/"))).otherwise(folder))
    parts = named.where("to <> ''").select("url", F.concat(before, to).alias("full"))
    return parts.select(url_key(F.col("url")).alias("a"), url_key(F.col("full")).alias("b")).where("a is not null and b is not null")


def url_key(url: Column) -> Column:
    """Names a url in the alias graph: without scheme and fragment, host lower-cased. Null without a host."""
    rest = _after_scheme(url)
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.when(host != "", F.concat(host, F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1)))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, alias_of for each row of pages (page_id, url, html).

    The longest fitting rule decides. A url without a rule takes the decision of its class, the component of
    canonical links and redirects that it lies in: allow if a rule allows any member, else block if a rule blocks
    any, else allow. edges (a, b: url_key of two urls) come from the pages' own html unless given, such as from
    a crawl's redirect log. alias_of is the smallest key of the class (the url's own where it has no alias; null without a host).

    Null and malformed urls have an empty host and path, no rule and no class, and are allowed. Repeated rows are judged
    alike, each once. An empty table gives no rows. Other columns, whatever their names, are not carried.
    """
    edges = alias_edges(pages) if edges is None else edges
    classes = connected_components(edges)
    nodes = classes.select("node", "component").union(classes.select(F.col("component").alias("node"), "component")).distinct()
    ruled = match_rules(nodes.withColumn("host", F.regexp_extract("node", r"^[^/?]*", 0)).withColumn("path", F.regexp_extract("node", r"^[^/?]*([^?]*)", 1)), rules)
    decided = ruled.groupBy("component").agg(F.bool_or(F.col("ruling") == "allow").alias("allowed"), F.bool_or(F.col("ruling") == "block").alias("blocked"))
    known = nodes.join(decided, "component").select(F.col("node").alias("_key"), F.col("component").alias("_class"), (F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False))).alias("_blocked"))
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), url_key(F.col("url")).alias("_key"))
    judged = match_rules(urls, rules).join(known, "_key", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruling", F.when(F.col("_blocked"), F.lit("block")), F.lit("allow")).alias("verdict"), F.coalesce("_class", "_key").alias("alias_of"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


#: The pages of the data name no canonical or redirect targets, so each url is a class of its own here; classes are tested against brute force.
SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM q
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN host <> '' THEN host || substr(regexp_extract(rest, '^[^#]*'), length(regexp_extract(rest, '^[^/?#]*')) + 1) END AS alias_of
FROM r
"""
