"""URL filters by expressions: host suffixes and path prefixes, joined on short hash prefixes, confirmed by digests.

DataFrame functions only. Each distinct (host, path) is expanded into host-suffix / path-prefix expressions; the first
32 bits of an expression's SHA-256 select candidates among the rules, the full digest confirms them, and the longest
rule wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import join_hot

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Rules up to this many are broadcast; more are joined by a shuffle on the hash prefix.
BROADCAST_RULES = 100_000


def url_parts(url_col: str) -> tuple[F.Column, F.Column]:
    """Host and path of a url; both are empty for null and for urls without `://`."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _digest(host: F.Column, path: F.Column) -> F.Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def match(spark: SparkSession, urls: DataFrame, rules: DataFrame, n_rules: int) -> DataFrame:
    """urls: host, path (distinct), n. rules: host, path, action. The winning rule of each url that has one, with its n.

    A rule fits its host and all subdomains of it, if the path starts with the rule's. Host suffixes are taken at the
    numbers of labels that rules have, path prefixes at their lengths, so a long url costs no more than its reading.
    The longest rule wins, by host and path together, then by host; `block` wins a tie.
    """
    labels = lambda host: F.size(F.split(host, r"\.", -1))
    shapes = rules.agg(F.sort_array(F.collect_set(F.length("path"))).alias("lengths"), F.sort_array(F.collect_set(labels(F.col("host")))).alias("labels"))
    suffixes = F.transform(F.filter("labels", lambda n: n <= labels(F.col("host"))), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    prefixes = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expanded = (
        urls.crossJoin(F.broadcast(shapes))  # one row
        .select("host", "path", "n", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
        .select("host", "path", "n", "suffix", F.explode("prefixes").alias("prefix"))
        .select("host", "path", "n", _digest(F.col("suffix"), F.col("prefix")).alias("digest"))
        .withColumn("short", F.substring("digest", 1, 8))
    )
    keyed = rules.select(F.struct(F.length("host") + F.length("path"), F.length("host"), F.col("action") == "block", F.concat("host", "path"), "action").alias("rule"), _digest(F.col("host"), F.col("path")).alias("full"))
    keyed = keyed.withColumn("short", F.substring("full", 1, 8))
    if n_rules <= BROADCAST_RULES:
        keyed = F.broadcast(keyed)
    hits = expanded.join(keyed, "short").where("digest = full")
    return hits.groupBy("host", "path").agg(F.max("rule").alias("best"), F.first("n").alias("n")).select("host", "path", "n", F.col("best.col4").alias("rule"), F.col("best.action").alias("verdict"))


def filter_urls(spark: SparkSession, pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """All columns of `pages` in the struct `doc`, and host, path, rule, verdict; `default` is for urls that no rule fits.

    Null urls and urls without `://` have an empty host and path and no rule; an empty host is joined with nothing.
    Equal urls are judged once and counted, and the verdicts of frequent ones come back by broadcast, so that no task
    gets all rows of one url; repeated rows stay; an empty table gives an empty result. Ties of rules see `match`.
    """
    host, path = url_parts(url_col)
    own = pages.select(F.struct(*[pages[c] for c in pages.columns]).alias("doc"), host.alias("host"), path.alias("path"))
    named = own.where("host <> ''")
    urls = named.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    best = match(spark, urls, rules, rules.count())
    judged = join_hot(named, best, ["host", "path"], "n", pages.count(), "left").drop("n")
    none = F.lit(None).cast("string")
    every = judged.unionByName(own.where("host = ''").select("doc", "host", "path", none.alias("rule"), none.alias("verdict")))
    return every.select("doc", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES) + " AS t(action, host, path)")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(spark, pages, rules).select("doc.page_id", "host", "path", "rule", "verdict")


OP2_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(action, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT p.*, r.action, rhost || rpath AS rule,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE k = 1
"""
