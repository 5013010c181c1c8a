"""URL filters by expression expansion and hash-prefix joins, in DataFrame operations only.

A URL's host is expanded into its label suffixes and its path into its directory prefixes; each pair is an
expression.  A rule is stored under the expression of its host and its path up to the last ``/``.  Both sides
are joined on a short prefix of the expression's SHA-256, then the full digests must agree and the URL's path
must start with the rule's, and the longest rule that is left wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._scratch import Scratch, broadcast_if_small, spread_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules are broadcast up to so many; a longer list is joined by shuffle.
MAX_BROADCAST_RULES = 50_000
#: Hex digits of the digest that the join compares first (4 bytes, as in the public lookup protocols).
PREFIX_HEX = 8

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def _directory(path: Column) -> Column:
    """The path up to its last slash, that included; empty without one."""
    return F.regexp_extract(path, r"(?s)^(.*/)", 1)


def _digest(host: Column, directory: Column) -> Column:
    return F.sha2(F.concat(host, F.lit(" "), directory), 256)


def filter_urls(spark: SparkSession, pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Every row of ``pages`` with ``host, path, rule, verdict`` for its ``url``.

    ``rules``: host, path, verdict.  A rule fits its host and all subdomains where the URL's path starts with
    the rule's path; the longest host + path wins, ties to the smaller text, and of contradicting copies of one
    rule the one whose verdict comes last by text (block before allow).  Rows without a rule get ``default``
    and a null rule.  Null URLs and URLs without ``://`` have an empty host and path.  Repeated rows stay;
    columns of ``pages`` that share a name with a result, in any case of letters, are replaced.  A host and path that
    hold a large share of the rows are joined in parts.  Null parts of a rule count as empty; a
    rule with an empty host fits nothing but an empty host.  An empty table gives an empty result.
    """
    scratch = Scratch(spark)
    host, path = url_parts(F.col("url"))
    rules = rules.select(
        F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("r_host"),
        F.coalesce("path", F.lit("")).alias("r_path"),
        "verdict",
    )
    rules = rules.groupBy("r_host", "r_path").agg(F.max("verdict").alias("verdict"))
    rules = rules.withColumn("r_dir", _directory(F.col("r_path"))).withColumn("digest", _digest(F.col("r_host"), F.col("r_dir")))
    rules = scratch.save(rules.withColumn("short", F.substring("digest", 1, PREFIX_HEX)))
    # Expressions longer than any rule can't match: very long URLs don't expand without bound.
    bound = rules.agg(F.max(F.length("r_host")), F.max(F.length("r_dir"))).first()
    max_host, max_dir = (bound[0] or 0), (bound[1] or 0)

    # Copies of a host and path are judged once; how many there are tells which are dealt out below.
    sites = scratch.save(pages.select(host.alias("host"), path.alias("path")).groupBy("host", "path").agg(F.count("*").alias("n_")))
    tail = F.substring(F.concat(F.lit("."), "host"), -(max_host + 1), max_host + 1)
    head = F.substring("path", 1, max_dir)
    labels = F.split(tail, r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    folders = F.split(head, "/", -1)
    prefixes = F.transform(
        F.sequence(F.lit(0), F.size(folders) - 1),
        lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(folders, 1, i), "/"), F.lit("/"))),
    )
    asked = (
        sites.withColumn("suffix", F.explode(F.array_distinct(suffixes)))
        .withColumn("prefix", F.explode(F.array_distinct(prefixes)))
        .withColumn("asked", _digest(F.col("suffix"), F.col("prefix")))
    )
    asked = asked.select("host", "path", "asked", F.substring("asked", 1, PREFIX_HEX).alias("short"))
    hits = asked.join(broadcast_if_small(rules, MAX_BROADCAST_RULES), "short")
    hits = hits.filter((F.col("asked") == F.col("digest")) & F.col("path").startswith(F.col("r_path")))
    rule = F.concat("r_host", "r_path")
    best = hits.groupBy("host", "path").agg(
        F.min(F.struct((-F.length(rule)).alias("rank"), rule.alias("rule"), "verdict")).alias("best")
    )
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    site = F.struct("host", "path").alias("site")
    named = pages.select(F.struct(*kept).alias("row"), F.struct(host.alias("host"), path.alias("path")).alias("site"))
    judged = spread_join(named, best.select(site, "best"), "site", "left", sites.select(site, "n_"))
    return judged.select("row.*", "site.host", "site.path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages under the four rules of ``RULES``; urls that no rule fits are allowed."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(spark, pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op2_sql() -> str:
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return rf"""
WITH rules(r_host, r_path, verdict) AS (VALUES {rows}),
parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path
  FROM pages),
sites AS (SELECT DISTINCT host, path FROM parts),
best AS (
  SELECT host, path, arg_max(r_host || r_path, length(r_host || r_path)) AS rule,
         arg_max(verdict, length(r_host || r_path)) AS verdict
  FROM sites JOIN rules ON ('.' || host) LIKE ('%.' || r_host) AND starts_with(path, r_path)
  GROUP BY host, path)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""
