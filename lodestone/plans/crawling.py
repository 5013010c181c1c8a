"""Queries of what crawlers may see and did see, of the store's writes, and of streams, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import html as H
from lodestone.operators import crawl, store
from lodestone.plans.oracle import HOST, ORACLE, r
from lodestone.plans.queries import _drained, _stream, pages, query, read
from lodestone.streaming import jobs

#: Crawlers of AI companies, as the SQL knows them.
_AI = ["GPTBot", "ChatGPT-User", "OAI-SearchBot", "ClaudeBot", "Claude-Web", "anthropic-ai", "PerplexityBot", "Google-Extended", "Applebot-Extended", "CCBot"]
#: A robots file for each host, in SQL that both engines read; {nl} is a line break.
_FILES = (
    "CASE WHEN length(host) % 7 = 3 THEN 503 WHEN length(host) % 7 = 4 THEN 404 ELSE 200 END AS code, "
    "CASE WHEN length(host) % 7 = 4 THEN '' WHEN host LIKE 'm.%' THEN concat('User-agent: *{nl}Disallow: /de/{nl}Allow: /de/1{nl}Sitemap: https://', host, '/s.xml{nl}sitemap: /t.xml') "
    "WHEN length(host) % 5 = 1 THEN '# all{nl}" + "".join(f"User-agent: {b}{{nl}}" for b in _AI) + "Allow: /{nl}' WHEN length(host) % 5 = 2 THEN 'User-agent: bingbot{nl}Disallow: /{nl}' "
    "WHEN length(host) % 5 = 3 THEN ' ' WHEN length(host) % 2 = 0 THEN 'User-agent: CCBot{nl}User-agent: GPTBot{nl}Disallow: /{nl}' ELSE '# none' END AS body"
)


def _paths(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "pages").select("page_id", "url", H.host_of(F.col("url")).alias("host"), F.regexp_extract("url", r"://[^/?#]*([^#]*)", 1).alias("path"))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    columns = _FILES.replace("{nl}", "\\n")
    code, body = columns.split(" AS code, ")
    return _paths(spark, folder).select("host").distinct().selectExpr("host", f"{code} AS code", body)


def _access(spark: SparkSession, folder: str) -> DataFrame:
    return crawl.robots_access(crawl.robots_rules(_files(spark, folder)), _paths(spark, folder))


_PATHS = f"paths AS (SELECT DISTINCT {HOST.format('url')} AS host, regexp_extract(url, '://[^/?#]*([^#]*)', 1) AS path FROM pages)"
_ACCESS = f"""WITH {_PATHS},
files AS (SELECT host, {_FILES.replace("{nl}", chr(10))} FROM (SELECT DISTINCT host FROM paths)),
denied AS (SELECT p.host, p.path, code, body, body LIKE '%Disallow: /de/%' AND starts_with(path, '/de/') AND NOT starts_with(path, '/de/1') AS every, body LIKE 'User-agent: CCBot%' AS parts, body LIKE 'User-agent: bingbot%' AS bing, body LIKE '# all%' AS listed, code NOT BETWEEN 1 AND 399 AS lost FROM paths p JOIN files USING (host))"""


@query
def robots_findings(spark, folder):
    return crawl.robots_findings(_access(spark, folder), _files(spark, folder))


ORACLE["robots_findings"] = _ACCESS + """,
checks AS (SELECT unnest(['E1', 'E2', 'E3', 'E10', 'E13', 'A10', 'A11']) AS check_id)
SELECT host, path, check_id,
       CASE WHEN check_id = 'A11' THEN CASE WHEN lost THEN 'na' WHEN contains(body, 'Sitemap:') THEN 'pass' ELSE 'warn' END
            WHEN lost THEN 'warn'
            WHEN every THEN 'fail'
            WHEN parts AND check_id IN ('E10', 'E13', 'A10') THEN 'fail'
            WHEN bing AND check_id IN ('E2', 'A10') THEN 'fail'
            ELSE 'pass' END AS status
FROM denied, checks"""


@query
def robots_checks(spark, folder):
    return crawl.robots_checks(_access(spark, folder), _files(spark, folder))


ORACLE["robots_checks"] = _ACCESS + """,
checks AS (SELECT unnest(['reachable', 'declares_sitemap', 'googlebot', 'ai_crawlers_all', 'target_path']) AS name)
SELECT host, path, name AS "check",
       CASE name
         WHEN 'reachable' THEN CASE WHEN lost THEN 'fail' WHEN trim(body) = '' THEN 'warn' ELSE 'pass' END
         WHEN 'declares_sitemap' THEN CASE WHEN lost THEN 'na' WHEN contains(body, 'Sitemap:') THEN 'pass' ELSE 'warn' END
         WHEN 'googlebot' THEN CASE WHEN lost THEN 'warn' WHEN every THEN 'fail' ELSE 'pass' END
         WHEN 'ai_crawlers_all' THEN CASE WHEN lost THEN 'warn' WHEN every OR parts THEN 'fail' WHEN listed THEN 'pass' ELSE 'warn' END
         ELSE CASE WHEN lost THEN 'warn' WHEN every OR parts OR bing THEN 'fail' ELSE 'pass' END END AS status
FROM denied, checks"""


@query
def robots_gate(spark, folder):
    return crawl.gate_access(_access(spark, folder), _files(spark, folder).select("host", "code"))


ORACLE["robots_gate"] = _ACCESS + " SELECT host, path, CASE WHEN code < 500 THEN NOT every AND NOT parts END AS ai_bot_allowed FROM denied"


@query
def sitemap_sources(spark, folder):
    hosts = _files(spark, folder)
    probes = hosts.selectExpr("host", "inline(array(named_struct('path', '/sitemap_index.xml', 'code', 200), named_struct('path', '/sitemap.xml', 'code', IF(length(host) % 3 = 0, 200, 404))))")
    return crawl.sitemap_sources(hosts, probes)


ORACLE["sitemap_sources"] = _ACCESS + """, m AS (SELECT host FROM files WHERE contains(body, 'Sitemap:'))
SELECT host, 'robots' AS source, 'https://' || host || '/s.xml' AS sitemap FROM m UNION ALL SELECT host, 'robots', '/t.xml' FROM m
UNION ALL SELECT host, 'usual', CASE WHEN length(host) % 3 = 0 THEN '/sitemap.xml' ELSE '/sitemap_index.xml' END FROM files WHERE host NOT IN (SELECT host FROM m)"""


def _sitemaps(spark: SparkSession, folder: str) -> DataFrame:
    """Two files for each host: an index and a list of its pages' URLs, two in three of them dated."""
    date = F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("<lastmod>2026-01-0"), F.col("page_id") % 9 + 1, F.lit("</lastmod>"))).otherwise("")
    loc = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<![CDATA["), F.col("url"), F.lit("]]>"))).otherwise(F.replace("url", F.lit("&"), F.lit("&amp;")))
    rows = _paths(spark, folder).withColumn("entry", F.concat(F.lit("<url><loc>"), loc, F.lit("</loc>"), date, F.lit("</url>")))
    lists = rows.groupBy("host").agg(F.array_join(F.array_sort(F.collect_list("entry")), "").alias("entries"))
    files = lists.select("host", F.lit("list.xml").alias("sitemap"), F.concat(F.lit('<urlset xmlns="http://s.example/x">'), "entries", F.lit("</urlset>")).alias("body"))
    index = lists.select("host", F.lit("index.xml").alias("sitemap"), F.lit("<sitemapindex><sitemap><loc>list.xml</loc></sitemap><sitemap><loc>gone.xml</loc></sitemap></sitemapindex>").alias("body"))
    return files.unionByName(index)


def _walked(spark: SparkSession, folder: str) -> DataFrame:
    roots = _paths(spark, folder).select("host").distinct().withColumn("sitemap", F.lit("index.xml"))
    return crawl.walk_sitemaps(crawl.sitemap_entries(_sitemaps(spark, folder)), roots)


@query
def sitemap_urls(spark, folder):
    return _walked(spark, folder)


@query
def sitemap_dates(spark, folder):
    return crawl.sitemap_coverage(_walked(spark, folder))


@query
def sitemap_checks(spark, folder):
    targets = _paths(spark, folder).groupBy("host").agg(F.min("url").alias("url")).filter("length(host) % 2 = 0")
    probes = _paths(spark, folder).selectExpr("url AS loc", "page_id % 4 AS k").groupBy("loc").agg(F.min("k").alias("k")).filter("k > 0").selectExpr("loc", "CASE k WHEN 3 THEN 404 WHEN 2 THEN 403 ELSE 200 END AS code")
    return crawl.sitemap_checks(_walked(spark, folder).select("host", "loc"), targets, probes)


_WALKED = f"WITH walked AS (SELECT {HOST.format('url')} AS host, url AS loc, max(CASE WHEN page_id % 3 > 0 THEN '2026-01-0' || (page_id % 9 + 1) END) AS lastmod, min(page_id % 4) AS k FROM pages GROUP BY ALL)"
ORACLE["sitemap_urls"] = _WALKED + " SELECT host, loc, 1 AS depth, lastmod FROM walked"
ORACLE["sitemap_dates"] = _WALKED + f" SELECT host, count(*) AS urls, {r('count(lastmod) * 100.0::DOUBLE / count(*)')} AS dated_pct, CASE WHEN count(lastmod) * 100.0 / count(*) >= 80 THEN 'pass' WHEN count(lastmod) * 100.0 / count(*) >= 40 THEN 'warn' ELSE 'fail' END AS status FROM walked GROUP BY host"
ORACLE["sitemap_checks"] = _WALKED + """, p AS (SELECT host, count(*) AS urls, count(*) FILTER (WHERE k > 0) AS probed, count(*) FILTER (WHERE k = 1) AS good, count(*) FILTER (WHERE k = 3) AS dead FROM walked GROUP BY host)
SELECT host, urls, CASE WHEN length(host) % 2 = 0 THEN 'pass' ELSE 'fail' END AS target, 'pass' AS one_domain, 'pass' AS size, 
  CASE WHEN probed = 0 THEN 'na' WHEN dead > 0 AND good * 1.0 / probed >= 0.9 THEN 'pass' WHEN dead > 0 AND good * 1.0 / probed >= 0.7 THEN 'warn' WHEN dead > 0 THEN 'fail'
       WHEN good < probed THEN 'warn' ELSE 'pass' END AS alive
FROM p"""


@query
def ttfb_bands(spark, folder):
    samples = read(spark, folder, "events").selectExpr("event_id % 700 AS page_id", "IF(user_id % 6 = 0, 500, 200) AS code", "CAST(event_id * 31 % 2600 AS INT) AS ms")
    return crawl.ttfb_verdict(samples)


ORACLE["ttfb_bands"] = """WITH s AS (SELECT event_id % 700 AS page_id, user_id % 6 <> 0 AS ok, CAST(event_id * 31 % 2600 AS INT) AS ms FROM events),
g AS (SELECT page_id, list_sort(list(ms)) AS l FROM s WHERE ok GROUP BY page_id), p AS (SELECT page_id, l[len(l) // 2 + 1] AS median, l[least(CAST(floor(len(l) * 0.95::DOUBLE) AS BIGINT) + 1, len(l))] AS p95 FROM g)
SELECT a.page_id, median, p95, CASE WHEN median IS NULL THEN 'na' WHEN median < 800 THEN 'pass' WHEN median < 1800 THEN 'warn' ELSE 'fail' END AS status FROM (SELECT DISTINCT page_id FROM s) a LEFT JOIN p USING (page_id)"""


@query
def mobile_parity(spark, folder):
    """Pages against mobile renderings that lack words, headings or titles."""
    rows = read(spark, folder, "pages").selectExpr("page_id", "CAST(page_id * 13 % 900 AS INT) AS words", "'t' AS title", "'h' AS h1", "array('a', 'b', 'c', 'd') AS headings")
    mobile = rows.filter("page_id % 8 > 0").selectExpr("page_id", "CAST(IF(page_id % 3 = 0, words * 0.6, words) AS INT) AS words", "IF(page_id % 5 = 0, 'u', title) AS title", "h1", "CASE page_id % 7 WHEN 0 THEN array('a') WHEN 1 THEN array('a', 'b', 'c') ELSE headings END AS headings")
    return crawl.mobile_parity(rows, mobile)


ORACLE["mobile_parity"] = f"""WITH p AS (SELECT page_id, page_id * 13 % 900 AS words, CASE WHEN page_id % 8 > 0 THEN CAST(floor(CASE WHEN page_id % 3 = 0 THEN page_id * 13 % 900 * 0.6::DOUBLE ELSE page_id * 13 % 900 END) AS BIGINT) END AS m, CASE page_id % 7 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS gone FROM pages)
SELECT page_id, CASE WHEN words > 0 AND m IS NOT NULL THEN {r('CAST(m AS DOUBLE) / words', 2)} END AS ratio, CASE WHEN m IS NOT NULL THEN gone END AS lost_headings,
  CASE WHEN m IS NULL OR words = 0 THEN 'na' WHEN CAST(m AS DOUBLE) / words < 0.5 OR gone = 3 THEN 'fail' WHEN CAST(m AS DOUBLE) / words < 0.85 OR gone > 0 OR page_id % 5 = 0 THEN 'warn' ELSE 'pass' END AS status FROM p"""

@query
def store_writes(spark, folder):
    """Audits inserted where absent, children replaced and domains deleted, one after another."""
    rows = read(spark, folder, "pages").select("page_id", H.host_of(F.col("url")).alias("domain"), F.lit("old").alias("evidence"))
    held = store.insert_if_absent(rows.filter("page_id % 2 = 0"), rows.withColumn("evidence", F.lit("new")), "page_id", "domain")
    children = rows.filter("page_id % 5 = 0").withColumn("evidence", F.repeat(F.lit("x"), 5000))
    held = store.replace_children(held, children, "page_id")
    gone = store.delete_domains(held, ["www.example.org"])
    return gone.groupBy("evidence").agg(F.count("*").alias("n"))


ORACLE["store_writes"] = f"SELECT CASE WHEN page_id % 5 = 0 THEN repeat('x', 4000) WHEN page_id % 2 = 0 THEN 'old' ELSE 'new' END AS evidence, count(*) AS n FROM pages WHERE regexp_replace({HOST.format('url')}, '^www\\.', '') <> 'example.org' GROUP BY ALL"


@query
def stream_shares(spark, folder):
    return jobs.window_shares(_drained(jobs.tumbling_counts(_stream(spark, folder)), "shares"))


ORACLE["stream_shares"] = "WITH n AS (SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT start, event_type, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY start), 4) AS share FROM n"
ORACLE["stream_sessions"] = """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM e) SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, nth"""


@query
def corpus_changes(spark, folder):
    rows = read(spark, folder, "orders").selectExpr("CAST(o_orderdate AS DATE) AS updated")
    return jobs.changed_since(rows, F.lit("1998-08-10").cast("date"), 14)


ORACLE["corpus_changes"] = "SELECT max(CAST(o_orderdate AS DATE)) AS newest, count(*) FILTER (WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-10') <= 14) AS changed, count(*) FILTER (WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-10') <= 14) = 0 AS stale FROM orders"
_GROUP = {"blog": "contains(host, 'blog')", "m": "starts_with(host, 'm.')"}
ORACLE["robots_access"] = f"""WITH {_PATHS}, bots AS (SELECT unnest(['{"', '".join(crawl.BOTS)}']) AS bot),
judged AS (SELECT host, bot, CASE WHEN {_GROUP['blog']} THEN CASE WHEN bot IN ('GPTBot', 'CCBot') THEN NOT starts_with(path, '/en/') OR starts_with(path, '/en/1') ELSE NOT regexp_matches(path, '^/de/.*5$') END
  WHEN {_GROUP['m']} THEN bot IN ('Googlebot', 'Google-Extended') OR path = '' OR starts_with(path, '/fr/') ELSE true END AS allowed FROM paths, bots)
SELECT host, bot, count(*) AS n, count(*) FILTER (WHERE allowed) AS allowed, count(*) FILTER (WHERE NOT allowed) AS denied FROM judged GROUP BY ALL"""
