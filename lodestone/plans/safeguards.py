"""Queries of what guards fetching and citing: allowed addresses, retired guidance, kept verdicts; each beside its SQL."""

from __future__ import annotations

import ipaddress

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import addresses, grounding, verdicts
from lodestone.plans.guidance import WITH, curated_topk, found, guidance
from lodestone.plans.oracle import ORACLE, q
from lodestone.plans.queries import query, read, shared_folder

#: A stored URL of each page, in SQL that both engines read.
_URL = """CASE page_id % 12
  WHEN 1 THEN concat('http://', page_id % 256, '.', page_id * 7 % 256, '.', page_id * 13 % 256, '.', page_id % 5, ':8080/x')
  WHEN 2 THEN concat('https://[fd00::', page_id % 10000, ']/')
  WHEN 3 THEN concat('https://[2', page_id % 1000, ':', page_id % 10000, '::1]:443/a')
  WHEN 4 THEN concat('http://user:pw@h', page_id, '.example/')
  WHEN 5 THEN concat('ftp://h', page_id)
  WHEN 6 THEN concat('HTTP://LocalHost:', page_id, '/')
  WHEN 7 THEN concat('https://[::ffff:', 150 + page_id % 60, '.254.1.', page_id % 300, ']/')
  WHEN 8 THEN concat('http://192.168.', page_id % 300, '.0', page_id % 3, '/')
  WHEN 9 THEN CASE WHEN page_id % 2 = 0 THEN '' ELSE concat('http:///', page_id) END
  WHEN 11 THEN concat('https://[1:2:3]/', page_id)
  ELSE url END"""
#: An answer for each page's host; some hosts have none, some several.
_ANSWER = """CASE page_id % 4
  WHEN 0 THEN concat('2001:', page_id % 10000, ':db8::', page_id % 100)
  WHEN 1 THEN concat(page_id % 256, '.', page_id * 3 % 256, '.0.1')
  WHEN 2 THEN concat('9.', page_id % 256, '.1.1') ELSE 'none' END"""


@query
def url_safety(spark, folder):
    """Whether each page's stored URL may be fetched, by its text and its host's answers."""
    rows = read(spark, folder, "pages")
    host = F.lower(F.regexp_extract("url", "://([^/?#:]*)", 1))
    answers = rows.filter("page_id % 7 < 3").select(host.alias("host"), F.expr(_ANSWER).alias("address"))
    return addresses.url_safety(rows.select("page_id", F.expr(_URL).alias("url")), answers).select("page_id", "url_host", "allowed", "reason")


def _range_rows() -> str:
    """The ranges as rows of first and last address, in hex, with how wide they are and what they are for."""
    rows = []
    for use, nets in addresses.RANGES.items():
        for net in map(ipaddress.ip_network, nets):
            up = 0xFFFF << 32 if net.version == 4 else 0
            rows.append(f"('{int(net[0]) + up:032x}', '{int(net[-1]) + up:032x}', {net.prefixlen + (96 if up else 0)}, {q(use)})")
    return ", ".join(rows)


_octet = "(0|[1-9][0-9]{0,2})"
_side = lambda k: f"CASE WHEN coalesce(p[{k}], '') = '' THEN [] ELSE string_split(p[{k}], ':') END"
ORACLE["url_safety"] = rf"""WITH stored AS (SELECT page_id, trim({_URL}) AS u FROM pages),
places AS (SELECT page_id, u, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS place FROM stored),
cut AS (
  SELECT page_id, u, scheme, regexp_extract(place, '^(.*)@', 1) AS login, contains(place, '[') AS bracket,
    lower(CASE WHEN contains(place, '[') THEN regexp_extract(place, '\[([^\]]*)\]', 1) ELSE regexp_extract(regexp_replace(place, '^.*@', ''), '^[^:]*') END) AS url_host
  FROM places),
answers AS (SELECT lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host, {_ANSWER} AS address FROM pages WHERE page_id % 7 < 3),
texts AS (SELECT url_host AS a FROM cut UNION SELECT address FROM answers),
tails AS (SELECT a, CASE WHEN contains(a, '.') THEN regexp_extract(a, '[^:]*$') END AS four FROM texts),
quads AS (
  SELECT a, four, CASE WHEN regexp_full_match(four, '{_octet}\.{_octet}\.{_octet}\.{_octet}') THEN list_transform(string_split(four, '.'), lambda x: try_cast(x AS INT)) END AS n FROM tails),
hexed AS (SELECT a, four, CASE WHEN list_max(n) <= 255 THEN list_transform(n, lambda x: printf('%02x', x)) END AS h FROM quads),
wide AS (
  SELECT a, CASE WHEN four IS NULL THEN a WHEN h IS NULL THEN NULL
    ELSE (CASE WHEN contains(a, ':') THEN left(a, len(a) - len(four)) ELSE '::ffff:' END) || h[1] || h[2] || ':' || h[3] || h[4] END AS s FROM hexed),
sides AS (SELECT a, s, string_split(s, '::') AS p FROM wide WHERE s IS NOT NULL),
halves AS (SELECT a, len(p) AS n, {_side(1)} AS l, {_side(2)} AS r FROM sides),
numbers AS (
  SELECT a, CASE WHEN n = 1 THEN l WHEN n = 2 AND len(l) + len(r) < 8 THEN list_concat(l, list_transform(range(8 - len(l) - len(r)), lambda i: '0'), r) END AS g FROM halves),
addresses AS (
  SELECT a, array_to_string(list_transform(g, lambda x: lpad(x, 4, '0')), '') AS num FROM numbers
  WHERE len(g) = 8 AND len(list_filter(g, lambda x: regexp_full_match(x, '[0-9a-f]{{1,4}}'))) = 8),
ranges(first, last, bits, use) AS (VALUES {_range_rows()}),
uses AS (SELECT a, any_value(num) AS num, coalesce(arg_max(use, bits), '') AS use FROM addresses LEFT JOIN ranges ON num BETWEEN first AND last GROUP BY a),
hosts AS (SELECT host, arg_min(use, num) FILTER (WHERE use <> '') AS bad FROM answers JOIN uses ON a = address GROUP BY host),
judged AS (
  SELECT c.page_id, c.url_host, CASE WHEN c.u = '' THEN 'empty' WHEN c.scheme NOT IN ('http', 'https') THEN 'scheme'
    WHEN c.url_host = '' OR (c.bracket AND (x.a IS NULL OR NOT contains(c.url_host, ':'))) THEN 'host' WHEN c.login NOT IN ('', ':') THEN 'credentials'
    WHEN c.url_host IN ('localhost', 'metadata', 'metadata.google.internal') THEN 'blocked' WHEN x.a IS NOT NULL THEN nullif(x.use, '')
    WHEN h.host IS NULL THEN 'unresolved' ELSE h.bad END AS reason
  FROM cut c LEFT JOIN uses x ON x.a = c.url_host LEFT JOIN hosts h ON h.host = c.url_host)
SELECT page_id, url_host, reason IS NULL AS allowed, reason FROM judged"""

# What rows of guidance say, and the retired feature that each prescribes.
_SAYINGS = {
    "Use HowTo schema on every guide.": "howto", "Do not use HowTo markup.": None, "How-to rich snippets help.": "howto",
    "HowTo rich results are no longer shown, so adding HowTo schema is void.": None, "Answer questions in short.": None,
    "FAQ schema can earn you rich results.": "faq", "FAQPage markup is for answer engines.": None, "FAQ markup makes pages eligible for Q&A rich results.": None,
}


@query
def retired_guidance(spark, folder):
    """The retired features that rows of guidance prescribe."""
    said = " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(_SAYINGS))
    rows = guidance(spark, folder).selectExpr("kind", "id", f"CASE id % 8 {said} END AS then_action", "body AS statement")
    return rows.select("kind", "id", grounding.retired_feature(rows).alias("feature")).filter("feature IS NOT NULL")


ORACLE["retired_guidance"] = WITH + f""",
said AS (SELECT kind, id, CASE id % 8 {' '.join(f"WHEN {k} THEN '{f}'" for k, f in enumerate(_SAYINGS.values()) if f)} END AS feature FROM guide)
SELECT kind, id, feature FROM said WHERE feature IS NOT NULL"""

_PROMPT, _MODEL = "v1", "judge"


def _stamped(spark, folder) -> DataFrame:
    """Each finding's citations with a verdict: two writers have kept some, the judge answers some more."""
    asks = found(spark, folder).selectExpr("finding_id AS query_id", "audit_id", "check_id", "evidence", "status AS finding_status")
    rows = guidance(spark, folder).selectExpr("kind", "id", "name", "excerpt", "provenance_status = 'verified' AND trim(coalesce(excerpt, '')) <> '' AS faithful")
    pairs = curated_topk(spark, folder).join(asks, "query_id").join(rows, ["kind", "id"]).withColumnRenamed("finding_status", "status")
    pairs = pairs.withColumn("key", verdicts.verdict_key(pairs, _PROMPT, _MODEL)).withColumn("m", F.expr("(query_id + id) % 5"))
    table = verdicts.VerdictTable(spark, shared_folder(spark, "verdicts"))
    by = lambda m, verdict, day, writer: pairs.filter(m).selectExpr("key", f"{verdict} AS verdict", f"TIMESTAMP '2026-01-0{day} 00:00:00' AS written", f"'{writer}' AS writer")
    table.append(by("m < 2", "element_at(array('supports', 'related', 'unrelated'), CAST(id % 3 AS INT) + 1)", 2, "b").unionByName(by("m = 1", "'related'", 1, "c")))
    table.append(by("m = 0 OR m = 4 AND id % 2 = 0", "'unrelated'", 1, "a"))
    answers = pairs.filter("m IN (2, 3)").selectExpr("key", "IF(m = 2, 'supports', 'maybe') AS verdict")
    return verdicts.stamp(pairs, table.read(), answers)


@query
def citation_verdicts(spark, folder):
    """What each citation of a failed or warned finding proves, and how that is known."""
    return _stamped(spark, folder).select("query_id", "rank", "key", "entailment", "how")


@query
def citation_verdict_counts(spark, folder):
    return verdicts.verdict_counts(_stamped(spark, folder), "audit_id")


_cut = lambda c, n: f"substr(coalesce({c}, ''), 1, {n})"
_JUDGED = WITH + rf""",
cur AS (
  SELECT f.finding_id AS query_id, row_number() OVER (PARTITION BY f.finding_id ORDER BY a.tier, a.confidence DESC, a.id) AS rank, a.kind, a.id
  FROM found f JOIN alive a ON a.id % 4 = f.finding_id % 4
  WHERE (f.finding_id % 2 <> 0 OR a.id % 4 <> 3) AND (f.finding_id % 3 <> 0 OR a.id % 5 NOT IN (3, 4)) QUALIFY rank <= 3),
pairs AS (
  SELECT c.query_id, c.rank, f.audit_id, f.status, g.id, (c.query_id + g.id) % 5 AS m,
    g.provenance_status = 'verified' AND trim(coalesce(g.excerpt, '')) <> '' AS faithful,
    lower(regexp_replace(coalesce(f.evidence, ''), '^\s+|\s+$', '', 'g')) AS said, trim(regexp_replace(f.check_id, '^[^:]*:', '')) AS clean, f.check_id, g.kind,
    CASE WHEN coalesce(g.name, '') = '' THEN '(unnamed)' ELSE {_cut('g.name', 200)} END || chr(10) || chr(10) || chr(10) || {_cut('g.excerpt', 500)} AS shown
  FROM cur c JOIN found f ON f.finding_id = c.query_id JOIN guide g ON g.id = c.id),
keyed AS (
  SELECT *, sha256('{_PROMPT}:{_MODEL}:' || kind || ':' || id || ':' || coalesce(nullif(regexp_extract(clean, '^([A-J][0-9]{{1,2}}[a-z]?)(_|$)', 1), ''), check_id)
    || ':' || left(sha256(said), 16) || ':' || left(sha256(shown), 16)) AS key FROM pairs),
early AS (
  SELECT key, arg_min(verdict, written || writer || verdict) AS verdict FROM (
    SELECT key, ['supports', 'related', 'unrelated'][id % 3 + 1] AS verdict, '2' AS written, 'b' AS writer FROM keyed WHERE m < 2
    UNION ALL SELECT key, 'related', '1', 'c' FROM keyed WHERE m = 1) GROUP BY key),
stored AS (
  SELECT * FROM early UNION ALL
  SELECT DISTINCT key, 'unrelated' FROM keyed WHERE (m = 0 OR (m = 4 AND id % 2 = 0)) AND key NOT IN (SELECT key FROM early)),
answers AS (SELECT key, bool_or(m = 2) AS valid FROM keyed WHERE m IN (2, 3) GROUP BY key),
stamped AS (
  SELECT k.*, CASE WHEN NOT faithful THEN 'blocked' WHEN s.key IS NOT NULL THEN 'cached' WHEN w.valid THEN 'judged' WHEN w.key IS NOT NULL THEN 'invalid' ELSE 'unanswered' END AS how,
    CASE WHEN NOT faithful THEN 'unjudged' WHEN s.key IS NOT NULL THEN s.verdict WHEN w.valid THEN 'supports' ELSE 'unjudged' END AS entailment
  FROM keyed k LEFT JOIN stored s ON s.key = k.key LEFT JOIN answers w ON w.key = k.key WHERE k.status IN ('fail', 'warn'))"""
ORACLE["citation_verdicts"] = _JUDGED + " SELECT query_id, rank, key, entailment, how FROM stamped"
ORACLE["citation_verdict_counts"] = _JUDGED + """
SELECT audit_id, count(*) AS citations_seen, count(*) FILTER (WHERE how = 'cached') AS cache_hits, count(*) FILTER (WHERE how = 'judged') AS api_calls,
  count(*) FILTER (WHERE how = 'blocked') AS source_unattested, count(*) FILTER (WHERE how = 'invalid') AS errors,
  count(*) FILTER (WHERE entailment = 'supports') AS supports, count(*) FILTER (WHERE entailment = 'related') AS related,
  count(*) FILTER (WHERE entailment = 'unrelated') AS unrelated, count(*) FILTER (WHERE entailment = 'unjudged') AS unjudged
FROM stamped GROUP BY audit_id"""
