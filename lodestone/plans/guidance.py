"""Queries of retrieval, grounding, corpus tables and gates, each beside its SQL.

Benchmark items stand in for findings, documents for guidance rows, events for jobs, judgements and citations.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import corpus, crawl, grounding, retrieval, scoring, store
from lodestone.plans.oracle import AUDITS, ORACLE, SCORES, TOKENS, q, r
from lodestone.plans.oracle_pages import FEATURES
from lodestone.plans.queries import audits, features, findings, once, query, read

CHECK_IDS = ["A2_title_tag", "page:B1_ttfb", "C10_open_graph", "D4b_ids", "F3_faq", "H1_depth", "Z9_x", "plain"]
#: A finding of each benchmark item, in SQL that both engines read.
FINDING = (
    "item_id AS finding_id, item_id % 7 AS audit_id, CASE item_id % 8 " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(CHECK_IDS)) + " END AS check_id, "
    "CASE item_id % 5 WHEN 0 THEN NULL WHEN 1 THEN concat('LCP: ', item_id * 137, ' ms; 3,500 kb page and 12.5% text, ', item_id % 50, ' images') "
    "WHEN 2 THEN concat('it has ', item_id, '.04 MB, v2.3s and 1,200 words') WHEN 3 THEN concat(substr(text, 1, 300), ' 2.5 min') ELSE text END AS evidence, "
    "CASE item_id % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'warn' ELSE 'fail' END AS status"
)
#: A guidance row of each document.
ROW = (
    "doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'rule' WHEN 1 THEN 'ap' WHEN 2 THEN 'principle' ELSE 'playbook' END AS kind, text AS body, source AS source_org, substr(text, 1, 60) AS name, "
    "doc_id % 5 + 1 AS tier, (doc_id % 10) / CAST(10 AS DOUBLE) AS confidence, CASE WHEN doc_id % 7 = 0 THEN 'retired' ELSE 'active' END AS status, CASE WHEN doc_id % 11 = 0 THEN '1' END AS superseded_by, "
    "CASE WHEN doc_id % 3 = 0 THEN concat('https://x.example/', doc_id) WHEN doc_id % 3 = 1 THEN '' END AS source_url, doc_id % 40 AS document_id, CASE WHEN doc_id % 2 = 0 THEN 'verified' ELSE 'none' END AS provenance_status, "
    "CASE WHEN doc_id % 6 < 4 THEN substr(text, 1, 20) END AS excerpt, CASE WHEN doc_id % 9 = 0 THEN '[]' WHEN doc_id % 9 < 8 THEN concat('[', doc_id % 60, ',', doc_id % 13, ']') END AS refs, "
    "CASE WHEN doc_id % 5 = 0 THEN concat('k', doc_id % 30) WHEN doc_id % 5 = 1 THEN ' ' END AS rule_key, lang AS block"
)
KEYS = ["A2_title_tag", "A2_title", "B1_ttfb_median", "C10_open_graph_tags", "D4_id_coverage", "D4_ids", "F3_faq_section", "H12_x"]


def guidance(spark, folder):
    return read(spark, folder, "documents").selectExpr(*_split(ROW))


def found(spark, folder):
    return read(spark, folder, "benchmark").selectExpr(*_split(FINDING))


def _split(columns: str) -> list[str]:
    """The columns of a select list; commas inside brackets and quotes don't count."""
    out, depth, quoted, start = [], 0, False, 0
    for k, c in enumerate(columns):
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and not depth and not quoted:
            out.append(columns[start:k])
            start = k + 1
    return [*out, columns[start:]]


WITH = f"WITH found AS (SELECT {FINDING} FROM benchmark), guide AS (SELECT {ROW} FROM documents), alive AS (SELECT * FROM guide WHERE status = 'active' AND superseded_by IS NULL)"
_plain = r"lower(trim(regexp_replace(coalesce(evidence, ''), '\s+', ' ', 'g')))"
_number = r"(?:^|[^\w/.,-])([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(\.[0-9]+)?"
_units = {
    "time": r"\s*(milliseconds?|msecs?|ms|minutes?|mins?|seconds?|secs?|s)\b", "size": r"\s*(kilobytes?|kb|megabytes?|mb|gigabytes?|gb|bytes?)\b",
    "pct": r"\s*(%|percent(?:age)?\b|pct\b)", "count": r"\s+(words?|characters?|chars?|links?|images?|requests?|redirects?|scripts?|elements?)\b",
}


def _value(name: str) -> str:
    part = lambda k: f"regexp_extract(t, '{_number}{_units[name]}', {k})"
    return f"try_cast(replace({part(1)}, ',', '') || {part(2)} AS DOUBLE) AS {name}_v, {part(3)} AS {name}_u"


def _quantity(x: str) -> str:
    return f"CASE WHEN {r(x)} = floor({r(x)}) THEN CAST(CAST(floor({r(x)}) AS BIGINT) AS VARCHAR) ELSE printf('%.1f', {r(x)}) END"


_vocabulary = " ".join(f"WHEN '{n}' THEN [{', '.join(map(q, w))}]" for n, w in grounding.COUNT_WORDS.items())
_hint = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in grounding.SECTION_HINT.items())
_seconds = "CASE WHEN starts_with(time_u, 'ms') OR starts_with(time_u, 'milli') THEN time_v / 1000.0::DOUBLE WHEN starts_with(time_u, 'min') THEN time_v * 60.0::DOUBLE ELSE time_v END"
_kb = "(size_v * CASE left(size_u, 1) WHEN 'b' THEN 1.0::DOUBLE / 1024 WHEN 'k' THEN 1.0::DOUBLE WHEN 'm' THEN 1024.0::DOUBLE ELSE 1048576.0::DOUBLE END)"
_ordered = lambda x: f"list_transform(list_filter(list_zip({x}, range(1, len({x}) + 1)), lambda p: list_position({x}, p[1]) = p[2]), lambda p: p[1])"


@query
def query_texts(spark, folder):
    rows = found(spark, folder)
    return rows.select("finding_id", grounding.query_text(F.col("check_id"), F.col("evidence")).alias("query"), F.array_join(grounding.numeric_hints(F.col("evidence")), " ").alias("hints"))


ORACLE["query_texts"] = WITH + rf""",
plain_ AS (SELECT *, {_plain} AS t, regexp_replace(check_id, '^[^:]*:', '') AS clean FROM found),
measured AS (SELECT *, {', '.join(map(_value, _units))} FROM plain_),
worded AS (SELECT *, list_concat(
    CASE WHEN time_u <> '' THEN [{_quantity(_seconds)}, 'seconds', 'load', 'time', 'speed'] ELSE [] END,
    CASE WHEN size_u = '' THEN [] WHEN {_kb} >= 1024 THEN [{_quantity(_kb + ' / 1024.0::DOUBLE')}, 'mb', 'megabytes', 'page', 'size', 'weight'] ELSE [{_quantity(_kb)}, 'kb', 'kilobytes', 'page', 'size', 'weight'] END,
    CASE WHEN pct_u <> '' THEN [{_quantity('pct_v')}, 'percent', 'percentage', 'ratio'] ELSE [] END,
    CASE regexp_replace(count_u, 's$', '') {_vocabulary} ELSE [] END) AS every FROM measured),
hinted AS (SELECT *, {_ordered('every')}[1:8] AS hints,
    trim(trim(replace(regexp_replace(clean, '^[A-Z][0-9]+[a-z]?_', ''), '_', ' ')) || ' ' || coalesce(CASE regexp_extract(clean, '^([A-Z])[0-9]', 1) {_hint} END, '')) AS topic FROM worded),
based AS (SELECT *, CASE WHEN topic = '' THEN clean ELSE topic END AS base FROM hinted),
asked AS (SELECT *, trim(substr(t, 1, 200) || ' ' || base) AS said FROM based),
fresh AS (SELECT *, list_filter(hints, lambda h: NOT list_contains(regexp_split_to_array(lower(said), '[^a-z0-9.]+'), h)) AS more FROM asked)
SELECT finding_id, CASE WHEN t = '' THEN base WHEN len(more) > 0 THEN said || ' ' || array_to_string(more, ' ') ELSE said END AS query, array_to_string(hints, ' ') AS hints FROM fresh"""


@query
def full_text_topk(spark, folder):
    queries = read(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return grounding.full_text(read(spark, folder, "documents"), queries, 4)


_FTS = f""",
asked_ AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS.format('text')}) AS term FROM benchmark),
posted AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY ALL),
texts AS (SELECT query_id, doc_id, CAST(sum(tf) AS BIGINT) AS score, row_number() OVER (PARTITION BY query_id ORDER BY sum(tf) DESC, doc_id) AS rank FROM posted JOIN asked_ USING (term) GROUP BY query_id, doc_id QUALIFY rank <= 4)"""
ORACLE["full_text_topk"] = WITH + _FTS + " SELECT query_id, rank, doc_id, score FROM texts"
_KIND = "CASE doc_id % 4 WHEN 0 THEN 'rule' WHEN 1 THEN 'ap' WHEN 2 THEN 'principle' ELSE 'playbook' END"


@query
def layered_hits(spark, folder):
    """Vector hits of the first queries, text hits of the kinds and queries that have none."""
    near = read(spark, folder, "embeddings").filter("vec_id % 50 = 0").selectExpr("CAST(vec_id / 50 AS BIGINT) AS query_id", "CASE vec_id % 4 WHEN 0 THEN 'rule' ELSE 'ap' END AS kind", "vec_id AS id", "1 AS rank")
    text = full_text_topk(spark, folder).selectExpr("query_id", f"{_KIND} AS kind", "doc_id AS id", "rank")
    return grounding.layered(near, text)


ORACLE["layered_hits"] = WITH + _FTS + f""",
near AS (SELECT CAST(vec_id / 50 AS BIGINT) AS query_id, CASE vec_id % 4 WHEN 0 THEN 'rule' ELSE 'ap' END AS kind, vec_id AS id, 1 AS rank FROM embeddings WHERE vec_id % 50 = 0),
kinds AS (SELECT query_id, {_KIND} AS kind, doc_id AS id, rank FROM texts)
SELECT query_id, kind, id, 'vector' AS layer, rank FROM near UNION ALL SELECT query_id, kind, id, 'fts' AS layer, rank FROM kinds WHERE (query_id, kind) NOT IN (SELECT query_id, kind FROM near)"""


def _keys(spark):
    return spark.createDataFrame([(k,) for k in KEYS], "key string")


@query
def resolved_checks(spark, folder):
    return grounding.resolve_checks(found(spark, folder).select(F.regexp_replace("check_id", "^[^:]*:", "").alias("check_id")), _keys(spark))


_RESOLVED = f""",
keys AS (SELECT unnest([{', '.join(map(q, KEYS))}]) AS key), ids AS (SELECT DISTINCT regexp_replace(check_id, '^[^:]*:', '') AS check_id FROM found),
resolved AS (SELECT check_id, CASE WHEN check_id IN (SELECT key FROM keys) THEN check_id ELSE coalesce((SELECT key FROM keys WHERE regexp_extract(check_id, '^([A-J][0-9]+)[a-z]?(_|$)', 1) <> ''
  AND starts_with(key, regexp_extract(check_id, '^([A-J][0-9]+)[a-z]?(_|$)', 1) || '_') ORDER BY len(key), key LIMIT 1), check_id) END AS key FROM ids)"""
ORACLE["resolved_checks"] = WITH + _RESOLVED + " SELECT check_id, key FROM resolved"


@query
def curated_topk(spark, folder):
    rows = found(spark, folder)
    asks = rows.selectExpr("finding_id AS query_id", "finding_id % 4 AS key", "CASE WHEN finding_id % 2 = 0 THEN 'blog' END AS page_type", "CASE WHEN finding_id % 3 = 0 THEN 'saas' END AS industry")
    tags = lambda n: f"CASE id % {n} WHEN 0 THEN array() WHEN 1 THEN array('all') WHEN 2 THEN array('blog', 'saas') ELSE array('other') END"
    rows = guidance(spark, folder).withColumns({"page_types": F.expr(tags(4)), "industries": F.expr(tags(5))})
    return grounding.curated(asks, rows.selectExpr("id % 4 AS key", "kind", "id"), rows)


ORACLE["curated_topk"] = WITH + """,
fits AS (SELECT f.finding_id AS query_id, a.* FROM found f JOIN alive a ON a.id % 4 = f.finding_id % 4 WHERE (f.finding_id % 2 <> 0 OR a.id % 4 <> 3) AND (f.finding_id % 3 <> 0 OR a.id % 5 NOT IN (3, 4)))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY tier, confidence DESC, id) AS rank, kind, id FROM fits QUALIFY rank <= 3"""


@query
def batch_retrieval(spark, folder):
    specs = read(spark, folder, "benchmark").selectExpr("item_id AS query_id", "CASE WHEN item_id % 3 = 0 THEN array(item_id * 8, 4, item_id * 8 + 4, 3) END AS rule_ids")
    text = full_text_topk(spark, folder).selectExpr("query_id", "rank", f"{_KIND} AS kind", "doc_id AS id")
    return grounding.retrieve_batch(specs, text, guidance(spark, folder), 3)


ORACLE["batch_retrieval"] = WITH + _FTS + f""",
named AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank, a.kind, a.id FROM (SELECT item_id AS query_id, unnest([item_id * 8, 4, item_id * 8 + 4, 3]) AS id, unnest([1, 2, 3, 4]) AS pos FROM benchmark WHERE item_id % 3 = 0) JOIN alive a USING (id) WHERE a.kind = 'rule')
SELECT * FROM (SELECT query_id, rank, kind, id FROM named UNION ALL SELECT query_id, rank, {_KIND} AS kind, doc_id AS id FROM texts WHERE query_id % 3 <> 0) WHERE rank <= 3"""


@query
def attached_citations(spark, folder):
    rows = guidance(spark, folder).selectExpr(f"CASE id % 8 {' '.join(f'WHEN {k} THEN {q(c)}' for k, c in enumerate(CHECK_IDS))} END AS check_id", "kind", "id", "CASE id % 6 WHEN 0 THEN 'supports' WHEN 1 THEN 'related' WHEN 2 THEN 'contradicts' END AS verdict")
    pool = rows.withColumn("rank", F.expr("row_number() OVER (PARTITION BY check_id ORDER BY id)")).filter("rank <= 30")
    return grounding.attach(found(spark, folder), pool.drop("verdict"), rows.filter("verdict IS NOT NULL"))


ORACLE["attached_citations"] = WITH + f""",
pool AS (SELECT CASE id % 8 {' '.join(f'WHEN {k} THEN {q(c)}' for k, c in enumerate(CHECK_IDS))} END AS check_id, kind, id, CASE id % 6 WHEN 0 THEN 'supports' WHEN 1 THEN 'related' WHEN 2 THEN 'contradicts' END AS verdict, row_number() OVER (PARTITION BY id % 8 ORDER BY id) AS rank FROM guide QUALIFY rank <= 24),
best AS (SELECT check_id, kind, id, verdict, row_number() OVER (PARTITION BY check_id ORDER BY CASE WHEN verdict = 'supports' THEN 0 WHEN verdict = 'related' THEN 1 WHEN verdict IS NULL THEN 2 ELSE 3 END, rank) AS nth FROM pool QUALIFY nth <= 3)
SELECT audit_id, check_id, nth AS rank, kind, id, verdict FROM found JOIN best USING (check_id) WHERE status IN ('fail', 'warn')"""


@query
def regrounded(spark, folder):
    cites = guidance(spark, folder).selectExpr("id AS cite_id", "CASE WHEN id % 3 = 0 THEN kind ELSE 'rule' END AS kind", "CASE WHEN id % 10 = 9 THEN id + 1000000 ELSE id END AS id", "CASE WHEN id % 4 = 1 THEN 'nothing of the sort anywhere' WHEN id % 8 = 2 THEN NULL ELSE substr(body, 1, 80) END AS text")
    return grounding.reground(cites, guidance(spark, folder).select("kind", "id", "body"))


ORACLE["regrounded"] = WITH + f""",
cites AS (SELECT id AS cite_id, CASE WHEN id % 3 = 0 THEN kind ELSE 'rule' END AS kind, CASE WHEN id % 10 = 9 THEN id + 1000000 ELSE id END AS id, CASE WHEN id % 4 = 1 THEN 'nothing of the sort anywhere' WHEN id % 8 = 2 THEN NULL ELSE substr(body, 1, 80) END AS text FROM guide),
met AS (SELECT c.*, g.kind AS held, list_distinct({TOKENS.format('c.text')}) AS x, {TOKENS.format("coalesce(g.body, '')")} AS y FROM cites c LEFT JOIN guide g ON c.id = g.id),
judged AS (SELECT *, held IS NOT NULL AND (held = kind OR coalesce(len(x), 0) > 0) AND (coalesce(len(x), 0) = 0 OR len(list_intersect(x, y)) >= 2 OR len(list_intersect(x, y)) >= 0.34 * len(x)) AS fits FROM met)
SELECT cite_id, CASE WHEN fits THEN held ELSE kind END AS kind, id, CASE WHEN NOT fits THEN 'lost' WHEN held = kind THEN 'kept' ELSE 'recovered' END AS state FROM judged"""


@query
def narrative_references(spark, folder):
    texts = read(spark, folder, "benchmark").selectExpr("item_id AS fix_id", "concat('See rule #', item_id % 90, ', Anti-pattern id: ', item_id + 1, ' and rules (id ', item_id % 90, '); AP #7, principle id=', item_id * 2, ', rule #12, ap #99 ', text) AS text")
    rows = guidance(spark, folder).select("kind", F.col("id").cast("string").alias("id"))
    return grounding.references(texts, rows)


ORACLE["narrative_references"] = WITH + r""",
raw AS (SELECT item_id AS fix_id, list_transform(regexp_extract_all(concat('See rule #', item_id % 90, ', Anti-pattern id: ', item_id + 1, ' and rules (id ', item_id % 90, '); AP #7, principle id=', item_id * 2, ', rule #12, ap #99 ', text),
  '(?i)(rule|principle|anti[-_\s]?pattern|ap)s?\s*(?:\(\s*)?(?:id\s*[:#=]?\s*|#)\s*([0-9]{1,6})'), lambda x: regexp_replace(lower(x), '^(rule|principle)?.*?([0-9]+)$', '\1:\2')) AS refs FROM benchmark),
spread AS (SELECT fix_id, unnest(refs) AS ref, unnest(range(1, len(refs) + 1)) AS pos FROM raw),
once AS (SELECT fix_id, ref, min(pos) AS pos FROM spread GROUP BY ALL),
ranked AS (SELECT fix_id, row_number() OVER (PARTITION BY fix_id ORDER BY pos) - 1 AS nth, CASE WHEN starts_with(ref, ':') THEN 'ap' ELSE split_part(ref, ':', 1) END AS kind, split_part(ref, ':', 2) AS id FROM once QUALIFY nth < 4)
SELECT fix_id, nth, r.kind, r.id, g.id IS NOT NULL AS known FROM ranked r LEFT JOIN guide g ON g.kind = r.kind AND CAST(g.id AS VARCHAR) = r.id"""


@query
def canonical_check_ids(spark, folder):
    variants = ["A1_https", "A1_https_check", "A1_check_page", "B1_speed", "B1_ttfb_median", "C10_social", "E14_llms", "E14", "C10b_open_graph"]
    rows = read(spark, folder, "events").selectExpr("event_id % 300 AS audit_id", "event_id AS ord", f"element_at(array({', '.join(map(q, variants))}), CAST(event_id * 7 % 9 AS INT) + 1) AS check_id")
    canon = spark.createDataFrame([("A1_https_check_enforcement",), ("B1_ttfb_median",), ("C10_open_graph",), ("E14_llms_txt",)], "canonical string")
    aliases = spark.createDataFrame([("C10_social", "C10_open_graph")], "variant string, canonical string")
    named = grounding.canonical_checks(rows, canon, aliases)
    return named.groupBy("check_id", "renamed", "vocab_status").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


ORACLE["canonical_check_ids"] = """WITH rows_ AS (
  SELECT event_id % 300 AS audit_id, event_id AS ord,
         ['A1_https', 'A1_https_check', 'A1_check_page', 'B1_speed', 'B1_ttfb_median', 'C10_social', 'E14_llms', 'E14', 'C10b_open_graph'][CAST(event_id * 7 % 9 AS INT) + 1] AS check_id
  FROM events),
wanted AS (
  SELECT *, CASE check_id WHEN 'A1_https' THEN 'A1_https_check_enforcement' WHEN 'A1_https_check' THEN 'A1_https_check_enforcement' WHEN 'C10_social' THEN 'C10_open_graph' WHEN 'E14_llms' THEN 'E14_llms_txt' END AS w FROM rows_),
placed AS (SELECT *, w IS NOT NULL AND row_number() OVER (PARTITION BY audit_id, w ORDER BY ord) = 1 AS aliased FROM wanted)
SELECT check_id, CASE WHEN aliased THEN w ELSE check_id END AS renamed,
       CASE WHEN check_id = 'B1_ttfb_median' THEN 'canonical' WHEN aliased THEN 'aliased' WHEN check_id <> 'C10b_open_graph' THEN 'foreign' END AS vocab_status,
       count(*) AS n, min(ord) AS first_ord
FROM placed GROUP BY ALL"""


@query
def citation_lines(spark, folder):
    return grounding.citation_line(guidance(spark, folder)).select("kind", "id", F.md5("line").alias("line_md5"))


ORACLE["citation_lines"] = WITH + """ SELECT kind, id, md5('Per ' || coalesce(source_org, 'unknown') || ': ' || coalesce(name, '') || ' [' || CASE kind WHEN 'rule' THEN 'Rule' WHEN 'ap' THEN 'AP' WHEN 'principle' THEN 'Principle' ELSE 'Playbook' END || ' #' || id
  || ', confidence ' || printf('%.2f', confidence) || ']' || CASE WHEN coalesce(source_url, '') <> '' THEN ' <' || source_url || '>' ELSE '' END || CASE WHEN provenance_status = 'verified' AND coalesce(trim(excerpt), '') <> '' THEN ' verified' ELSE '' END) AS line_md5 FROM guide"""


@query
def labels_by_name(spark, folder):
    labels = read(spark, folder, "documents").selectExpr("doc_id AS label_id", "concat(' ', substr(text, 1, 60), '  ') AS name")
    return grounding.first_by_name(labels, guidance(spark, folder))


ORACLE["labels_by_name"] = WITH + r""", keyed AS (SELECT id, lower(trim(regexp_replace(coalesce(name, ''), '\s+', ' ', 'g'))) AS key FROM guide), first AS (SELECT key, min(id) AS id FROM keyed WHERE key <> '' GROUP BY key)
SELECT d.doc_id AS label_id, first.id FROM documents d JOIN first ON first.key = lower(trim(regexp_replace(substr(text, 1, 60), '\s+', ' ', 'g')))"""


def _documents(spark, folder):
    return read(spark, folder, "documents").filter("doc_id < 45").selectExpr("doc_id AS document_id", "concat('https://d.example/', doc_id) AS document_url")


@query
def corpus_sources(spark, folder):
    """Rows with their own URL or their document's."""
    return corpus.with_source(guidance(spark, folder), _documents(spark, folder)).select("id", "url")


@query
def unnested_references(spark, folder):
    return corpus.unnested_references(guidance(spark, folder), _documents(spark, folder))


@query
def sources_beside_rules(spark, folder):
    rows = guidance(spark, folder)
    return corpus.sources_beside(rows.select("source_org").distinct(), rows.filter("kind = 'rule' AND id % 5 > 0"))


@query
def tagged_kinds(spark, folder):
    rows = guidance(spark, folder)
    parts = {k: rows.filter(F.col("kind") == k).drop("kind") for k in grounding.KINDS}
    return corpus.tagged_union(parts, ["id", "tier"]).groupBy("kind", "tier").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


@query
def picked_rows(spark, folder):
    ids = read(spark, folder, "events").selectExpr("event_id * 3 % 5000 AS id")
    return corpus.by_ids(retrieval.trusted(guidance(spark, folder)), ids).select("kind", "id")


@query
def truth_shares(spark, folder):
    return corpus.shares(guidance(spark, folder), "provenance_status")


ORACLE |= {
    "corpus_sources": WITH + " SELECT id, coalesce(nullif(trim(source_url), ''), CASE WHEN document_id < 45 AND document_id IN (SELECT doc_id FROM documents) THEN 'https://d.example/' || document_id END) AS url FROM guide",
    "unnested_references": WITH + ", spread AS (SELECT id, unnest(CAST(json_extract(refs, '$[*]') AS BIGINT[])) AS document_id, unnest(range(len(json_extract(refs, '$[*]')))) AS nth FROM guide WHERE refs IS NOT NULL) SELECT id, nth, document_id, CASE WHEN document_id < 45 THEN 'https://d.example/' || document_id END AS document_url FROM spread",
    "sources_beside_rules": WITH + " SELECT source_org, count(*) FILTER (WHERE kind = 'rule' AND id % 5 > 0 AND source_org IS NOT NULL) AS n_rules FROM guide GROUP BY source_org",
    "tagged_kinds": WITH + " SELECT kind, tier, count(*) AS n, max(id) AS last_id FROM guide GROUP BY ALL",
    "picked_rows": WITH + " SELECT kind, id FROM alive WHERE id IN (SELECT event_id * 3 % 5000 FROM events)",
    "truth_shares": WITH + f" SELECT provenance_status, count(*) AS n, {r('count(*) * 100.0::DOUBLE / (SELECT count(*) FROM guide)')} AS pct FROM guide GROUP BY provenance_status",
}


@query
def source_modes(spark, folder):
    rows = read(spark, folder, "events").selectExpr("event_id % 500 AS audit_id", "CASE WHEN event_id % 500 % 4 = 0 THEN 'vector' WHEN event_id % 500 % 4 = 1 THEN 'snapshot' WHEN event_id % 500 % 4 = 2 THEN CASE WHEN event_id % 2 = 0 THEN 'fts' ELSE 'snapshot' END END AS layer")
    return corpus.source_mode(rows)


ORACLE["source_modes"] = """WITH l AS (SELECT event_id % 500 AS audit_id, CASE WHEN event_id % 500 % 4 = 0 THEN 'vector' WHEN event_id % 500 % 4 = 1 THEN 'snapshot' WHEN event_id % 500 % 4 = 2 THEN CASE WHEN event_id % 2 = 0 THEN 'fts' ELSE 'snapshot' END END AS layer FROM events)
SELECT audit_id, CASE WHEN count(*) FILTER (WHERE layer IN ('vector', 'fts')) > 0 AND count(*) FILTER (WHERE layer = 'snapshot') > 0 THEN 'mixed' WHEN count(*) FILTER (WHERE layer IN ('vector', 'fts')) > 0 THEN 'live' WHEN count(*) FILTER (WHERE layer = 'snapshot') > 0 THEN 'snapshot' ELSE 'none' END AS mode FROM l GROUP BY audit_id"""


@query
def best_verdicts(spark, folder):
    rows = read(spark, folder, "events").selectExpr("user_id % 6 AS tier", "event_id % 97 AS id", "CASE event_id % 3 WHEN 0 THEN 'supports' WHEN 1 THEN 'related' ELSE 'unjudged' END AS verdict")
    return corpus.best_of(rows)


ORACLE["best_verdicts"] = """WITH once AS (SELECT user_id % 6 AS tier, event_id % 97 AS id, min(event_id % 3) AS v FROM events GROUP BY ALL)
SELECT tier, row_number() OVER (PARTITION BY tier ORDER BY v, id) AS nth, id, ['supports', 'related', 'unjudged'][CAST(v + 1 AS INT)] AS verdict FROM once QUALIFY nth <= 10"""


@query
def evicted_jobs(spark, folder):
    rows = read(spark, folder, "events").selectExpr("event_id AS job_id", "event_type AS profile", "CASE event_id % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'error' ELSE 'completed' END AS state", "ts AS ended")
    return corpus.evict_finished(rows, 50).groupBy("profile", "state").agg(F.count("*").alias("n"), F.min("job_id").alias("first_job"))


ORACLE["evicted_jobs"] = """WITH j AS (SELECT event_id AS job_id, event_type AS profile, CASE event_id % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'error' ELSE 'completed' END AS state, ts AS ended FROM events),
placed AS (SELECT *, row_number() OVER (PARTITION BY profile, state <> 'running' ORDER BY ended DESC, job_id DESC) AS nth FROM j) SELECT profile, state, count(*) AS n, min(job_id) AS first_job FROM placed WHERE state = 'running' OR nth <= 50 GROUP BY ALL"""


@query
def admitted_jobs(spark, folder):
    rows = read(spark, folder, "events").select(F.col("event_id").alias("job_id"), F.col("event_type").alias("profile"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("started"))
    rows = store.running_jobs(rows.withColumn("ended", F.col("started") + F.col("job_id") % 7200 + 60))
    return corpus.admitted(rows, {"click": 3, "view": 8, "purchase": 1}).groupBy("profile").agg(F.count("*").alias("n"), F.count_if("admitted").alias("admitted"))


_running = ORACLE["concurrent_jobs"].split(" SELECT profile, CAST(max(running)")[0]
ORACLE["admitted_jobs"] = _running + " SELECT profile, count(*) AS n, count(*) FILTER (WHERE coalesce(running <= CASE profile WHEN 'click' THEN 3 WHEN 'view' THEN 8 WHEN 'purchase' THEN 1 END, true)) AS admitted FROM running WHERE step = 1 GROUP BY profile"


@query
def rule_key_pairs(spark, folder):
    return corpus.rule_key_edges(guidance(spark, folder))


ORACLE["rule_key_pairs"] = WITH + """, keyed AS (SELECT * FROM guide WHERE coalesce(trim(rule_key), '') <> ''), least_ AS (SELECT block, rule_key, min(id) AS a FROM keyed GROUP BY ALL)
SELECT k.block, l.a, k.id AS b FROM keyed k JOIN least_ l ON k.block IS NOT DISTINCT FROM l.block AND k.rule_key = l.rule_key AND l.a < k.id"""


@query
def plan_order(spark, folder):
    """The largest groups of rows of one key."""
    rows = guidance(spark, folder).filter("rule_key LIKE 'k%'").selectExpr("CAST(substr(rule_key, 2) AS BIGINT) AS root", "id", "row_number() OVER (PARTITION BY rule_key ORDER BY tier, id) = 1 AS canonical")
    return corpus.plan_by_size(rows, 4)


ORACLE["plan_order"] = WITH + " SELECT CAST(substr(rule_key, 2) AS BIGINT) AS root, count(*) AS n, arg_min(id, tier * 1000000000 + id) AS head FROM guide WHERE rule_key LIKE 'k%' GROUP BY rule_key ORDER BY n DESC, root LIMIT 4"


@query
def observed_findings(spark, folder):
    rows = found(spark, folder)
    results = rows.selectExpr("audit_id", "CASE WHEN finding_id % 8 = 1 THEN 'B1_ttfb' ELSE check_id END AS check", "finding_id * 2 AS value").groupBy("audit_id", "check").agg(F.max("value").alias("value"))
    return corpus.observed(rows, results.filter("value % 3 <> 0")).select("finding_id", "value")


ORACLE["observed_findings"] = WITH + """, results AS (SELECT audit_id, CASE WHEN finding_id % 8 = 1 THEN 'B1_ttfb' ELSE check_id END AS check_, max(finding_id * 2) AS value FROM found GROUP BY ALL HAVING max(finding_id * 2) % 3 <> 0)
SELECT finding_id, value FROM found f LEFT JOIN results r ON f.audit_id = r.audit_id AND r.check_ = regexp_replace(f.check_id, '^[^:]*:', '')"""


@query
def finding_fixes(spark, folder):
    rows = found(spark, folder).selectExpr("finding_id", "CASE WHEN finding_id % 2 = 0 THEN concat('n', finding_id % 9) ELSE check_id END AS check_id", "concat('o', finding_id % 6) AS original_id")
    fixes = spark.createDataFrame([("n2", "a"), ("n4", "b"), ("o1", "c"), ("o4", "d"), ("A2_title_tag", "e")], "check_id string, fix string")
    return corpus.with_fix(rows, fixes).select("finding_id", "fix")


ORACLE["finding_fixes"] = WITH + """, fixes AS (SELECT * FROM (VALUES ('n2', 'a'), ('n4', 'b'), ('o1', 'c'), ('o4', 'd'), ('A2_title_tag', 'e')) t(id, fix)),
named AS (SELECT finding_id, CASE WHEN finding_id % 2 = 0 THEN 'n' || (finding_id % 9) ELSE check_id END AS now, 'o' || (finding_id % 6) AS was FROM found)
SELECT finding_id, coalesce(a.fix, b.fix) AS fix FROM named LEFT JOIN fixes a ON a.id = now LEFT JOIN fixes b ON b.id = was"""


@query
def merged_citations(spark, folder):
    text = full_text_topk(spark, folder).selectExpr("query_id", f"{_KIND} AS kind", "doc_id AS id", "rank")
    first = curated_topk(spark, folder).join(text.select("query_id").distinct(), "query_id", "left_semi")
    return retrieval.merge_citations(first, text, 4)


ORACLE["merged_citations"] = WITH + _FTS + f""",
fits AS (SELECT f.finding_id AS query_id, a.* FROM found f JOIN alive a ON a.id % 4 = f.finding_id % 4 WHERE (f.finding_id % 2 <> 0 OR a.id % 4 <> 3) AND (f.finding_id % 3 <> 0 OR a.id % 5 NOT IN (3, 4))),
cur AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY tier, confidence DESC, id) AS rank, kind, id FROM fits QUALIFY rank <= 3),
both_ AS (SELECT query_id, kind, id, rank FROM cur WHERE query_id IN (SELECT query_id FROM texts) UNION ALL SELECT query_id, {_KIND} AS kind, doc_id AS id, 1000 + rank AS rank FROM texts),
once AS (SELECT query_id, kind, id, min(rank) AS pos FROM both_ GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos, kind, id) AS rank, kind, id FROM once QUALIFY rank <= 4"""


@query
def run_comparison(spark, folder):
    """Two runs of the same audits, of which the second lacks and changes some checks."""
    before = once(findings(spark, folder).select("audit_id", "check_id", "status"))
    after = before.withColumn("status", F.when(F.col("audit_id") % 9 == 0, "warn").otherwise(F.col("status"))).filter("audit_id % 13 <> 0")
    return scoring.compare_runs(before, after)


ORACLE["run_comparison"] = "WITH " + SCORES + """ SELECT check_id, count(*) FILTER (WHERE page_id % 13 <> 0 AND (page_id % 9 <> 0 OR status = 'warn')) AS n_same, count(*) FILTER (WHERE page_id % 13 <> 0 AND page_id % 9 = 0 AND status <> 'warn') AS n_flipped,
  CAST(0 AS BIGINT) AS n_new, count(*) FILTER (WHERE page_id % 13 = 0) AS n_gone FROM findings GROUP BY check_id"""


@query
def gate_states(spark, folder):
    rows = read(spark, folder, "pages").selectExpr(
        "page_id AS audit_id", "CASE WHEN page_id % 6 > 0 THEN url END AS final_url", "CASE WHEN page_id % 5 > 0 THEN CAST(page_id * 7 % 900 AS INT) END AS words", "element_at(array('fully_accessible', 'bot_blocked', 'fetch_failed', 'partial_ssr'), CAST(page_id % 4 + 1 AS INT)) AS ssr_class",
        "CASE page_id % 3 WHEN 0 THEN array(true, NULL) WHEN 1 THEN array(true, false) ELSE array(CAST(NULL AS BOOLEAN)) END AS bots", "CASE page_id % 4 WHEN 0 THEN array(200, 403) WHEN 1 THEN array(200) ELSE array(CAST(NULL AS INT)) END AS probes",
        "CASE WHEN page_id % 8 > 2 THEN CAST(200 + page_id % 3 * 100 AS INT) END AS default_code", "'service' AS page_type", "'high' AS confidence", "CASE WHEN page_id % 10 = 0 THEN 'fail' END AS page_existence",
    )
    return corpus.gates(rows).drop("page_type", "confidence")


ORACLE["gate_states"] = """SELECT page_id AS audit_id, CASE page_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS ai_bot_allowed, CASE WHEN page_id % 5 > 0 THEN page_id * 7 % 900 >= 300 END AS server_rendered,
  CASE WHEN page_id % 4 = 0 THEN false WHEN page_id % 4 = 1 THEN true WHEN page_id % 8 > 2 THEN page_id % 3 = 0 END AS reachable_200, CASE WHEN page_id % 6 > 0 THEN starts_with(lower(url), 'https://') END AS https,
  page_id % 4 IN (1, 2) OR page_id % 10 = 0 AS unreached FROM pages"""


@query
def final_scores(spark, folder):
    scores = audits(spark, folder).select("audit_id", F.col("score").alias("pcr"), "grade")
    gone = read(spark, folder, "pages").selectExpr("page_id AS audit_id", "page_id % 9 = 4 AS unreached").filter("audit_id % 2 = 0 OR unreached")
    return corpus.finalised(scores, gone)


ORACLE["final_scores"] = f"WITH {AUDITS} SELECT audit_id, CASE WHEN audit_id % 9 <> 4 AND score IS NOT NULL THEN greatest(least(score, 100.0), 0.0) END AS pcr, CASE WHEN audit_id % 9 = 4 THEN 'INCONCLUSIVE' ELSE grade END AS grade FROM audits"


@query
def light_gate_states(spark, folder):
    """Gates of the pages from what was fetched of them and of their hosts' robots files."""
    seen = features(spark, folder).select("page_id", "host", "words", "status")
    files = seen.select("host").distinct().selectExpr("host", "CASE length(host) % 6 WHEN 0 THEN 503 WHEN 1 THEN 404 WHEN 2 THEN 0 ELSE 200 END AS robots_code")
    rendering = crawl.rendering_class(F.when(F.col("page_id") % 19 == 3, 403).when(F.col("page_id") % 23 == 4, 301).otherwise(F.col("status")), F.col("page_id") % 7 == 0, F.col("words"), F.array().cast("array<string>"))
    rows = seen.select("page_id", "host", rendering.alias("rendering"), (F.col("page_id") % 31 == 5).alias("bot_blocking"))
    return corpus.light_gates(rows.join(files, "host"))


ORACLE["light_gate_states"] = f"""WITH {FEATURES},
seen AS (
  SELECT page_id, words, CASE WHEN page_id % 19 = 3 THEN 403 WHEN page_id % 23 = 4 THEN 301 ELSE status END AS code,
         CASE length(host) % 6 WHEN 0 THEN 503 WHEN 1 THEN 404 WHEN 2 THEN 0 ELSE 200 END AS robots
  FROM feats)
SELECT page_id,
       CASE WHEN code IN (401, 403, 429) OR page_id % 31 = 5 OR robots = 503 THEN 'fail' WHEN robots <> 200 THEN 'warn' ELSE 'pass' END AS crawlability,
       CASE WHEN code NOT BETWEEN 1 AND 299 OR page_id % 7 = 0 THEN 'fail' WHEN words >= 500 THEN 'pass' ELSE 'warn' END AS content_access,
       CASE WHEN code NOT BETWEEN 1 AND 299 AND code NOT IN (401, 403, 429) THEN 'fail' ELSE 'pass' END AS page_existence
FROM seen"""


@query
def page_kinds(spark, folder):
    types = "CASE page_id % 6 WHEN 0 THEN array('article') WHEN 1 THEN array('product') WHEN 2 THEN array('localbusiness') WHEN 3 THEN array('softwareapplication') ELSE array() END"
    url = "CASE page_id % 12 WHEN 4 THEN 'https://x.example/' WHEN 5 THEN 'https://x.example/shop/1' WHEN 10 THEN 'https://x.example/blog/1' ELSE url END"
    rows = read(spark, folder, "pages").selectExpr("page_id", f"CAST({types} AS array<string>) AS types", f"{url} AS url")
    return rows.select("page_id", corpus.page_kind(F.col("types"), F.col("url")).alias("kind"))


ORACLE["page_kinds"] = """SELECT page_id, CASE WHEN page_id % 6 = 0 OR page_id % 12 = 10 THEN 'blog' WHEN page_id % 6 = 1 OR page_id % 12 = 5 THEN 'product' WHEN page_id % 6 = 2 THEN 'local_business' WHEN page_id % 6 = 3 THEN 'software_application'
  WHEN page_id % 12 = 4 THEN 'homepage' ELSE 'service' END AS kind FROM pages"""


@query
def authority_tiers(spark, folder):
    rows = read(spark, folder, "events").selectExpr("event_id", "CASE WHEN event_id % 4 > 0 THEN event_id % 4 > 1 END AS verified", "CASE WHEN event_id % 3 > 0 THEN value END AS metric", "event_id % 5 AS samples", "event_id % 400 AS age")
    tier = corpus.authority_tier(F.col("verified"), F.col("metric"), F.col("samples"), F.col("age"))
    return rows.select(tier.alias("tier"), "samples").groupBy("tier", "samples").agg(F.count("*").alias("n"))


ORACLE["authority_tiers"] = """WITH e AS (SELECT event_id % 4 > 1 AS ok, event_id % 3 > 0 AND value IS NOT NULL AS has, event_id % 5 AS samples, event_id % 400 <= 180 AS fresh FROM events)
SELECT CASE WHEN ok AND has AND samples > 0 AND fresh THEN 'HIGH' WHEN ok AND (has OR samples > 0) THEN 'MID' ELSE 'LOW' END AS tier, samples, count(*) AS n FROM e GROUP BY ALL"""


@query
def fix_priorities(spark, folder):
    rows = read(spark, folder, "events").selectExpr("element_at(array('critical', 'high', 'medium', 'low'), CAST(event_id % 4 + 1 AS INT)) AS impact", "element_at(array('trivial', 'easy', 'moderate', 'complex', 'none'), CAST(user_id % 5 + 1 AS INT)) AS effort")
    return rows.select("impact", "effort", corpus.priority(F.col("impact"), F.col("effort")).alias("priority")).groupBy("impact", "effort", "priority").agg(F.count("*").alias("n"))


ORACLE["fix_priorities"] = """WITH m AS (SELECT ['critical', 'high', 'medium', 'low'][CAST(event_id % 4 + 1 AS INT)] AS impact, ['trivial', 'easy', 'moderate', 'complex', 'none'][CAST(user_id % 5 + 1 AS INT)] AS effort FROM events)
SELECT impact, effort, CASE impact || effort WHEN 'criticalcomplex' THEN 'PLAN NOW' WHEN 'highmoderate' THEN 'PLAN' WHEN 'highcomplex' THEN 'PLAN' WHEN 'mediumeasy' THEN 'PLAN' WHEN 'mediummoderate' THEN 'LATER' WHEN 'mediumcomplex' THEN 'SKIP' WHEN 'lowtrivial' THEN 'OPTIONAL'
  WHEN 'loweasy' THEN 'OPTIONAL' WHEN 'lowmoderate' THEN 'SKIP' WHEN 'lowcomplex' THEN 'SKIP' ELSE CASE WHEN effort <> 'none' THEN 'DO NOW' END END AS priority, count(*) AS n FROM m GROUP BY ALL"""
