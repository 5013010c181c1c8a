"""The same queries in DuckDB's SQL, written apart from the DataFrame code."""

from __future__ import annotations

from lodestone.operators.checks import CHECKS, LIGHT
from lodestone.operators.retrieval import STOP, TIERS
from lodestone.operators.scoring import BRAND_GROUPS, FACTORS, GRADES, MEASURED, PAGE_WEIGHTS, SECTIONS
from lodestone.plans.oracle_pages import FEATURES, GENERIC, HOST, q, squeeze


def r(x: str, digits: int = 1) -> str:
    return f"CAST(printf('%.{digits}f', CAST({x} AS DOUBLE)) AS DOUBLE)"


def verdict(check) -> str:
    return f"CASE WHEN coalesce(status BETWEEN 1 AND 299, true) THEN {check.status.replace(' div ', ' // ')} ELSE 'na' END"


CHECK_ROWS = " UNION ALL ".join(
    f"SELECT page_id, host, {k} AS ord, {q(c.id)} AS check_id, {q(c.id[0])} AS section, {verdict(c)} AS status, {q(c.severity)} AS severity FROM feats"
    for k, c in enumerate(CHECKS)
)
FINDINGS = FEATURES + f",\nfindings AS ({CHECK_ROWS})"
BASE = "regexp_extract({0}, '^([A-J][0-9]{{1,2}}[a-z]?)(_|$)', 1)"
IS_MEASURED = f"{BASE.format('check_id')} IN ({', '.join(map(q, MEASURED))})"
POINTS = "CASE status WHEN 'pass' THEN 2 WHEN 'warn' THEN 1 WHEN 'fail' THEN 0 END"


def mean(points: str, n: str) -> str:
    return r(f"({points} / 2.0::DOUBLE / nullif({n}, 0) * 100)")


def weighted(scores: dict[str, str], weights: dict[str, float]) -> str:
    top = " + ".join(f"coalesce({scores[k]} * {w}::DOUBLE, 0.0::DOUBLE)" for k, w in weights.items())
    low = " + ".join(f"CASE WHEN {scores[k]} IS NULL THEN 0.0::DOUBLE ELSE {w}::DOUBLE END" for k, w in weights.items())
    return f"(0.0::DOUBLE + {top}) / nullif(0.0::DOUBLE + {low}, 0.0::DOUBLE)"


def grade(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'INCONCLUSIVE' " + " ".join(f"WHEN greatest(least({x}, 100), 0) >= {least} THEN {q(name)}" for least, name in GRADES) + " END"


_sums = ", ".join(
    f"sum({POINTS}) FILTER (WHERE section = '{s}'{extra}) AS {name}points_{s}, count({POINTS}) FILTER (WHERE section = '{s}'{extra}) AS {name}n_{s}"
    for s in SECTIONS
    for name, extra in (("", ""), ("shadow_", f" AND {IS_MEASURED}"))
)
_scores = ", ".join(f"{mean(f'{name}points_{s}', f'{name}n_{s}')} AS {name}score_{s}" for s in SECTIONS for name in ("", "shadow_"))
SCORES = (
    FINDINGS
    + f""",
sums AS (SELECT page_id AS audit_id, any_value(host) AS host, {_sums}, count(*) FILTER (WHERE status = 'fail') AS n_fail, count(*) FILTER (WHERE status = 'warn') AS n_warn,
  count({POINTS}) FILTER (WHERE section IN ({', '.join(map(q, PAGE_WEIGHTS))})) AS findings_total,
  count({POINTS}) FILTER (WHERE section IN ({', '.join(map(q, PAGE_WEIGHTS))}) AND {IS_MEASURED}) AS findings_backed FROM findings GROUP BY page_id),
parts AS (SELECT *, {_scores} FROM sums),
scored AS (SELECT *, {r(weighted({s: f'score_{s}' for s in SECTIONS}, PAGE_WEIGHTS))} AS pcr, {r(weighted({s: f'shadow_score_{s}' for s in SECTIONS}, PAGE_WEIGHTS))} AS shadow FROM parts)"""
)
GEO = """geo AS (
  SELECT page_id AS audit_id, k AS ord, 'I' || k AS check_id, ['pass', 'warn', 'fail', 'na', 'pass'][CAST((page_id * 7 + k * 3) % 5 + 1 AS INT)] AS status
  FROM pages, (SELECT unnest(range(1, 9)) AS k))"""
_groups = ", ".join(
    f"sum({POINTS}) FILTER (WHERE check_id IN ({', '.join(map(q, ids))})) AS p_{g}, count({POINTS}) FILTER (WHERE check_id IN ({', '.join(map(q, ids))})) AS n_{g}, "
    f"count(*) FILTER (WHERE check_id IN ({', '.join(map(q, ids))})) AS seen_{g}"
    for g, (ids, _) in BRAND_GROUPS.items()
)
_seen = " + ".join(f"CASE WHEN n_{g} > 0 THEN seen_{g} ELSE 0 END" for g in BRAND_GROUPS)
_bap = r(weighted({g: f"(p_{g} / 2.0::DOUBLE / nullif(n_{g}, 0) * 100)" for g in BRAND_GROUPS}, {g: w for g, (_, w) in BRAND_GROUPS.items()}))
BAP = GEO + f""",
bap AS (SELECT audit_id, bap, CASE WHEN bap IS NULL THEN 'none' WHEN seen < 3 THEN 'low' WHEN seen < 6 THEN 'medium' ELSE 'high' END AS bap_confidence
  FROM (SELECT audit_id, {_bap} AS bap, {_seen} AS seen FROM (SELECT audit_id, {_groups} FROM geo GROUP BY audit_id)))"""
AUDITS = SCORES + f",\naudits AS (SELECT audit_id, host AS domain, pcr AS score, {grade('pcr')} AS grade FROM scored)"

TOKENS = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda t: len(t) >= 3 AND t NOT IN (" + ", ".join(map(q, STOP)) + "))"
NAME_TOKENS = "list_sort(list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda t: t NOT IN (" + ", ".join(map(q, STOP)) + "))))"


def bm25(k: int) -> str:
    return f"""
bags AS (SELECT doc_id, {TOKENS.format("text")} AS bag FROM documents),
totals AS (SELECT count(*) AS docs, avg(len(bag)) AS mean FROM bags),
asked AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS.format("text")}) AS term FROM benchmark),
postings AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(bag) AS n, unnest(bag) AS term FROM bags) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
scores AS (
  SELECT query_id, doc_id, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))), 4) AS score
  FROM postings JOIN df USING (term) JOIN asked USING (term), totals GROUP BY query_id, doc_id),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score >= 2.0 QUALIFY rank <= {k})"""


def vectors(every: int, k: int, floor: float) -> str:
    return f"""
near AS (
  SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(v.embedding, lambda x: CAST(x AS DOUBLE))), 6) AS relevance
  FROM embeddings q JOIN embeddings v ON q.vec_id % {every} = 0 AND q.vec_id <> v.vec_id),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, vec_id) AS rank FROM near WHERE relevance >= {floor} QUALIFY rank <= {k})"""


CORPUS = """corpus AS (
  SELECT doc_id AS id, lang AS block, coalesce(lower(text), '') AS name, source AS source_org, CASE WHEN doc_id % 3 = 0 THEN 'https://x.example/a/b' END AS source_url,
    CASE WHEN doc_id % 2 = 0 THEN 'extracted' END AS provenance, printf('2026-%02d-01', CAST(doc_id % 12 + 1 AS INT)) AS last_verified, (doc_id % 10) / 10.0::DOUBLE AS confidence,
    CASE WHEN doc_id % 7 = 0 THEN 'retired' ELSE 'active' END AS status FROM documents)"""
def pairs(rows: str) -> str:
    return CORPUS + f""",
bags AS (SELECT id, block, {NAME_TOKENS.format("name")} AS bag FROM corpus{rows}),
sets AS (SELECT block, bag, min(id) AS id FROM bags WHERE len(bag) > 0 GROUP BY block, bag),
spread AS (SELECT id, block, unnest(bag) AS token, len(bag) AS n FROM sets),
shared AS (SELECT x.block, x.id AS a, y.id AS b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS k FROM spread x JOIN spread y ON x.block IS NOT DISTINCT FROM y.block AND x.token = y.token AND x.id < y.id GROUP BY ALL),
pairs AS (
  SELECT block, a, b, round(k / CAST(n + m - k AS DOUBLE), 6) AS jaccard FROM shared WHERE k / CAST(n + m - k AS DOUBLE) >= 0.6
  UNION ALL SELECT g.block, s.id AS a, g.id AS b, 1.0::DOUBLE AS jaccard FROM bags g JOIN sets s ON g.block IS NOT DISTINCT FROM s.block AND g.bag = s.bag AND s.id < g.id)"""


def roots(rows: str) -> str:
    return "RECURSIVE " + pairs(rows) + """,
linked AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(id, seen) AS (SELECT a, a FROM linked UNION SELECT r.id, e.b FROM reach r JOIN linked e ON r.seen = e.a),
roots AS (SELECT id, min(seen) AS root FROM reach GROUP BY id)"""


def tier(org: str, live: bool) -> str:
    name = f"regexp_replace(lower(trim({org})), '^www\\.', '')"
    rows = " ".join(f"WHEN {name} IN ({', '.join(q(n.lower()) for n in names)}) THEN {band}" for band, names in TIERS.items())
    return f"CASE {rows} " + (f"WHEN regexp_matches(trim({org}), '^[a-z0-9-]+(\\.[a-z0-9-]+)+$') THEN 4 " if live else "") + "ELSE 5 END"


ELECTED = roots(" WHERE status = 'active'") + f""",
elected AS (
  SELECT root, id, row_number() OVER (PARTITION BY root ORDER BY {tier('source_org', False)}, source_url IS NULL, provenance IS NULL, last_verified DESC, -confidence, id) AS nth
  FROM corpus JOIN roots USING (id))"""

_factor = "CASE " + " ".join(f"WHEN base IN ({', '.join(map(q, b))}) THEN {q(f)}" for f, (b, _) in FACTORS.items()) + " END"
_fractions = ", ".join(f"sum({POINTS}) FILTER (WHERE factor = {q(f)}) / 2.0::DOUBLE / nullif(count({POINTS}) FILTER (WHERE factor = {q(f)}), 0) AS {f}" for f in FACTORS)
_cite = weighted({f: f for f in FACTORS}, {f: float(w) for f, (_, w) in FACTORS.items()})
_engines = "CASE WHEN user_id % 2 = 0 THEN 'anthropic' ELSE 'openai' END"
URL_KEY = r"regexp_replace(lower(regexp_extract(u, '^([^/]*//[^/]*)?', 0)) || regexp_replace(u, '^[^/]*//[^/]*', ''), '/+$', '')"

ORACLE = {
    "page_features": f"WITH {FEATURES} SELECT page_id, host, is_https, title, n_title, n_h1, first_h1, lang, words, n_links, n_internal, n_chrome_links, n_generic, n_li, n_article, has_byline, md5(text) AS text_md5 FROM feats",
    "page_checks_long": f"WITH {FINDINGS} SELECT page_id, ord, check_id, section, status, severity FROM findings",
    "light_checks_long": f"WITH {FEATURES} " + " UNION ALL ".join(f"SELECT page_id, {q(c.id)} AS check_id, {verdict(c)} AS status FROM feats" for c in LIGHT),
    "page_signals": f"WITH {FEATURES} SELECT page_id, array_to_string(directives, ';') AS directives, canonical, canonical_self, n_nested_h1, n_skipped, n_faq_visible, faq_method, n_faq_schema, n_faq_matched, n_entities, n_without_id, n_people, n_credentialed, array_to_string(authors, ';') AS authors, n_local, n_local_geo, city_key, city_in_title, n_locales, n_schema_prices, n_fresh, n_stale, n_profiles, n_disguised, has_about, has_contact, has_policy, n_schema_authors FROM feats",
    "section_status_counts": f"WITH {FINDINGS} SELECT page_id AS audit_id, section, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS n_{s}" for s in ("pass", "warn", "fail", "na")) + " FROM findings GROUP BY page_id, section",
    "section_scores": f"WITH {SCORES} " + " UNION ALL ".join(f"SELECT audit_id, '{s}' AS section, score_{s} AS score FROM scored" for s in SECTIONS),
    "audit_scorecard": f"WITH {SCORES}, {BAP} SELECT audit_id, host, pcr, {grade('pcr')} AS grade, n_fail, n_warn, bap, bap_confidence, {r('pcr * 0.8::DOUBLE + coalesce(bap, pcr) * 0.2::DOUBLE')} AS combined FROM scored LEFT JOIN bap USING (audit_id)",
    "shadow_scores": f"WITH {SCORES} SELECT audit_id, pcr, shadow, {grade('shadow')} AS shadow_grade, {r('shadow - pcr')} AS shadow_delta, findings_total, findings_backed FROM scored",
    "bap_scores": f"WITH {BAP} SELECT * FROM bap",
    "cite_readiness": f"""WITH {FINDINGS},
named AS (SELECT page_id AS audit_id, status, CASE check_id WHEN 'D1_structured_data' THEN 'D9' WHEN 'F6b_question_headings' THEN 'F6' ELSE {BASE.format('check_id')} END AS base FROM findings),
per AS (SELECT audit_id, {_fractions} FROM (SELECT *, {_factor} AS factor FROM named) GROUP BY audit_id),
gated AS (SELECT page_id AS audit_id, CASE WHEN page_id % 5 <> 0 THEN page_id % 7 <> 0 END AS bots, words >= 300 AS rendered, is_https FROM feats),
listed AS (SELECT *, concat_ws(',', CASE WHEN bots = false THEN 'ai_bot_allowed' END, CASE WHEN NOT is_https THEN 'https' END, CASE WHEN NOT rendered THEN 'server_rendered' END) AS failed_gates FROM gated)
SELECT audit_id, CASE WHEN audit_id % 11 = 0 THEN NULL WHEN failed_gates <> '' THEN 0.0 WHEN {_cite} IS NULL THEN NULL ELSE {r(f'greatest(least({_cite} * 100, 100), 0)')} END AS cite_score, failed_gates,
  CASE WHEN audit_id % 3 = 0 THEN 'local_service' ELSE 'product' END AS business_type, CASE WHEN audit_id % 3 = 0 THEN 1.0 ELSE 0.4 END AS own_site_weight FROM listed LEFT JOIN per USING (audit_id)""",
    "legacy_composites": f"WITH {SCORES} SELECT audit_id, {r(weighted({s: f'score_{s}' for s in 'ABCD'}, {'A': .3, 'B': .2, 'C': .25, 'D': .25}))} AS seo_score, {r(weighted({s: f'score_{s}' for s in 'EFGH'}, {'E': .3, 'F': .3, 'G': .2, 'H': .2}))} AS aeo_score, {r(weighted({s: f'score_{s}' for s in 'FEDG'}, {'F': .35, 'E': .25, 'D': .25, 'G': .15}))} AS citation_readiness FROM scored",
    "latest_audit_per_domain": f"WITH {AUDITS} SELECT domain, audit_id, score, grade FROM audits QUALIFY row_number() OVER (PARTITION BY domain ORDER BY audit_id DESC) = 1",
    "audit_history": f"WITH {AUDITS}, aged AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY audit_id DESC) AS age, lag(score) OVER (PARTITION BY domain ORDER BY audit_id) AS score_before FROM audits) SELECT domain, age, audit_id, score, score_before FROM aged WHERE age <= 5",
    "audit_delta": f"""WITH {FINDINGS},
pairs AS (SELECT page_id AS audit_id, lag(page_id) OVER (PARTITION BY host ORDER BY page_id) AS prior_id FROM feats),
joined AS (SELECT p.audit_id, p.prior_id, a.status AS now, b.status AS was FROM pairs p JOIN findings a ON a.page_id = p.audit_id JOIN findings b ON b.page_id = p.prior_id AND b.check_id = a.check_id),
named AS (SELECT audit_id, prior_id, CASE WHEN was IN ('fail', 'warn') AND now NOT IN ('fail', 'warn') THEN 'resolved' WHEN was NOT IN ('fail', 'warn') AND now IN ('fail', 'warn') THEN 'regressed' WHEN was IN ('fail', 'warn') THEN 'persisting' END AS change FROM joined)
SELECT audit_id, prior_id, count(*) FILTER (WHERE change = 'resolved') AS n_resolved, count(*) FILTER (WHERE change = 'regressed') AS n_regressed, CAST(0 AS BIGINT) AS n_new, count(*) FILTER (WHERE change = 'persisting') AS n_persisting FROM named WHERE change IS NOT NULL GROUP BY audit_id, prior_id""",
    "top_issues": f"WITH {FINDINGS} SELECT page_id AS audit_id, row_number() OVER (PARTITION BY page_id ORDER BY status = 'warn', CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, ord) AS rank, check_id, status, severity FROM findings WHERE status IN ('fail', 'warn') QUALIFY rank <= 5",
    "severity_histogram": f"WITH {FINDINGS} SELECT page_id AS audit_id, count(*) FILTER (WHERE severity = 'high') AS n_high, count(*) FILTER (WHERE severity = 'medium') AS n_medium, count(*) FILTER (WHERE severity = 'low') AS n_low FROM findings WHERE status IN ('fail', 'warn') GROUP BY page_id",
    "check_summary": f"WITH {FINDINGS} SELECT check_id, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS n_{s}" for s in ("pass", "warn", "fail", "na")) + f", CASE WHEN {IS_MEASURED} THEN 'measured' ELSE 'llm-judged' END AS tier FROM findings GROUP BY check_id",
    "anchor_text_generic": f"WITH {FEATURES}, spread AS (SELECT unnest(anchors) AS anchor FROM feats) SELECT anchor, count(*) AS n FROM spread WHERE anchor IN ({GENERIC}) GROUP BY anchor",
    "same_title_groups": f"WITH {FEATURES} SELECT title, count(*) AS n, min(page_id) AS first_page FROM feats WHERE title <> '' GROUP BY title HAVING count(*) > 1",
    "near_equal_pages": rf"""WITH keyed AS (SELECT page_id, md5({squeeze("regexp_replace(regexp_replace(html, '(?i)(nonce|csrf[-_a-z]*)=[" + '"' + r"''][^" + '"' + r"'']*[" + '"' + r"'']', '', 'g'), '[0-9]{6,}', '', 'g')")}) AS key FROM pages) SELECT key, count(*) AS n, min(page_id) AS first_page FROM keyed GROUP BY key""",
    "host_median_depth": f"""WITH {FEATURES}, deep AS (SELECT host, max(words) AS words FROM feats WHERE host <> '' GROUP BY host)
SELECT a.host, any_value(a.words) AS words, CAST(median(b.words) AS DOUBLE) AS median_words, count(b.host) AS hosts FROM deep a LEFT JOIN deep b ON a.host <> b.host AND b.words > 0 GROUP BY a.host""",
    "cross_variant_divergence": f"""WITH {FEATURES}, placed AS (SELECT page_id, host, words, row_number() OVER (PARTITION BY host ORDER BY page_id) AS nth, first_value(words) OVER (PARTITION BY host ORDER BY page_id) AS words_0 FROM feats)
SELECT host, 'v' || page_id AS ua, page_id % 9 <> 0 AND abs(words - words_0) > 50 AND (words_0 = 0 OR abs(words - words_0) / CAST(words_0 AS DOUBLE) > 0.2) AS cloaked, page_id % 9 = 0 AS blocked, false AS diverged FROM placed WHERE nth > 1""",
    "rendering_classes": f"WITH {FEATURES} SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 'bot_blocked' WHEN page_id % 17 = 0 THEN 'fetch_failed' WHEN page_id % 19 = 0 THEN 'unresolved_redirect' WHEN page_id % 23 = 0 THEN 'spa_no_ssr' WHEN words < 200 THEN 'minimal_content' WHEN words < 500 THEN 'partial_ssr' ELSE 'fully_accessible' END AS class FROM feats",
    "deterministic_sample": f"WITH raw AS (SELECT page_id, url, {HOST.format('url')} AS host FROM pages) SELECT host, row_number() OVER (PARTITION BY host ORDER BY md5(concat_ws('|', host, url)), url) AS nth, page_id FROM raw QUALIFY nth <= 3",
    "bm25_topk": f"WITH {bm25(5)} SELECT query_id, rank, doc_id, score FROM hits",
    "vector_topk": f"WITH {vectors(25, 8, 0.28)} SELECT query_id, rank, vec_id, relevance FROM best",
    "band_ranked_topk": f"""WITH {vectors(50, 20, 0.0)},
cites AS (SELECT query_id, ['rule', 'ap', 'principle', 'playbook'][CAST(vec_id % 4 + 1 AS INT)] AS kind, vec_id AS id, relevance, vec_id % 5 + 1 AS tier, (vec_id % 10) / 10.0::DOUBLE AS confidence, CASE vec_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS spec, vec_id % 2 AS unproven FROM best)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY -floor(relevance / 0.1::DOUBLE), tier, -{r('confidence')}, -{r('relevance', 4)}, spec, unproven, kind, CAST(id AS VARCHAR)) AS rank, kind, id, relevance FROM cites WHERE relevance >= 0.1 QUALIFY rank <= 5""",
    "org_tiering": f"WITH named AS (SELECT ['google', 'www.moz.com', 'Semrush', 'example.org', 'HubSpot', 'a16z', 'somebody'][CAST(doc_id % 7 + 1 AS INT)] AS org FROM documents) SELECT org, {tier('org', False)} AS tier, {tier('org', True)} AS live_tier, count(*) AS n FROM named GROUP BY ALL",
    "deprecation_guard": "SELECT lang, count(*) AS n FROM documents WHERE NOT ((regexp_matches(text, '(?i)disgusting|pathetic') AND NOT regexp_matches(text, '(?i)worthless')) OR (regexp_matches(text, '(?i)mit license') AND NOT regexp_matches(text, '(?i)no longer'))) GROUP BY lang",
    "lexical_support": f"""WITH {bm25(3)}, sides AS (SELECT query_id, h.doc_id, list_distinct({TOKENS.format('b.text')}) AS x, list_distinct({TOKENS.format('d.text')}) AS y FROM hits h JOIN benchmark b ON b.item_id = h.query_id JOIN documents d ON d.doc_id = h.doc_id)
SELECT query_id, doc_id, len(list_intersect(x, y)) >= 3 AND len(list_intersect(x, y)) >= 0.2 * least(len(x), len(y)) AS supported FROM sides""",
    "jaccard_pairs": f"WITH {pairs("")} SELECT block, a, b, jaccard FROM pairs",
    "dup_clusters": f"WITH {roots("")} SELECT id, root FROM roots",
    "canonical_election": f"WITH {ELECTED} SELECT root, nth, id, nth = 1 AS canonical FROM elected",
    "demotion_plan_faults": f"WITH {ELECTED} SELECT 'demoted twice' AS fault, id FROM elected WHERE nth > 1 GROUP BY id HAVING count(*) > 1",
    "demoted_corpus": f"WITH {ELECTED}, marked AS (SELECT CASE WHEN e.nth > 1 AND c.status = 'active' THEN 'superseded' ELSE c.status END AS status FROM corpus c LEFT JOIN elected e USING (id)) SELECT status, count(*) AS n FROM marked GROUP BY status",
    "entailment_metrics": f"WITH p AS (SELECT quality = 1 AS gold, doc_id % 4 <> 0 AS judged FROM labels) SELECT count(*) AS n, {r('count(*) FILTER (WHERE gold AND judged) * 100.0::DOUBLE / count(*) FILTER (WHERE judged)')} AS strict_precision, {r('count(*) FILTER (WHERE gold AND NOT judged) * 100.0::DOUBLE / count(*) FILTER (WHERE gold)')} AS missed_support FROM p",
    "confusion_matrix": "SELECT quality AS gold, CAST(doc_id % 4 <> 0 AS INT) AS judged, count(*) AS n FROM labels GROUP BY ALL",
    "inclusion_rates": f"SELECT event_type AS engine, count(*) AS runs, {r('count(*) FILTER (WHERE user_id % 3 = 0) * 100.0::DOUBLE / count(*)')} AS cited_pct, {r('count(*) FILTER (WHERE value > 50) * 100.0::DOUBLE / count(*)')} AS mentioned_pct FROM events GROUP BY event_type",
    "share_of_voice": f"WITH once AS (SELECT DISTINCT user_id * 31 + dayofyear(ts) AS run_id, 'd' || (event_id % 37) AS domain FROM events) SELECT domain, count(*) AS n_runs, {r('count(*) * 100.0::DOUBLE / (SELECT count(*) FROM once)', 2)} AS share FROM once GROUP BY domain",
    "top_cited": "WITH n AS (SELECT event_type AS engine, 'd' || (event_id % 37) AS domain, count(*) AS n FROM events GROUP BY ALL) SELECT engine, domain, n, row_number() OVER (PARTITION BY engine ORDER BY n DESC, domain) AS rank FROM n QUALIFY rank <= 10",
    "sweep_cost": f"WITH s AS (SELECT {_engines} AS engine, CAST(sum(event_id % 1000) AS BIGINT) AS input_tokens, CAST(sum(event_id % 300) AS BIGINT) AS output_tokens, CAST(sum(event_id % 3) AS BIGINT) AS searches FROM events GROUP BY engine) SELECT engine, input_tokens, output_tokens, searches, CASE engine WHEN 'anthropic' THEN {r('input_tokens / 1e6 * 3.0::DOUBLE + output_tokens / 1e6 * 15.0::DOUBLE + searches * 0.01::DOUBLE', 4)} ELSE {r('input_tokens / 1e6 * 0.15::DOUBLE + output_tokens / 1e6 * 0.6::DOUBLE + searches * 0.01::DOUBLE', 4)} END AS cost_usd FROM s",
    "answer_mentions": "SELECT turn % 4 AS slot, count(*) AS n, count(*) FILTER (WHERE contains(lower(text), 'thin.example') OR contains(lower(text), 'thin') OR contains(lower(text), 'the') OR contains(lower(text), 'ereti')) AS mentioned FROM conversations WHERE role = 'assistant' GROUP BY slot",
    "usage_quota": "WITH n AS (SELECT user_id AS key, strftime(ts, '%Y-%m') AS month, count(*) AS calls FROM events GROUP BY ALL) SELECT key, month, calls, greatest(calls - 20, 0) AS refused FROM n",
    "link_last_two_broken": "WITH two AS (SELECT 'u' || user_id AS url, event_id % 5 = 1 AS broken, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) SELECT url FROM two WHERE nth <= 2 GROUP BY url HAVING count(*) = 2 AND bool_and(broken)",
    "concurrent_jobs": """WITH jobs AS (SELECT event_id AS job_id, event_type AS profile, CAST(floor(epoch(ts)) AS BIGINT) AS started FROM events), edges AS (SELECT job_id, profile, started AS moment, 1 AS step FROM jobs UNION ALL SELECT job_id, profile, started + job_id % 7200 + 60, -1 FROM jobs),
running AS (SELECT *, sum(step) OVER (PARTITION BY profile ORDER BY moment, step, job_id ROWS UNBOUNDED PRECEDING) AS running FROM edges) SELECT profile, CAST(max(running) AS BIGINT) AS most, CAST(sum(running) AS BIGINT) AS total FROM running WHERE step = 1 GROUP BY profile""",
    "recurring_patterns": "SELECT user_id, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id HAVING count(DISTINCT event_type) >= 3 AND count(*) >= 3",
    "trend_summary": f"SELECT o_orderpriority, count(*) AS n, {r('CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*)', 2)} AS mean_price, {r('''count(*) FILTER (WHERE o_orderstatus = 'F') * 100.0::DOUBLE / count(*)''')} AS finished_pct FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-07-03' AND DATE '1998-08-02' GROUP BY o_orderpriority",
    "unmapped_rules": "SELECT p_brand, count(*) AS n FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL) GROUP BY p_brand",
    "corpus_overview": f"WITH {CORPUS} SELECT block, count(*) AS n, count(*) FILTER (WHERE status = 'active') AS n_active, max(last_verified) AS newest FROM corpus GROUP BY block",
    "org_segments": f"WITH {CORPUS} SELECT source_org, count(*) AS n, round(avg(confidence), 4) AS mean_confidence, 30 AS stale_days FROM corpus GROUP BY source_org",
    "paged_browse": f"WITH {CORPUS} SELECT id, block, confidence FROM corpus WHERE status = 'active' ORDER BY confidence DESC NULLS LAST, id LIMIT 25 OFFSET 25",
    "url_union": rf"WITH plain AS (SELECT regexp_replace(url, '#.*$', '') AS u, url FROM pages) SELECT {URL_KEY} AS url FROM plain UNION SELECT 'https://' || regexp_replace(regexp_extract(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '^([^/?#:]*)', 1), '^www\.', '') FROM plain",
    "upserted_audits": "SELECT CASE WHEN page_id % 3 = 0 THEN 'new' ELSE 'old' END AS mode, count(*) AS n FROM pages GROUP BY mode",
    "stream_tumbling": "SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_monthly_usage": "SELECT user_id, strftime(ts, '%Y-%m') AS month, count(*) AS calls FROM events GROUP BY ALL",
}
