"""Queries of structured data: entities at any depth, what each lacks, nodes of graphs; each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import crawl, structured
from lodestone.plans.oracle import ORACLE, q
from lodestone.plans.oracle_pages import enriched
from lodestone.plans.queries import once, pages, query

#: Fields that types of structured data need.
SPECS = [
    ("Article", "required", "headline"), ("NewsArticle", "required", "headline"), ("NewsArticle", "recommended", "author"),
    ("NewsArticle", "recommended", "image"), ("BlogPosting", "google_required", "headline"), ("Person", "required", "name"),
    ("FAQPage", "required", "mainEntity"), ("Dentist", "required", "address"), ("Dentist", "recommended", "telephone"),
    ("Organization", "required", "name"), ("ImageObject", "required", "url"), ("BreadcrumbList", "required", "itemListElement"),
    ("Offer", "required", "price"), ("Offer", "google_required", "priceCurrency"), ("Offer", "recommended", "url"),
]


def _block(json: str) -> str:
    """SQL of a block; ``{n}`` in it stands for a page's own number from 0 to 4."""
    return "concat(" + ", page_id % 5, ".join(q(part) for part in f'<script type="application/ld+json">{json}</script>'.split("{n}")) + ")"


#: Further blocks of each page, by its id, in SQL that both engines read.
_MORE = "CASE page_id % 12 " + " ".join(
    f"WHEN {k} THEN {_block(json)}"
    for k, json in enumerate([
        '{"@type":"BreadcrumbList","itemListElement":[{"@type":"ListItem","position":"1"},7,{"@type":"ListItem","position":{n}},{"position":" 3 "}]}',
        '{&quot;@type&quot;:&quot;Event&quot;,&quot;@graph&quot;:[{&quot;@type&quot;:&quot;Place&quot;,&quot;@graph&quot;:[{&quot;n&quot;:{n}}]}]}',
        '{"@type":["Thing",{n},"FAQPage"],"@id":"","mainEntity":{"@type":["Question","Thing"],"name":"q","acceptedAnswer":{"@type":"Answer","text":""}}}',
        '[{"@type":"FAQPage","mainEntity":[{"@type":"Question","name":"q","acceptedAnswer":{"text":"{n}"}},{"@type":"Question","name":0},{"@type":"Question","name":"x"},"y",{"name":"z"}]}]',
        '{"@type":"Offer","@id":{n},"price":" ","priceCurrency":[],"url":{},"seller":{"@type":"Organization","name":"n","a":{"b":{"c":{"d":{"@type":"Person","e":{"@type":"Person"}}}}}}}',
        '{"@graph":{"@graph":{"@graph":[{"@graph":[{"@graph":[{"@type":"Offer","price":{n},"priceCurrency":"EUR","@reverse":{"@type":"Person"}}]}]}]}}}',
        '[[{"@type":"Offer","price":1.5,"priceCurrency":"EUR","url":"u"}],{"@type":null},{"@type":[]},[[[[[{"@type":"Person","name":"low"}]]]]]]',
        '{"@type":"FAQPage","mainEntity":"{n}"}',
        '{"@type":"FAQPage","mainEntity":[]}',
        '{"@type":"BreadcrumbList","itemListElement":[{"position":1},{"position":2.5},{"position":null}]}',
        '"text {n}"',
    ])
) + " ELSE '' END"


def _marked(spark, folder) -> DataFrame:
    return pages(spark, folder).select("page_id", F.concat("html", F.expr(_MORE)).alias("html"))


def _judged(spark, folder) -> tuple[DataFrame, DataFrame]:
    found = structured.entities(_marked(spark, folder))
    return found, structured.entity_status(found, spark.createDataFrame(SPECS, "type string, tier string, field string"))


@query
def jsonld_entities(spark, folder):
    """Each typed object of each page, what it lacks and what is wrong within it."""
    joined = [F.array_join(c, ";").alias(c) for c in ("missing", "wanted", "issues")]
    return _judged(spark, folder)[1].select("page_id", "block", "path", "depth", "type", "entity_id", "status", *joined)


@query
def jsonld_nodes(spark, folder):
    """How many objects each page's blocks and their graphs hold, blocks with character references included."""
    return structured.nodes(_marked(spark, folder)).groupBy("page_id", "block").agg(F.count("*").alias("n"), F.max(F.length("path")).alias("longest"))


@query
def entity_states(spark, folder):
    return _judged(spark, folder)[1].groupBy("type", "status").agg(F.count("*").alias("n"))


@query
def schema_checks(spark, folder):
    """The six verdicts on structured data, counted."""
    found, states = _judged(spark, folder)
    verdicts = ["parse", "present", "no_invalid", "ids", "recommended", "known_types"]
    return crawl.schema_checks(once(found.drop("node", "issues")), states).groupBy(*verdicts).agg(F.count("*").alias("n"))


_PAGES = f"""rich AS (SELECT {", ".join(enriched.select("strpos(url, '://')"))} FROM pages),
lists AS (SELECT page_id, regexp_extract_all(concat(html, {_MORE}), '(?is)<script[^>]*type=["'']application/ld\\+json["''][^>]*>(.*?)</script>', 1) AS l FROM rich),
raws AS (SELECT page_id, CAST(unnest(range(len(l))) AS INT) AS block, l FROM lists),
texts AS (SELECT page_id, block, trim(l[block + 1], E' \\t\\n\\r') AS raw FROM raws)"""
_kid = "{{'path': {0}, 'depth': CAST({1} AS INT), 'node': {2}}}".format
_part = lambda node, key: f"json_extract({node}, '$.\"' || {key} || '\"')"
_all = lambda node, path, depth: f"list_transform(range(CAST(json_array_length({node}) AS BIGINT)), lambda i: {_kid(f'''{path} || '[' || i || ']' ''', f'{depth} + 1', f'''json_extract({node}, '$[' || i || ']')''')})"
_nothing = lambda v: f"(coalesce(json_type({v}), 'NULL') = 'NULL' OR CAST({v} AS VARCHAR) IN ('[]', '{{}}') OR json_type({v}) = 'VARCHAR' AND trim({v} ->> '$') = '')"
_false = lambda v: f"({v} IS NULL OR CAST({v} AS VARCHAR) IN ('null', '[]', '{{}}', '\"\"', 'false', '0', '0.0'))"
_lack = lambda tiers: f"list_sort(list_filter(coalesce((SELECT list(DISTINCT s.field) FROM specs s WHERE s.type = e.known AND s.tier IN ({tiers})), []), lambda f: NOT list_contains(e.fields, f)))"
_entry = f"""CASE WHEN json_type(x) <> 'OBJECT' THEN 'no_object'
      WHEN NOT coalesce(CASE json_type(x, '$."@type"') WHEN 'ARRAY' THEN list_contains(json_extract_string(x, '$."@type"[*]'), 'Question') ELSE json_extract_string(x, '$."@type"') = 'Question' END, false) THEN 'no_question'
      WHEN {_false("json_extract(x, '$.name')")} THEN 'no_name' WHEN {_false("json_extract(x, '$.acceptedAnswer')")} THEN 'no_answer'
      WHEN json_type(x, '$.acceptedAnswer') = 'OBJECT' AND {_false("json_extract(x, '$.acceptedAnswer.text')")} THEN 'no_answer_text' END"""
_WALKED = f"""WITH RECURSIVE {_PAGES},
specs(type, tier, field) AS (VALUES {", ".join(f"({', '.join(map(q, s))})" for s in SPECS)}),
parsed AS (SELECT page_id, block, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS node FROM texts),
walk(page_id, block, path, depth, node) AS (
  SELECT page_id, block, '$', 0, node FROM parsed WHERE node IS NOT NULL
  UNION ALL
  SELECT page_id, block, kid.path, kid.depth, kid.node FROM (
    SELECT page_id, block, unnest(CASE json_type(node)
      WHEN 'OBJECT' THEN list_transform(list_filter(json_keys(node), lambda k: k = '@graph' OR k[1] <> '@'), lambda k: {_kid("path || '.' || k", "depth + CAST(k <> '@graph' AS INT)", _part("node", "k"))})
      WHEN 'ARRAY' THEN {_all("node", "path", "depth")} END) AS kid FROM walk)
  WHERE kid.depth <= 5),
typed AS (
  SELECT page_id, block, path, depth, node, CASE json_type(node, '$."@type"') WHEN 'VARCHAR' THEN [json_extract_string(node, '$."@type"')]
      WHEN 'ARRAY' THEN list_transform(list_filter(CAST(json_extract(node, '$."@type"') AS JSON[]), lambda t: json_type(t) = 'VARCHAR'), lambda t: t ->> '$') ELSE [] END AS types,
    list_filter(json_keys(node), lambda k: NOT {_nothing(_part("node", "k"))}) AS fields,
    CASE WHEN NOT {_false("json_extract(node, '$.\"@id\"')")} THEN json_extract_string(node, '$."@id"') END AS entity_id
  FROM walk WHERE json_type(node) = 'OBJECT' AND list_contains(json_keys(node), '@type')),
known AS (SELECT *, list_filter(types, lambda t: t IN ({', '.join(q(s) for s in sorted({s[0] for s in SPECS}))}))[1] AS known FROM typed),
entries AS (SELECT page_id, block, path, json_type(node, '$.mainEntity') AS main, CASE json_type(node, '$.mainEntity') WHEN 'ARRAY' THEN CAST(json_extract(node, '$.mainEntity') AS JSON[]) WHEN 'OBJECT' THEN [json_extract(node, '$.mainEntity')] END AS l FROM known WHERE known = 'FAQPage'),
asked AS (SELECT page_id, block, path, unnest(range(len(l))) AS i, l FROM entries),
answered AS (SELECT page_id, block, path, i, {_entry} AS fault FROM (SELECT *, l[i + 1] AS x FROM asked)),
crumbs AS (SELECT page_id, block, path, list_filter(CAST(json_extract(node, '$.itemListElement') AS JSON[]), lambda x: json_type(x) = 'OBJECT') AS l FROM known WHERE known = 'BreadcrumbList' AND json_type(node, '$.itemListElement') = 'ARRAY'),
stood AS (SELECT page_id, block, path, unnest(range(len(l))) AS i, l FROM crumbs),
placed AS (SELECT page_id, block, path, i, CASE WHEN json_type(x, '$.position') = 'VARCHAR' THEN TRY_CAST(trim(x ->> '$.position') AS INT) ELSE trunc(TRY_CAST(x ->> '$.position' AS DOUBLE)) END AS place FROM (SELECT *, l[i + 1] AS x FROM stood)),
faults AS (
  SELECT page_id, block, path, i, 'entry[' || i || ']:' || fault AS fault FROM answered WHERE fault IS NOT NULL
  UNION ALL SELECT page_id, block, path, i, 'crumb[' || i || ']:position' FROM placed WHERE place IS DISTINCT FROM i + 1
  UNION ALL SELECT page_id, block, path, 0, CASE WHEN main IS NULL OR len(l) = 0 THEN 'no_entries' ELSE 'entries_no_list' END FROM entries WHERE main IS NULL OR len(l) = 0 OR l IS NULL),
told AS (SELECT page_id, block, path, string_agg(fault, ';' ORDER BY i) AS issues FROM faults GROUP BY ALL),
lacking AS (SELECT e.*, {_lack("'required', 'google_required'")} AS missing, {_lack("'recommended'")} AS wanted, coalesce(t.issues, '') AS issues FROM known e LEFT JOIN told t USING (page_id, block, path)),
states AS (
  SELECT page_id, block, path, depth, coalesce(known, types[1], 'Unknown') AS type, entity_id,
    CASE WHEN known IS NULL THEN 'no_spec' WHEN len(missing) > 0 OR issues <> '' THEN 'invalid' WHEN len(wanted) > 0 THEN 'incomplete' ELSE 'valid' END AS status,
    array_to_string(missing, ';') AS missing, array_to_string(wanted, ';') AS wanted, issues FROM lacking)"""
ORACLE["jsonld_entities"] = _WALKED + " SELECT * FROM states"
ORACLE["entity_states"] = _WALKED + " SELECT type, status, count(*) AS n FROM states GROUP BY ALL"
_band = lambda n, none, low: f"CASE WHEN n = 0 THEN 'na' WHEN {n} = 0 THEN 'pass' ELSE '{low}' END AS {none}"
ORACLE["schema_checks"] = _WALKED + f""",
broken AS (SELECT page_id, count(*) AS bad FROM parsed WHERE node IS NULL GROUP BY ALL),
sums AS (SELECT page_id, count(*) AS n, count_if(status = 'invalid') AS invalid, count_if(status = 'incomplete') AS incomplete, count_if(status = 'no_spec') AS no_spec, count_if(entity_id IS NULL) AS bare FROM states GROUP BY ALL),
summed AS (SELECT page_id, coalesce(bad, 0) AS bad, coalesce(n, 0) AS n, invalid, incomplete, no_spec, bare FROM broken FULL JOIN sums USING (page_id)),
judged AS (
  SELECT CASE WHEN bad = 0 THEN 'pass' ELSE 'fail' END AS parse, CASE WHEN n > 0 THEN 'pass' ELSE 'fail' END AS present, {_band("invalid", "no_invalid", "fail")},
    CASE WHEN n = 0 THEN 'na' WHEN bare = 0 THEN 'pass' WHEN bare * 2 >= n THEN 'fail' ELSE 'warn' END AS ids, {_band("incomplete", "recommended", "warn")}, {_band("no_spec", "known_types", "warn")} FROM summed)
SELECT *, count(*) AS n FROM judged GROUP BY ALL"""
ORACLE["jsonld_nodes"] = f"""WITH RECURSIVE {_PAGES},
parsed AS (SELECT page_id, block, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) WHEN json_valid(replace(raw, '&quot;', '"')) THEN CAST(replace(raw, '&quot;', '"') AS JSON) END AS node FROM texts),
walk(page_id, block, path, node) AS (
  SELECT page_id, block, '$', node FROM parsed WHERE json_type(node) = 'OBJECT'
  UNION ALL SELECT page_id, block, kid.path, kid.node FROM (SELECT page_id, block, unnest({_all("node", "'$'", "0")}) AS kid FROM parsed WHERE json_type(node) = 'ARRAY') WHERE json_type(kid.node) = 'OBJECT'
  UNION ALL SELECT page_id, block, kid.path, kid.node FROM (SELECT page_id, block, unnest({_all("json_extract(node, '$.\"@graph\"')", "path || '.@graph'", "0")}) AS kid FROM walk WHERE json_type(node, '$."@graph"') = 'ARRAY') WHERE json_type(kid.node) = 'OBJECT')
SELECT page_id, block, count(*) AS n, CAST(max(length(path)) AS INT) AS longest FROM walk GROUP BY ALL"""
