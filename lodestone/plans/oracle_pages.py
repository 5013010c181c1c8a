"""DuckDB's SQL of the page features, written apart from the DataFrame code."""

from __future__ import annotations

from lodestone.functions.html import DROPPED, ENTITIES, GENERIC_ANCHORS, QUESTION_STARTS
from lodestone.plans import enriched


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[ \t\n\r\f]+', ' ', 'g'))"


def unescape(x: str) -> str:
    for name, char in ENTITIES:
        x = f"replace({x}, {q(name)}, {q(char)})"
    return x


def stripped(x: str) -> str:
    return squeeze(unescape(f"regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g')"))


def visible(x: str) -> str:
    for pattern in DROPPED:
        x = f"regexp_replace({x}, {q(pattern)}, ' ', 'g')"
    return squeeze(unescape(x))


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def meta(name: str, attribute: str = "name") -> str:
    after = rf"regexp_extract(html, '(?is)<meta[^>]*\b{attribute}=[\"'']{name}[\"''][^>]*\bcontent=[\"'']([^\"''>]*)', 1)"
    before = rf"regexp_extract(html, '(?is)<meta[^>]*\bcontent=[\"'']([^\"''>]*)[\"''][^>]*\b{attribute}=[\"'']{name}[\"'']', 1)"
    return squeeze(unescape(f"CASE WHEN {after} <> '' THEN {after} ELSE {before} END"))


def attribute(tag: str, name: str) -> str:
    """An attribute of a tag, quoted either way or not at all."""
    start = r"(?is)[\s\"'/]" + name + r"\s*=\s*"
    found = [f"nullif(regexp_extract({tag}, {q(start + value)}, 1), '')" for value in ('"([^"]*)"', "'([^']*)'", r"([^\s\"'>]+)")]
    return f"coalesce({', '.join(found)})"


def key(x: str) -> str:
    """For containment: straight quotes, one space, lower case."""
    plain = unescape(f"coalesce({x}, '')")
    return f"lower({squeeze(f'translate({plain}, {q(chr(0x2019) + chr(0x2018) + chr(0x201C) + chr(0x201D))}, {q(chr(39) * 2 + chr(34) * 2)})')})"


def field(node: str, name: str) -> str:
    """A field of a JSON node as text, null where it is absent or null."""
    path = '$."' + name + '"'
    return f"json_extract_string({node}, '{path}')"


def many(node: str, name: str) -> str:
    """A field's values as JSON: a list's elements, or the one value."""
    path = '$."' + name + '"'
    x = f"json_extract({node}, '{path}')"
    return f"CASE WHEN {x} IS NULL OR json_type({x}) = 'NULL' THEN CAST([] AS JSON[]) WHEN json_type({x}) = 'ARRAY' THEN CAST(json_extract({x}, '$[*]') AS JSON[]) ELSE [CAST({x} AS JSON)] END"


def objects(node: str, name: str) -> str:
    return f"list_filter({many(node, name)}, lambda o: json_type(o) = 'OBJECT')"


def types(node: str) -> str:
    return f"list_transform({many(node, '@type')}, lambda ty: json_extract_string(ty, '$'))"


def is_a(node: str, *names: str) -> str:
    return f"list_has_any({types(node)}, [{', '.join(map(q, names))}])"


def says(x: str) -> str:
    return "coalesce(trim(" + x + ") NOT IN ('', '[]', '{}', 'false', '0', 'null'), false)"


HOST = "regexp_extract(lower({0}), '^[a-z][a-z0-9+.-]*://([^/?#:]*)', 1)"
GENERIC = ", ".join(map(q, GENERIC_ANCHORS))
STARTS = " OR ".join(f"starts_with(lower(trim(h)), {q(s)})" for s in QUESTION_STARTS)


def has_link(pattern: str) -> str:
    return f"len(list_filter(list_concat(hrefs, anchors), lambda x: regexp_matches(x, {q('(?i)' + pattern)}))) > 0"


def normal_url(u: str) -> str:
    """Without fragment, scheme and host in lower case."""
    plain = f"regexp_replace({u}, '#.*$', '')"
    start = f"regexp_extract({plain}, '^[^/?#]*//[^/?#]*', 0)"
    return f"lower({start}) || substr({plain}, len({start}) + 1)"


ORIGIN, PATH = "regexp_extract(final, '^[^/?#]*//[^/?#]*', 0)", "regexp_extract({0}, '^[^/?#]*//[^/?#]*([^?#]*)', 1)"
_folder = f"regexp_extract({PATH.format('final')}, '^(.*/)', 1)"
RESOLVED = f"""CASE WHEN regexp_matches(canonical, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN canonical WHEN starts_with(canonical, '//') THEN regexp_extract(final, '^[^/?#]*:', 0) || canonical
  WHEN starts_with(canonical, '/') THEN {ORIGIN} || canonical WHEN starts_with(canonical, '?') THEN {ORIGIN} || {PATH.format('final')} || canonical
  WHEN canonical = '' OR starts_with(canonical, '#') THEN regexp_replace(final, '#.*$', '') || canonical ELSE {ORIGIN} || CASE WHEN {_folder} = '' THEN '/' ELSE {_folder} END || canonical END"""


def _asks(items: str) -> str:
    return f"len(list_filter(list_transform({items}, lambda h: {stripped('h')}), lambda h: contains(h, '?') OR {STARTS}))"


_dt = "regexp_extract_all(html, '(?is)<dt[^>]*>(.*?)</dt>', 1)"
_nested = " + ".join(
    rf"len(list_filter(regexp_extract_all(html, '(?is)<h{n}[^>]*>(.*?)</h{n}>', 1), lambda x: regexp_matches(x, '(?i)<h1[^>]*>') AND NOT regexp_matches(regexp_extract(x, '(?is)^(.*?)<h1[^>]*>', 1), '(?i)<h[1-6][\s>/]')))"
    for n in range(2, 7)
)
_llms = "lower(ltrim(substr(coalesce(llms_body, ''), 1, 2048)))"
_marks = " OR ".join(
    f"starts_with({_llms}, {q(m)}) OR contains(substr({_llms}, 1, 512), {q(m)})" for m in ("<!doctype html", "<html", "<head", "<body", "<script", "<div", "<meta ")
)
#: Types of businesses at a place.
LOCAL = ", ".join(q(t) for t in (
    "localbusiness medicalbusiness medicalclinic dentist physician physiotherapy healthandbeautybusiness daycare store restaurant cafeorcoffeeshop foodestablishment legalservice attorney "
    "accountingservice financialservice homeandconstructionbusiness plumber electrician roofingcontractor hvacbusiness movingcompany realestateagent travelagency automotivebusiness autorepair "
    "beautysalon hairsalon nailsalon daspa dayspa gym exercisegym sportsactivitylocation lodgingbusiness hotel professionalservice veterinarycare childcare emergencyservice selfstorage "
    "shoppingcenter petstore librarysystem radiostation televisionstation").split())  # fmt: skip
_article = f"len(list_filter({types('n')}, lambda ty: regexp_matches(ty, 'Article$|^BlogPosting$|^Report$'))) > 0"
_local = f"len(list_filter({types('n')}, lambda ty: lower(trim(ty)) IN ({LOCAL}))) > 0"
_town = " , ".join(f"nullif(trim(json_extract_string(n, '$.{at}addressLocality')), '')" for at in ("address[0].", "address."))
_own_town = "CASE WHEN len(list_filter(" + types("n") + ", lambda ty: lower(trim(ty)) = 'postaladdress')) > 0 THEN nullif(trim(json_extract_string(n, '$.addressLocality')), '') END"


def _dates(name: str) -> str:
    return f"list_filter(list_transform(nodes, lambda n: trim({field('n', name)})), lambda d: coalesce(d <> '', false))"


_named_author = "CASE WHEN json_type(a) = 'OBJECT' THEN json_extract_string(a, '$.name') ELSE json_extract_string(a, '$') END"
_id = """'$."@id"'"""
_ref = f"list_filter(nodes, lambda m: json_extract_string(m, {_id}) = CASE WHEN json_type(a) = 'OBJECT' THEN json_extract_string(a, {_id}) ELSE json_extract_string(a, '$') END)"
_who = f"CASE WHEN json_type(a) = 'OBJECT' AND (len(json_keys(a)) > 2 OR json_extract(a, {_id}) IS NULL OR len({_ref}) = 0) THEN a WHEN len({_ref}) > 0 THEN {_ref}[-1] END"
_told = " OR ".join(says(field("w", f)) for f in ("sameAs", "jobTitle", "hasCredential"))
_state = f"list_transform([{_who}], lambda w: CASE WHEN coalesce({is_a('w', 'Person', 'Organization')} AND ({_told}), false) THEN 'linked' ELSE 'unlinked' END)[1]"
AS_OF = "TIMESTAMP '2026-06-20 12:00:00'"
_digit = "CASE substr(lower(t), i, 1) WHEN 'o' THEN '0' WHEN 'l' THEN '1' WHEN 'i' THEN '1' WHEN 'e' THEN '3' WHEN 'a' THEN '4' WHEN 's' THEN '5' WHEN 'b' THEN '6' WHEN 'z' THEN '2' END"


def _times(x: str) -> str:
    edge = lambda c: rf"CASE WHEN regexp_matches({c}, '[A-Za-z0-9_]') THEN '\b' ELSE '' END"
    return f"len(regexp_extract_all(text, '(?i)' || {edge(f'left({x}, 1)')} || regexp_escape({x}) || {edge(f'right({x}, 1)')}))"


_age = f"epoch({AS_OF}) - epoch(try_cast(d AS TIMESTAMP))"
_day = "regexp_matches(d, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')"
_iso = "lambda d: regexp_matches(d, '^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].*)?$')"


def _aged(test: str) -> str:
    return f"len(list_filter(modified, lambda d: coalesce({test}, false)))"


_byline = q(
    r"\b(?i:written\s+by|authored\s+by|reviewed\s+by|medically\s+reviewed\s+by|posted\s+by|verfasst\s+von|geschrieben\s+von)[:\s]+[A-Z][\w.'\x{2019}-]+"
    r"|\b(?i:author|autor)\s*:\s*[A-Z][\w.'\x{2019}-]+|\b[Bb]y[:\s]+[A-Z][\w.'\x{2019}-]+\s+[A-Z][\w.'\x{2019}-]+"
)
_byline_mark = q(r"(?i)rel\s*=\s*[\"']?author|itemprop\s*=\s*[\"']?author|(?:class|id)\s*=\s*[\"'][^\"']*\b(?:byline|author)\b")
_faq_ways = [("n_summaries > 0", "n_summaries", "details_summary_question"), ("n_dt >= 3 AND n_dd >= 3 AND 2 * n_dt_asked >= n_dt", "least(n_dt_asked, n_dd)", "dl_dt_dd_question"),
             ("n_slots > 0", "n_slots", "data_slot_accordion"), ("n_classes > 0", "n_classes", "class_accordion_item"), ("n_h3_asked >= 3", "n_h3_asked", "h3_question_headings")]
_prices = " + ".join(f"CAST({says(field('n', f))} AS INT)" for f in ("price", "priceRange", "lowPrice", "highPrice", "priceSpecification"))
_nodes = """flatten(list_transform(list_filter(regexp_extract_all(html, '(?is)<script[^>]*application/ld\\+json[^>]*>(.*?)</script>', 1), lambda b: json_valid(b)),
  lambda b: CAST(json_extract(CAST(b AS JSON), '$."@graph"[*]') AS JSON[])))"""

FEATURES = rf"""
rich AS (SELECT {', '.join(enriched.select("strpos(url, '://')"))} FROM pages),
raw AS (SELECT * REPLACE (coalesce(html, '') AS html), {HOST.format("url")} AS host, coalesce(final_url, url, '') AS final,
  list_filter(list_concat(
    list_transform(flatten(list_transform(list_filter(regexp_extract_all(html, '(?is)<meta\b[^>]*>'), lambda t: lower(trim(coalesce({attribute('t', 'name')}, ''))) IN ('robots', 'googlebot', 'bingbot')),
      lambda t: string_split(coalesce({attribute('t', 'content')}, ''), ','))), lambda d: trim(lower(d))),
    list_transform(string_split(lower(coalesce(x_robots, '')), ','), lambda d: trim(CASE WHEN contains(d, ':') AND trim(split_part(d, ':', 1)) NOT IN ('max-snippet', 'max-image-preview', 'max-video-preview', 'unavailable_after') THEN regexp_replace(d, '^[^:]*:', '') ELSE d END))), lambda d: d <> '') AS directives,
  list_transform(list_filter(regexp_extract_all(html, '(?is)<link\b[^>]*>'), lambda t: coalesce(list_contains(regexp_split_to_array(lower({attribute('t', 'rel')}), '\s+'), 'canonical'), false)), lambda t: trim(coalesce({attribute('t', 'href')}, '')))[1] AS canonical,
  {_nodes} AS nodes
  FROM rich),
lists AS (
  SELECT *, list_transform(regexp_extract_all(html, '(?is)<a\b[^>]*>(.*?)</a>', 1), lambda a: lower({stripped("a")})) AS anchors,
    regexp_extract_all(html, '(?is)<a\b[^>]*\bhref=["'']([^"''>]*)', 1) AS hrefs,
    list_transform(regexp_extract_all(html, '(?is)<h[23]\b[^>]*>(.*?)</h[23]>', 1), lambda h: {stripped("h")}) AS subheads,
    regexp_extract_all(html, '(?is)<img\b[^>]*>') AS images, list_transform(regexp_extract_all(html, '(?i)<h([1-6])[\s>]', 1), lambda x: CAST(x AS INT)) AS levels,
    list_transform(regexp_extract_all(html, '(?is)<(?:script|style)\b[^>]*>(.*?)</(?:script|style)>', 1), lambda x: len(x)) AS inline_blocks,
    list_distinct(list_transform(regexp_extract_all(html, '(?i)<link[^>]*hreflang=["'']([^"'']+)["'']', 1), lambda x: lower(x))) AS link_locales,
    list_distinct(list_transform(regexp_extract_all(html, '(?i)\\*"hreflang\\*"\s*:\s*\\*"([a-z\-]+)\\*"', 1), lambda x: lower(x))) AS streamed_locales,
    {_asks("regexp_extract_all(html, '(?is)<summary[^>]*>(.*?)</summary>', 1)")} AS n_summaries, len({_dt}) AS n_dt, {_asks(_dt)} AS n_dt_asked, {count("html", "(?is)<dd[^>]*>")} AS n_dd,
    {count("html", "(?is)data-slot=[\"']accordion-item[\"']")} AS n_slots, {count("html", "(?is)class=[\"'][^\"']*(?:accordion-item|faq-item|faq-entry|faq-question)")} AS n_classes,
    {count("html", r"(?is)<h3[^>]*>[^<]*\?\s*</h3>")} AS n_h3_asked,
    {visible("html")} AS text,
    {squeeze(unescape("regexp_extract(html, '(?is)<title[^>]*>([^<]*)', 1)"))} AS title,
    {meta("description")} AS description, {_dates("dateModified")} AS modified, {_dates("datePublished")} AS published,
    list_filter(nodes, lambda n: {_article}) AS articles, list_filter(nodes, lambda n: {_local}) AS locals_, list_filter(nodes, lambda n: {is_a('n', 'Organization')}) AS organizations,
    flatten(list_transform(list_filter(nodes, lambda n: {is_a('n', 'FAQPage')}), lambda n: {objects('n', 'mainEntity')})) AS entries,
    list_concat(nodes, flatten(list_transform(nodes, lambda n: list_concat({objects('n', 'founder')}, {objects('n', 'author')}, {objects('n', 'medicalSpecialist')})))) AS anyone
  FROM raw),
more AS (
  SELECT *, list_filter(anyone, lambda n: {is_a('n', 'Person')}) AS people, {key("text")} AS text_key,
    list_filter(list_transform(entries, lambda e: {field('e', 'name')}), lambda x: x IS NOT NULL) AS questions,
    nullif({key(f"coalesce(list_filter(list_transform(locals_, lambda n: coalesce({_town})), lambda c: c IS NOT NULL)[1], list_filter(list_transform(nodes, lambda n: coalesce({_own_town}, {_town})), lambda c: c IS NOT NULL)[1])")}, '') AS city_key,
    {stripped(r"regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1)")} AS first_h1,
    flatten(list_transform(CASE WHEN len(articles) > 0 THEN articles ELSE list_filter(nodes, lambda n: {field('n', 'author')} IS NOT NULL) END,
      lambda n: CASE WHEN {field('n', 'author')} IS NULL THEN ['missing'] ELSE list_transform({many('n', 'author')}, lambda a: {_state}) END)) AS authors,
    list_transform(list_filter(directives, lambda d: regexp_matches(d, '^max-snippet\s*:\s*-?[0-9]+')), lambda d: try_cast(regexp_extract(d, '^max-snippet\s*:\s*(-?[0-9]+)', 1) AS INT)) AS snippets,
    list_concat(list_sort(list_distinct(list_filter(list_transform(list_filter(nodes, lambda n: {is_a('n', 'Organization', 'MedicalBusiness', 'LocalBusiness', 'SoftwareApplication')}), lambda n: {field('n', 'name')}), lambda x: len(x) >= 4))),
      ['Wegovy', 'Mounjaro', 'Ozempic', 'Rybelsus', 'Saxenda', 'Trulicity']) AS terms,
    {PATH.format("url")} AS path, regexp_matches(html, {_byline_mark}) AS byline_mark
  FROM lists),
feats AS (
  SELECT *, starts_with(lower(url), 'https://') AS is_https, length(title) AS n_title, length(description) AS n_description,
    starts_with(lower(final), 'https://') AS final_https, starts_with(lower(url), 'http://') AS asked_http, starts_with(lower(probe_final), 'https://') AS probe_https, coalesce(hsts, '') <> '' AS has_hsts,
    coalesce(regexp_matches(lower(encoding), 'gzip|br|zstd|deflate'), false) AS compressed, CASE WHEN cache IS NULL THEN 'none' WHEN regexp_matches(lower(cache), 'max-age *= *0*[1-9]') THEN 'max-age' ELSE 'other' END AS cached,
    {normal_url(f"({RESOLVED})")} = {normal_url("final")} AS canonical_self,
    {count("html", r"(?i)<h1[ \t\n\r\f>]")} AS n_h1, {_nested} AS n_nested_h1, len(list_filter(range(2, len(levels) + 1), lambda i: levels[i] > levels[i - 1] + 1)) AS n_skipped,
    regexp_extract(html, '(?is)<html[^>]*\blang=["'']([^"''>]*)', 1) AS lang,
    regexp_extract(html, '(?is)<meta[^>]*\bname=["'']viewport["'']', 0) <> '' AS has_viewport, regexp_matches(html, '(?is)<meta[^>]*\bname=["'']msvalidate.01["'']') AS has_msvalidate,
    list_has_any(directives, ['noindex', 'none']) AS noindex, list_contains(directives, 'nosnippet') OR coalesce(list_contains(snippets, 0), false) AS nosnippet,
    len(list_filter(snippets, lambda x: x > 0 AND x < 50)) > 0 AS short_snippet, list_contains(directives, 'noarchive') AS noarchive, {count("html", r"(?i)\bdata-nosnippet\b")} AS n_data_nosnippet,
    {count(r"regexp_extract(html, '(?is)<head\b.*?</head>', 0)", r"(?i)<script[^>]*\bsrc=|<link[^>]*\brel=[" + '"' + r"']stylesheet")} AS n_blocking,
    {count("html", r"(?i)<(?:script|iframe)[^>]*\bsrc=[" + '"' + r"']http://|<link[^>]*\brel=[" + '"' + r"']stylesheet[" + '"' + r"'][^>]*\bhref=[" + '"' + r"']http://")} AS n_active_http,
    {count("html", r"(?i)<(?:img|video|audio|source)[^>]*\bsrc=[" + '"' + r"']http://")} AS n_passive_http,
    len(list_filter(inline_blocks, lambda n: n > 5120)) AS n_inline_big, len(list_filter(inline_blocks, lambda n: n > 20480)) AS n_inline_huge,
    {count("html", r"(?i)<img[ \t\n\r\f]")} AS n_img,
    {count("html", r"(?i)<img[ \t\n\r\f]")} - {count("html", r"(?i)<img[^>]*\bwidth=[^>]*\bheight=|<img[^>]*\bheight=[^>]*\bwidth=")} AS n_img_bare,
    {count("html", r"(?i)<img[^>]*\bsrc=[" + '"' + r"'][^" + '"' + r"'>]*\.(?:webp|avif|svg)\b")} AS n_modern, regexp_matches(html, '(?i)<picture\b') AS has_picture,
    len(list_filter(images[3:], lambda t: lower({attribute('t', 'loading')}) = 'lazy')) AS n_lazy, len(list_filter(images, lambda t: NOT regexp_matches(t, '(?i)\balt\s*='))) AS n_no_alt,
    len(list_filter(hrefs, lambda u: (starts_with(u, '/') AND NOT starts_with(u, '//')) OR ({HOST.format("u")} = host AND host <> ''))) AS n_internal,
    len(list_filter(hrefs, lambda u: regexp_matches(u, '(?i)^https?://[^/?#]*(?:\.gov|\.edu|wikipedia\.org|who\.int|nih\.gov)(?:[/:?#]|$)'))) AS n_authoritative,
    len(list_filter(anchors, lambda t: t IN ({GENERIC}))) AS n_generic,
    CAST({meta("og:title", "property")} <> '' AS INT) + CAST({meta("og:description", "property")} <> '' AS INT) + CAST({meta("og:image", "property")} <> '' AS INT) AS n_og, lower({meta("twitter:card")}) AS twitter_card,
    len(link_locales) AS n_hreflang, len(streamed_locales) AS n_streamed, len(list_distinct(list_concat(link_locales, streamed_locales))) AS n_locales,
    {count("html", r"(?i)<script[^>]*application/ld\+json")} AS n_jsonld, regexp_matches(html, '"@context"\s*:\s*"https://schema\.org/?"') AS has_context,
    {count("html", r"(?i)<article[ \t\n\r\f>]")} AS n_article, {count("html", r"(?i)<table[ \t\n\r\f>]")} AS n_table,
    CAST(coalesce(list_sum(list_transform(regexp_extract_all(html, '(?is)<(?:nav|footer|header)\b.*?</(?:nav|footer|header)>'), lambda b: {count("b", r"(?i)<a[ \t\n\r\f]")})), 0) AS BIGINT) AS n_chrome_links,
    len(hrefs) AS n_links, {count("html", r"(?i)<li[ \t\n\r\f>]")} AS n_li,
    {has_link(r"\babout([-_/ ]?us)?\b|\bcompany\b|\bwho[-_ ]we[-_ ]are\b|\bteam\b|\büber[-_ ]?uns\b|\bueber[-_ ]?uns\b")} AS has_about,
    {has_link(r"\bcontact([-_/ ]?us)?\b|\bkontakt\b|\bimpressum\b|\bimprint\b|\bget[-_ ]in[-_ ]touch\b")} AS has_contact,
    {has_link(r"editorial[-_ ](policy|guidelines|standards|process)|review[-_ ](policy|process|guidelines)|content[-_ ](policy|standards|guidelines|integrity)|corrections?[-_ ]policy|fact[-_ ]?check(ing)?([-_ ]policy)?|publishing[-_ ]principles|ethics[-_ ](policy|statement)")} AS has_policy,
    len(list_filter(anchors, lambda t: regexp_matches(t, 'privacy|terms|legal|cookie'))) > 0 AS has_legal,
    CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END AS words,
    len(subheads) AS n_subheads, len(list_filter(subheads, lambda h: contains(h, '?') OR {STARTS})) AS n_questions, coalesce(regexp_matches(lower(subheads[-1]), 'summary|takeaway|conclusion|tl;dr|key points'), false) AS last_is_summary,
    {count("text", r"([€$£] ?[0-9])|([0-9] ?(€|EUR|USD|GBP))")} AS n_prices, {count("text", r"\b[0-9][0-9.,]*")} AS n_numbers, regexp_matches(text, '\b20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}\b') AS has_date,
    byline_mark OR regexp_matches(text, {_byline}) AS has_byline,
    CASE {" ".join(f"WHEN {c} THEN {n}" for c, n, _ in _faq_ways)} ELSE 0 END AS n_faq_visible, CASE {" ".join(f"WHEN {c} THEN '{m}'" for c, _, m in _faq_ways)} ELSE 'none_detected' END AS faq_method,
    len(path) AS n_path, contains(url, '?') AS has_query, regexp_matches(path, '[_A-Z%]') AS odd_path, path IN ('', '/') AS is_home,
    trim(coalesce(llms_body, '')) = '' AS llms_empty, {_marks} AS llms_html,
    len(list_filter(nodes, lambda n: len({types('n')}) > 0)) AS n_entities, len(list_filter(nodes, lambda n: len({types('n')}) > 0 AND NOT {says(field('n', '@id'))})) AS n_without_id,
    len(people) AS n_people, len(list_filter(people, lambda p: {says(field('p', 'hasCredential'))})) AS n_credentialed, len(articles) AS n_schema_articles,
    len(list_distinct(list_filter(list_transform(flatten(list_transform(nodes, lambda n: {many('n', 'author')})), lambda a: trim({_named_author})), lambda x: {says('x')}))) AS n_schema_authors,
    len(authors) AS n_authors, len(list_filter(authors, lambda x: x = 'linked')) AS n_authors_linked, len(list_filter(authors, lambda x: x = 'unlinked')) AS n_authors_unlinked,
    len(locals_) AS n_local, len(list_filter(locals_, lambda n: json_extract(n, '$.geo.latitude') IS NOT NULL AND json_extract(n, '$.geo.longitude') IS NOT NULL)) AS n_local_geo,
    len(list_filter(locals_, lambda n: {says(field('n', 'address'))})) AS n_local_address, len(entries) AS n_faq_schema, len(questions) AS n_faq_questions,
    len(list_filter(list_transform(questions, lambda x: {key('x')}), lambda x: x <> '' AND contains(text_key, x))) AS n_faq_matched,
    CAST(coalesce(list_sum(list_transform(nodes, lambda n: {_prices})), 0) AS INT) AS n_schema_prices,
    len(modified) + len(published) AS n_schema_dates, len(published) AS n_published, len(list_filter(modified, {_iso})) > 0 AS iso_modified, len(list_filter(published, {_iso})) > 0 AS iso_published,
    {_aged(f"{_age} >= 0 AND {_age} < 60 AND NOT {_day}")} AS n_just_now, {_aged(f"{_age} > 91 * 86400")} AS n_stale, {_aged(f"{_age} >= 0 AND {_age} <= 91 * 86400 AND ({_age} >= 60 OR {_day})")} AS n_fresh,
    coalesce(contains({key("title")}, city_key) OR contains({key("first_h1")}, city_key), false) AS city_in_title, coalesce(contains(text_key, city_key), false) AS city_in_text,
    coalesce(list_max(list_transform(organizations, lambda n: len({many('n', 'sameAs')}))), 0) AS n_profiles,
    len(list_filter(nodes, lambda n: {is_a('n', 'BreadcrumbList')})) > 0 AS has_breadcrumbs, len(list_filter(nodes, lambda n: {is_a('n', 'Organization', 'WebSite')})) > 0 AS has_organization,
    len(list_filter(flatten(list_transform(terms, lambda t: list_transform(list_filter(range(1, len(t) + 1), lambda i: {_digit} IS NOT NULL), lambda i: {{'r': t, 'o': substr(t, 1, i - 1) || {_digit} || substr(t, i + 1)}}))),
      lambda v: contains(lower(text), lower(v.o)) AND ({_times('v.o')} >= 2 OR ({_times('v.o')} > 0 AND {_times('v.r')} > 0)))) AS n_disguised
  FROM more)"""
