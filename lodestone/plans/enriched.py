"""Pages with what the crawled ones lack, made from their ids: input of the page queries, in SQL that both engines read.

Heads get directives, canonical links, descriptions and structured data; bodies get questions, prices, dates, images and
links; a response gets headers, redirects and probes.  Nothing here belongs to an operator.
"""

from __future__ import annotations

_ORG = "org.example"


def _case(*arms: tuple[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in arms) + " ELSE '' END"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_PERSON = '{"@type":"Person","@id":"#ann","name":"Ann Lee","jobTitle":"Editor","hasCredential":"MD"}'
_FAQ = '{"@type":"FAQPage","@id":"#faq","mainEntity":[{"@type":"Question","name":"What is it?"},{"@type":"Question","name":"How does it work?"},{"@type":"Question","name":"Is it free?"}]}'
_LOCAL = '{"@type":["Thing","Dentist"],"@id":"#d","name":"Bright Teeth","priceRange":"$$","address":{"@type":"PostalAddress","addressLocality":"Ondes"},"geo":{"@type":"GeoCoordinates","latitude":1.5,"longitude":2.5}}'
_BARE_LOCAL = '{"@type":"Restaurant","name":"Soup","address":[{"addressLocality":"The"}]}'
_ORGANIZATION = '{"@type":"Organization","@id":"#o","name":"Looiza","sameAs":["https://a.example/o","https://b.example/o"],"logo":{"@type":"ImageObject","url":"l.png"}}'

#: The nodes of a page's structured data.
_NODES = "concat_ws(',', " + ", ".join(
    f"CASE WHEN {condition} THEN {value} END"
    for condition, value in [
        ("page_id % 4 = 0", _q('{"@type":"NewsArticle","@id":"#a","headline":"x","author":{"@id":"#ann"},"dateModified":"2026-06-01T00:00:00Z","datePublished":"2026-05-01"}')),
        ("page_id % 4 = 1", _q('{"@type":"BlogPosting","author":["Jo Doe",{"@type":"Person","name":"Kim Roe"}],"dateModified":"2025-01-01"}')),
        ("page_id % 4 = 2", _q('{"@type":"Article","dateModified":"soon"}')),
        ("page_id % 8 < 5", _q(_PERSON)),
        ("page_id % 5 < 2", _q(_FAQ)),
        ("page_id % 7 = 1", _q(_LOCAL)),
        ("page_id % 7 = 2", _q(_BARE_LOCAL)),
        ("page_id % 6 < 2", _q(_ORGANIZATION)),
        ("page_id % 9 = 1", _q('{"@type":"BreadcrumbList","@id":"#b"}')),
    ]
) + ")"
_DATA = _case(
    ("page_id % 31 = 30", _q('<script type="application/ld+json">{"@context":"https://schema.org",</script>')),
    ("page_id % 11 <> 10", f"concat('<script type=\"application/ld+json\">{{\"@context\":\"https://schema.org\",\"@graph\":[', {_NODES}, ']}}</script>')"),
)
_HEAD = "concat(" + ", ".join([
    _case(("page_id % 4 = 0", "concat('<link rel=\"canonical\" href=\"', url, '\">')"), ("page_id % 4 = 1", _q('<link href="/other" rel="canonical">')), ("page_id % 4 = 2", _q('<link rel="canonical" href="">'))),
    _case(*[(f"page_id % 13 = {k}", _q(f'<meta name="{n}" content="{c}">')) for k, (n, c) in enumerate([
        ("robots", "noindex, follow"), ("robots", "max-image-preview:none"), ("googlebot", "nosnippet"), ("robots", "max-snippet:20, noarchive"), ("bingbot", "NOINDEX"), ("robots", "index"), ("generator", "none")])]),
    _case(("page_id % 3 = 1", _q('<meta property="og:title" content="t"><meta property="og:image" content="i">')), ("page_id % 3 = 2", _q('<meta property="og:title" content="t"><meta property="og:image" content="i"><meta property="og:description" content="d"><meta name="twitter:card" content="summary">'))),
    _case(("page_id % 5 < 3", "concat('<meta name=\"description\" content=\"', repeat('d', CAST(100 + page_id % 80 AS INT)), '\">')")),
    _case(("page_id % 4 = 1", _q('<link rel="alternate" hreflang="de" href="/de"><link rel="alternate" hreflang="fr" href="/fr">')), ("page_id % 4 = 2", _q('<script>self.x=["hrefLang":"de-DE","hrefLang":"it"]</script>'))),
    _case(("page_id % 7 < 4", _q('<meta name="viewport" content="width=device-width"><meta name="msvalidate.01" content="k">'))),
    _case(("page_id % 6 = 0", _q('<script src="/a.js"></script><link rel="stylesheet" href="/s.css">')), ("page_id % 6 = 1", "concat('<style>', repeat('a{b:c}', 1000), '</style>')")),
    _DATA,
]) + ")"
_BODY = "concat(" + ", ".join([
    _case(
        ("page_id % 6 = 0", _q("<details><summary>What is it?</summary>a</details><details><summary>How <b>does</b> it work</summary>b</details><details><summary>France</summary>c</details>")),
        ("page_id % 6 = 1", _q("<dl><dt>Is it free?</dt><dd>y</dd><dt>Can I pay</dt><dd>y</dd><dt>Terms</dt><dd>y</dd></dl>")),
        ("page_id % 6 = 2", _q("<div class=\"x faq-item\">a</div><div class='faq-item'>b</div>")),
        ("page_id % 6 = 3", _q("<h3>What is it?</h3><h3>How does it work?</h3><h3> Is it free? </h3>")),
        ("page_id % 6 = 4", _q('<div data-slot="accordion-item">a</div>')),
    ),
    _case(("page_id % 5 = 0", _q("<h2>In short</h2><h4>Detail</h4><table><tr><td>1</td></tr></table>")), ("page_id % 5 = 1", _q("<h2>Where <h1>nested</h1></h2>")), ("page_id % 5 = 2", _q("<h2>Why now?</h2><h3>Summary</h3>"))),
    _case(("page_id % 7 = 3", _q("<p>Written by Ann Lee on 2026-06-01.</p>")), ("page_id % 7 = 4", _q('<p class="byline">staff</p>')), ("page_id % 7 = 5", _q("<p>By using this you agree</p>"))),
    _case(("page_id % 3 = 0", _q('<p>It is a tool. It costs 9 EUR or $12, 20 % less than 15 of 2026.</p><img src="a.webp" alt="a" width="1" height="1" loading="lazy">')), ("page_id % 3 = 1", _q('<img src="a.jpg"><img src="b.png" alt=""><img src="https://c.example/c.avif" alt="c">'))),
    _case(("page_id % 4 = 0", _q('<a href="/about-us">We</a><a href="/kontakt">K</a><a href="/privacy">Privacy policy</a>')), ("page_id % 4 = 1", _q('<a href="/x">Our team</a><a href="/editorial-policy">How we write</a>')), ("page_id % 4 = 2", _q('<a href="https://www.nih.gov/a">study</a><a href="https://en.wikipedia.org/wiki/X">more</a><a href="http://x.edu">x</a>'))),
    _case(("page_id % 9 = 0", _q("<p>L00iza and Looiza, 1ooiza</p><span data-nosnippet>hidden</span>"))),
]) + ")"

#: Columns of a page, in SQL over the crawled table.
COLUMNS = {
    "page_id": "page_id",
    "url": "url",
    "html": f"replace(replace(html, '</title>', concat('</title>', {_HEAD})), '</article>', concat({_BODY}, '</article>'))",
    "status": "CAST(CASE WHEN page_id % 29 = 7 THEN 500 WHEN page_id % 37 = 5 THEN 0 ELSE 200 END AS INT)",
    "final_url": "CASE WHEN page_id % 5 < 2 THEN concat('https', substr(url, CAST(strpos_ AS INT))) ELSE url END",
    "x_robots": "CASE page_id % 17 WHEN 3 THEN 'noindex' WHEN 4 THEN 'googlebot: nosnippet' WHEN 5 THEN 'max-snippet: 0' WHEN 6 THEN 'noarchive, nofollow' END",
    "hsts": "CASE WHEN page_id % 3 = 0 THEN 'max-age=63072000' END",
    "encoding": "CASE WHEN page_id % 3 = 1 THEN 'br' WHEN page_id % 3 = 2 THEN 'identity' END",
    "cache": "CASE WHEN page_id % 4 = 0 THEN 'public, max-age=600' WHEN page_id % 4 = 1 THEN 'no-store' WHEN page_id % 4 = 2 THEN 'max-age=0' END",
    "probe_status": "CAST(CASE WHEN page_id % 6 = 0 THEN 0 ELSE 200 END AS INT)",
    "probe_final": "CASE WHEN page_id % 6 < 4 THEN 'https://x.example/' ELSE 'http://x.example/' END",
    "canonical_status": "CAST(CASE WHEN page_id % 8 = 1 THEN 301 WHEN page_id % 8 = 5 THEN 200 ELSE 404 END AS INT)",
    "canonical_final": "CASE WHEN page_id % 16 = 1 THEN url ELSE '/elsewhere' END",
    "llms_status": "CAST(CASE page_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 200 WHEN 2 THEN 404 WHEN 3 THEN 503 ELSE 200 END AS INT)",
    "llms_body": "CASE page_id % 5 WHEN 0 THEN '# Guide' WHEN 1 THEN '<!DOCTYPE html><html>' WHEN 4 THEN '  ' ELSE 'x' END",
}
#: Names of the headers among them.
HEADERS = {"X-Robots-Tag": "x_robots", "strict-transport-security": "hsts", "Content-Encoding": "encoding", "CACHE-CONTROL": "cache"}


def select(position: str) -> list[str]:
    """The columns over ``pages``; ``position`` is the engine's expression of where a URL's ``://`` stands."""
    return [f"{v.replace('strpos_', position)} AS {k}" for k, v in COLUMNS.items()]
