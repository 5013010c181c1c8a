"""Features of one HTML document as column expressions.

Patterns stay within what RE2 accepts (no look-around, no back-references), so that each can be held against SQL.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of white space that are not one space already.
SPACE = r"[ \t\n\r\f]{2,}|[\t\n\r\f]"
DROPPED = [
    r"(?is)<script\b.*?</script>",
    r"(?is)<style\b.*?</style>",
    r"(?is)<noscript\b.*?</noscript>",
    r"(?is)<template\b.*?</template>",
    r"(?s)<!--.*?-->",
    r"(?s)<[^>]*>",
]
#: Named references that are resolved, the ampersand last.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
#: Link texts that say nothing of their target.
GENERIC_ANCHORS = ["click here", "read more", "learn more", "here", "more", "this", "link", "this page", "continue"]
#: How questions begin, in English and German.
QUESTION_STARTS = [
    "how ", "what ", "when ", "where ", "why ", "which ", "who ", "can ", "could ", "do ", "does ", "did ", "is ", "are ",
    "was ", "were ", "will ", "would ", "should ", "shall ", "may ", "might ", "have ", "has ", "had ", "wie ", "wann ",
    "wo ", "warum ", "wieso ", "weshalb ", "welche", "wer ", "wem ", "wen ", "gibt es ", "kann ", "können ", "muss ",
    "müssen ", "darf ", "soll ", "ist ", "sind ", "habe ", "brauche ", "bietet ", "faq", "q:", "question",
]


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def unescape(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def markup(html: Column) -> Column:
    """A page without the text between its tags.

    What begins with ``<`` and holds ``>`` at its end only is found in it as in the page, and so is what such tags enclose
    if that may be anything; what begins elsewhere or looks at text is not.
    """
    return F.regexp_replace(html, r"(?s)>[^<]+", ">")


def runs(html: Column, name: str) -> Column:
    """All that lies between ``<name`` and the next ``>``: patterns of such tags alone find the same in it."""
    return F.array_join(F.regexp_extract_all(html, F.lit(rf"(?i)<{name}[^>]*>?"), F.lit(0)), "")


def visible_text(html: Column) -> Column:
    """Text without scripts, styles, templates, comments and tags."""
    text = F.coalesce(html, F.lit(""))
    for pattern in DROPPED:
        text = F.regexp_replace(text, pattern, " ")
    return squeeze(unescape(text))


def word_count(text: Column) -> Column:
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, " ")))


def title_of(html: Column) -> Column:
    return squeeze(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)", 1)))


def tag_count(html: Column, tag: str) -> Column:
    return F.regexp_count(html, F.lit(rf"(?i)<{tag}[ \t\n\r\f>]"))


def first_heading(html: Column, level: int = 1) -> Column:
    inner = F.regexp_extract(html, rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}>", 1)
    return squeeze(unescape(F.regexp_replace(inner, r"(?s)<[^>]*>", " ")))


def headings(html: Column, levels: str = "1-6") -> Column:
    """Texts of headings of the given levels, in order."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<h[{levels}]\b[^>]*>(.*?)</h[{levels}]>"), F.lit(1))
    return F.transform(found, lambda h: squeeze(unescape(F.regexp_replace(h, r"(?s)<[^>]*>", " "))))


def meta_content(html: Column, name: str, attribute: str = "name") -> Column:
    """The content of the first non-empty meta tag of a name, attributes in either order."""
    after = F.regexp_extract(html, rf"(?is)<meta[^>]*\b{attribute}=[\"']{name}[\"'][^>]*\bcontent=[\"']([^\"'>]*)", 1)
    before = F.regexp_extract(html, rf"(?is)<meta[^>]*\bcontent=[\"']([^\"'>]*)[\"'][^>]*\b{attribute}=[\"']{name}[\"']", 1)
    return squeeze(unescape(F.when(after != "", after).otherwise(before)))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*\bhref=[\"']([^\"'>]*)"), F.lit(1))


def anchor_texts(html: Column) -> Column:
    found = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1))
    return F.transform(found, lambda a: F.lower(squeeze(unescape(F.regexp_replace(a, r"(?s)<[^>]*>", " ")))))


def chrome_links(html: Column) -> Column:
    """Links inside nav, header and footer elements."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<(?:nav|footer|header)\b.*?</(?:nav|footer|header)>"), F.lit(0))
    return F.aggregate(blocks, F.lit(0), lambda n, b: n + F.regexp_count(b, F.lit(r"(?i)<a[ \t\n\r\f]")).cast("int"))


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#:]*)", 1)


def bare_domain(url: Column) -> Column:
    """Host without scheme, path and a leading www."""
    host = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_extract(host, r"^([^/?#:]*)", 1), r"^www\.", "")


def url_key(url: Column) -> Column:
    """A URL for comparison: lower-case host, no fragment, no trailing slash."""
    plain = F.regexp_replace(F.coalesce(url, F.lit("")), r"#.*$", "")
    return F.regexp_replace(F.concat(F.lower(F.regexp_extract(plain, r"^([^/]*//[^/]*)?", 0)), F.regexp_replace(plain, r"^[^/]*//[^/]*", "")), r"/+$", "")


def url_specificity(url: Column) -> Column:
    """0 for a page, 1 for a hub or bare domain, 2 without a URL."""
    path = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[a-zA-Z]+://", ""), r"[?#].*$", "")
    depth = F.size(F.filter(F.split(path, "/"), lambda p: p != ""))
    return F.when(F.trim(F.coalesce(url, F.lit(""))) == "", 2).when(depth <= 1, 1).otherwise(0)


def looks_like_question(text: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    begins = F.lit(False)
    for start in QUESTION_STARTS:
        begins = begins | t.startswith(start)
    return t.contains("?") | begins


def equality_key(html: Column) -> Column:
    """A page without what changes from request to request: nonces, tokens and long numbers."""
    plain = F.regexp_replace(html, r"(?i)(nonce|csrf[-_a-z]*)=[\"'][^\"']*[\"']", "")
    return squeeze(F.regexp_replace(plain, r"[0-9]{6,}", ""))


def tag_attribute(tag: Column, name: str) -> Column:
    """An attribute of one tag, in any order and with any quotes; null where it is absent or empty."""
    found = lambda value: F.nullif(F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*{value}", 1), F.lit(""))
    return F.coalesce(found('"([^"]*)"'), found("'([^']*)'"), found(r"([^\s\"'>]+)"))


def tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*>"), F.lit(0))


def header(headers: Column, name: str) -> Column:
    """A response header by its name in any case; null where it is absent."""
    found = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return F.try_element_at(F.transform(found, lambda e: e["value"]), F.lit(1))


#: Directives whose value follows a colon, so that what stands before it names no crawler.
VALUED_DIRECTIVES = ["max-snippet", "max-image-preview", "max-video-preview", "unavailable_after"]


def directives(html: Column, x_robots: Column) -> Column:
    """Robots directives of a page's meta tags (robots, googlebot, bingbot) and of its X-Robots-Tag, lower case, in order."""
    metas = F.filter(tags(html, "meta"), lambda t: F.lower(F.trim(F.coalesce(tag_attribute(t, "name"), F.lit("")))).isin("robots", "googlebot", "bingbot"))
    own = F.flatten(F.transform(metas, lambda t: F.split(F.coalesce(tag_attribute(t, "content"), F.lit("")), ",")))
    sent = F.split(F.coalesce(x_robots, F.lit("")), ",")
    bare = lambda d: F.when(d.contains(":") & ~F.trim(F.substring_index(d, ":", 1)).isin(VALUED_DIRECTIVES), F.regexp_replace(d, r"^[^:]*:", "")).otherwise(d)
    every = F.concat(F.transform(own, F.lower), F.transform(sent, lambda d: bare(F.lower(d))))
    return F.filter(F.transform(every, lambda d: F.trim(d)), lambda d: d != "")


def snippet_limits(found: Column) -> Column:
    """The numbers of max-snippet directives."""
    pattern = r"^max-snippet\s*:\s*(-?[0-9]+)"
    return F.transform(F.filter(found, lambda d: d.rlike(pattern)), lambda d: F.regexp_extract(d, pattern, 1).try_cast("int"))


def join_url(base: Column, ref: Column) -> Column:
    """A reference resolved against a page's URL; dot segments stay as they are."""
    origin = F.regexp_extract(base, r"^[^/?#]*//[^/?#]*", 0)
    path = F.regexp_extract(base, r"^[^/?#]*//[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(F.regexp_extract(base, r"^[^/?#]*:", 0), ref))
        .when(ref.startswith("/"), F.concat(origin, ref))
        .when(ref.startswith("?"), F.concat(origin, path, ref))
        .when((ref == "") | ref.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), ref))
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), ref))
    )


def same_page_key(url: Column) -> Column:
    """A URL without its fragment, scheme and host in lower case; the query counts."""
    plain = F.regexp_replace(url, r"#.*$", "")
    start = F.regexp_extract(plain, r"^[^/?#]*//[^/?#]*", 0)
    return F.concat(F.lower(start), F.substring(plain, F.length(start) + 1, F.length(plain)))


def match_key(text: Column) -> Column:
    """A text for comparison by containment: references resolved, straight quotes, one space, lower case."""
    text = unescape(F.coalesce(text, F.lit("")))
    # By whole strings: translate looks at each character by itself.
    for curly, straight in zip("\u2019\u2018\u201c\u201d", "''\"\""):
        text = F.replace(text, F.lit(curly), F.lit(straight))
    return F.lower(squeeze(text))


def inner_text(html: Column) -> Column:
    return squeeze(unescape(F.regexp_replace(html, r"(?s)<[^>]*>", " ")))


def any_of(text: Column, literals: list[str]) -> Column:
    """Whether a text holds any of the literals."""
    return reduce(or_, [F.contains(text, F.lit(x)) for x in literals])


def where_any(text: Column, literals: list[str], value: Column, otherwise: Column) -> Column:
    """``value`` where a text holds any of the literals, which a plain search tells before a pattern is tried."""
    return F.when(any_of(text, literals), value).otherwise(otherwise)


def faq_marks(html: Column, low: Column, tags_only: Column) -> dict[str, Column]:
    """Counts of what marks questions and answers on a page, by name.

    ``low`` is the page in lower case, ``tags_only`` its ``markup``.
    """
    all_of = lambda pattern, group=0: F.regexp_extract_all(html, F.lit(pattern), F.lit(group))
    asked = lambda items: F.size(F.filter(F.transform(items, inner_text), looks_like_question))
    number = lambda literals, value: where_any(low, literals, value, F.lit(0))
    terms = r"(?is)<dt[^>]*>(.*?)</dt>"
    classes = ["accordion-item", "faq-item", "faq-entry", "faq-question"]
    return {
        "faq_summaries": number(["</summary>"], asked(all_of(r"(?is)<summary[^>]*>(.*?)</summary>", 1))),
        "faq_terms": number(["</dt>"], F.size(all_of(terms, 1))),
        "faq_terms_asked": number(["</dt>"], asked(all_of(terms, 1))),
        "faq_answers": F.size(F.regexp_extract_all(tags_only, F.lit(r"(?is)<dd[^>]*>"), F.lit(0))),
        "faq_slots": number(["accordion-item"], F.size(all_of(r"(?is)data-slot=[\"']accordion-item[\"']"))),
        "faq_classes": number(classes, F.size(all_of(rf"(?is)class=[\"'][^\"']*(?:{'|'.join(classes)})"))),
        "faq_headings": number(["</h3>"], F.size(all_of(r"(?is)<h3[^>]*>[^<]*\?\s*</h3>"))),
    }


def faq_visible() -> tuple[Column, Column]:
    """Over ``faq_marks``: how many questions and answers a page shows, and by which mark; the first that fits decides."""
    n = lambda name: F.col(f"faq_{name}")
    ways = [
        (n("summaries") > 0, n("summaries"), "details_summary_question"),
        ((n("terms") >= 3) & (n("answers") >= 3) & (2 * n("terms_asked") >= n("terms")), F.least(n("terms_asked"), n("answers")), "dl_dt_dd_question"),
        (n("slots") > 0, n("slots"), "data_slot_accordion"),
        (n("classes") > 0, n("classes"), "class_accordion_item"),
        (n("headings") >= 3, n("headings"), "h3_question_headings"),
    ]
    count, method = F.lit(0), F.lit("none_detected")
    for fits, number, name in reversed(ways):
        count, method = F.when(fits, number).otherwise(count), F.when(fits, name).otherwise(method)
    return count, method


def nested_h1(html: Column) -> Column:
    """Headings of level 2 to 6 with a level 1 heading inside and no other heading opened before it."""
    n = F.lit(0)
    for level in range(2, 7):
        inside = F.regexp_extract_all(html, F.lit(rf"(?is)<h{level}[^>]*>(.*?)</h{level}>"), F.lit(1))
        holds = lambda x: x.rlike(r"(?i)<h1[^>]*>") & ~F.regexp_extract(x, r"(?is)^(.*?)<h1[^>]*>", 1).rlike(r"(?i)<h[1-6][\s>/]")
        n = n + F.size(F.filter(inside, holds))
    return n


#: Product names that are often written with digits for letters, and these digits.
OFTEN_DISGUISED = ["Wegovy", "Mounjaro", "Ozempic", "Rybelsus", "Saxenda", "Trulicity"]
DIGITS_FOR = {"o": "0", "l": "1", "i": "1", "e": "3", "a": "4", "s": "5", "b": "6", "z": "2"}


def disguised_names(text: Column, low: Column, names: Column) -> Column:
    """Spellings of ``names`` (four letters or more) with one digit for a letter: met twice, or beside the real name.

    ``low`` is the text in lower case.
    """
    terms = F.array_sort(F.array_distinct(F.filter(names, lambda n: F.length(n) >= 4)))
    table = F.create_map(*[F.lit(x) for pair in DIGITS_FOR.items() for x in pair])

    def spellings(term: Column) -> Column:
        at = lambda i: F.try_element_at(table, F.substring(F.lower(term), i, F.lit(1)))
        places = F.filter(F.sequence(F.lit(1), F.length(term)), lambda i: at(i).isNotNull())
        changed = lambda i: F.concat(F.substring(term, F.lit(1), i - 1), at(i), F.substring(term, i + 1, F.length(term)))
        return F.transform(places, lambda i: F.struct(term.alias("real"), changed(i).alias("other")))

    def times(name: Column) -> Column:
        edge = lambda x: F.when(x.rlike("[A-Za-z0-9_]"), F.lit(r"\b")).otherwise(F.lit(""))
        pattern = F.concat(F.lit("(?i)"), edge(F.left(name, F.lit(1))), F.lit("\\Q"), name, F.lit("\\E"), edge(F.right(name, F.lit(1))))
        # The plain search rules out nearly all names before a pattern is tried.
        return F.when(F.contains(low, F.lower(name)), F.regexp_count(text, pattern)).otherwise(0)

    def met(every: Column) -> Column:
        found = F.filter(every, lambda s: (times(s["other"]) >= 2) | ((times(s["other"]) > 0) & (times(s["real"]) > 0)))
        return F.transform(found, lambda s: s["other"])

    # The fixed names are of plain letters, so each of their spellings has a digit beside a letter.
    fixed = [(n, n[:i] + DIGITS_FOR[c] + n[i + 1 :]) for n in OFTEN_DISGUISED for i, c in enumerate(n.lower()) if c in DIGITS_FOR]
    often = met(F.array(*[F.struct(F.lit(real).alias("real"), F.lit(other).alias("other")) for real, other in fixed]))
    often = F.when(low.rlike("[a-z][0-9]|[0-9][a-z]"), often).otherwise(F.array().cast("array<string>"))
    return F.concat(met(F.flatten(F.transform(terms, spellings))), often)


def streamed_locales(html: Column) -> Column:
    """Locales that a framework's streamed data names, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(r"(?i)\\*\"hreflang\\*\"\s*:\s*\\*\"([a-z\-]+)\\*\""), F.lit(1)), F.lower))


def link_locales(html: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<link[^>]*hreflang=[\"']([^\"']+)[\"']"), F.lit(1)), F.lower))


def skipped_levels(html: Column) -> Column:
    """How often a heading is more than one level below the heading before it."""
    levels = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<h([1-6])[\s>]"), F.lit(1)), lambda x: x.cast("int"))
    pairs = F.zip_with(F.slice(levels, F.lit(2), F.greatest(F.size(levels) - 1, F.lit(0))), F.slice(levels, F.lit(1), F.greatest(F.size(levels) - 1, F.lit(0))), lambda b, a: b > a + 1)
    return F.size(F.filter(pairs, lambda x: x))


def spa_signals(html: Column) -> Column:
    """Marks of client-side frameworks in a page."""
    marks = {"react": "data-reactroot", "next": "__NEXT_DATA__", "angular": "<app-root", "vue": "data-v-app", "nuxt": "__NUXT__"}
    return F.array_compact(F.array(*[F.when(html.contains(mark), F.lit(name)) for name, mark in marks.items()]))
