"""Deterministic page checks: a wide projection of features, then one row for each page and check.

Rules are SQL conditions over feature columns, so a check is data: an id, a severity, and when it passes, warns, fails
or doesn't apply.  Their section is the first letter of the id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import html as H
from lodestone.functions import jsonld as J


@dataclass(frozen=True)
class Check:
    id: str
    severity: str
    status: str  # SQL over the columns of page_features

    @property
    def base(self) -> str:
        return self.id.split("_")[0]


CHECKS = [
    Check("A1_https", "high", "CASE WHEN NOT final_https THEN 'fail' WHEN NOT asked_http AND coalesce(probe_status, 0) <> 0 AND NOT probe_https THEN 'fail' WHEN has_hsts THEN 'pass' ELSE 'warn' END"),
    Check("A2_title_length", "medium", "CASE WHEN n_title BETWEEN 50 AND 60 THEN 'pass' WHEN n_title BETWEEN 40 AND 70 THEN 'warn' ELSE 'fail' END"),
    Check("A3_meta_description", "medium", "CASE WHEN n_description = 0 THEN 'fail' WHEN description = title OR n_description < 120 OR n_description > 160 THEN 'warn' ELSE 'pass' END"),
    Check("A4b_canonical", "medium", "CASE WHEN canonical IS NULL OR canonical = '' THEN 'warn' WHEN canonical_self THEN 'pass' WHEN canonical_status IN (301, 302, 303, 307, 308) THEN 'fail' ELSE 'warn' END"),
    Check("A5_robots_meta", "high", "CASE WHEN noindex THEN 'fail' ELSE 'pass' END"),
    Check("A6_single_h1", "medium", "CASE WHEN n_h1 = 1 THEN 'pass' WHEN n_h1 = 0 OR n_h1 = 2 THEN 'warn' ELSE 'fail' END"),
    Check("A7b_h1_nesting", "medium", "CASE WHEN n_nested_h1 = 0 THEN 'pass' ELSE 'fail' END"),
    Check("A8_html_lang", "low", "CASE WHEN lang <> '' THEN 'pass' ELSE 'fail' END"),
    Check("A9_viewport", "medium", "CASE WHEN has_viewport THEN 'pass' ELSE 'fail' END"),
    Check("A12_renders_without_js", "high", "CASE WHEN words > 500 THEN 'pass' WHEN words >= 200 THEN 'warn' ELSE 'fail' END"),
    Check("B2_render_blocking", "medium", "CASE WHEN n_blocking = 0 THEN 'pass' WHEN n_blocking <= 2 THEN 'warn' ELSE 'fail' END"),
    Check("B3_image_formats", "low", "CASE WHEN n_img = 0 THEN 'na' WHEN n_modern = n_img THEN 'pass' WHEN n_modern > 0 OR has_picture THEN 'warn' ELSE 'fail' END"),
    Check("B4_lazy_loading", "low", "CASE WHEN n_img < 3 THEN 'na' WHEN n_lazy >= n_img - 2 THEN 'pass' WHEN n_lazy > 0 OR n_img < 5 THEN 'warn' ELSE 'fail' END"),
    Check("B5_inline_blocks", "low", "CASE WHEN n_inline_big = 0 THEN 'pass' WHEN n_inline_big = 1 AND n_inline_huge = 0 THEN 'warn' ELSE 'fail' END"),
    Check("B7_compression", "medium", "CASE WHEN compressed IS NULL THEN 'na' WHEN compressed THEN 'pass' ELSE 'fail' END"),
    Check("B8_cache_control", "low", "CASE WHEN cached IS NULL THEN 'na' WHEN cached = 'max-age' THEN 'pass' WHEN cached = 'other' THEN 'warn' ELSE 'fail' END"),
    Check("B9_mixed_content", "high", "CASE WHEN NOT final_https THEN 'na' WHEN n_active_http > 0 THEN 'fail' WHEN n_passive_http > 0 THEN 'warn' ELSE 'pass' END"),
    Check("B11_image_dimensions", "low", "CASE WHEN n_img = 0 THEN 'na' WHEN n_img_bare = 0 THEN 'pass' WHEN n_img_bare <= 3 AND 2 * n_img_bare <= n_img THEN 'warn' ELSE 'fail' END"),
    Check("C1_heading_levels", "medium", "CASE WHEN n_skipped = 0 THEN 'pass' WHEN n_skipped = 1 THEN 'warn' ELSE 'fail' END"),
    Check("C3_internal_links", "medium", "CASE WHEN n_internal >= 3 THEN 'pass' WHEN n_internal >= 1 THEN 'warn' ELSE 'fail' END"),
    Check("C4_anchor_text", "low", "CASE WHEN n_generic = 0 THEN 'pass' WHEN n_generic <= 2 THEN 'warn' ELSE 'fail' END"),
    Check("C5_image_alt", "medium", "CASE WHEN n_no_alt = 0 THEN 'pass' WHEN n_no_alt <= 3 AND 2 * n_no_alt <= n_img THEN 'warn' ELSE 'fail' END"),
    Check("C8_authoritative_links", "medium", "CASE WHEN n_authoritative >= 2 THEN 'pass' WHEN n_authoritative = 1 THEN 'warn' ELSE 'fail' END"),
    Check("C9_url_structure", "low", "CASE WHEN n_path > 100 OR has_query THEN 'fail' WHEN n_path >= 75 OR odd_path THEN 'warn' ELSE 'pass' END"),
    Check("C10_open_graph", "low", "CASE WHEN n_og = 3 THEN 'pass' WHEN n_og > 0 THEN 'warn' ELSE 'fail' END"),
    Check("C11_twitter_card", "low", "CASE WHEN twitter_card = '' THEN 'fail' WHEN twitter_card = 'summary' THEN 'warn' ELSE 'pass' END"),
    Check("C12_visible_date", "medium", "CASE WHEN has_date AND n_schema_dates > 0 THEN 'pass' WHEN has_date OR n_schema_dates > 0 THEN 'warn' ELSE 'fail' END"),
    Check("C12b_date_modified", "medium", "CASE WHEN n_just_now > 0 THEN 'fail' WHEN n_stale > 0 AND n_fresh = 0 THEN 'warn' WHEN n_fresh > 0 THEN 'pass' ELSE 'warn' END"),
    Check("C13_city_in_title", "medium", "CASE WHEN city_key IS NULL THEN 'na' WHEN city_in_title THEN 'pass' WHEN city_in_text THEN 'warn' ELSE 'fail' END"),
    Check("D1_structured_data", "high", "CASE WHEN n_jsonld > 0 THEN 'pass' ELSE 'fail' END"),
    Check("D2_schema_context", "medium", "CASE WHEN n_jsonld = 0 THEN 'na' WHEN has_context THEN 'pass' ELSE 'fail' END"),
    Check("D4_entity_ids", "medium", "CASE WHEN n_entities = 0 THEN 'na' WHEN n_without_id = 0 THEN 'pass' WHEN 2 * n_without_id >= n_entities THEN 'fail' ELSE 'warn' END"),
    Check("D5_breadcrumbs", "low", "CASE WHEN is_home THEN 'na' WHEN has_breadcrumbs THEN 'pass' ELSE 'fail' END"),
    Check("D8_organization", "medium", "CASE WHEN has_organization THEN 'pass' WHEN is_home THEN 'fail' ELSE 'warn' END"),
    Check("D9_faq_schema_match", "high", "CASE WHEN n_faq_visible = 0 AND n_faq_schema = 0 THEN 'na' WHEN n_faq_visible = n_faq_schema THEN CASE WHEN n_faq_matched >= n_faq_questions THEN 'pass' ELSE 'warn' END WHEN n_faq_schema > n_faq_visible AND n_faq_matched >= n_faq_schema THEN 'pass' WHEN n_faq_schema > n_faq_visible AND 2 * n_faq_matched >= n_faq_schema THEN 'warn' ELSE 'fail' END"),
    Check("D11_schema_dates", "low", "CASE WHEN is_home THEN 'na' WHEN iso_published AND iso_modified THEN 'pass' WHEN iso_published THEN 'warn' ELSE 'fail' END"),
    Check("D12_person", "medium", "CASE WHEN n_people = 0 THEN 'fail' WHEN n_credentialed > 0 THEN 'pass' ELSE 'warn' END"),
    Check("D14_hreflang", "low", "CASE WHEN n_hreflang >= 2 THEN 'pass' WHEN n_hreflang = 1 OR n_streamed > 0 THEN 'warn' ELSE 'na' END"),
    Check("D15_local_geo", "medium", "CASE WHEN n_local = 0 THEN 'fail' WHEN n_local_geo > 0 THEN 'pass' WHEN n_local_address > 0 THEN 'warn' ELSE 'fail' END"),
    Check("E4_snippets", "high", "CASE WHEN nosnippet THEN 'fail' WHEN short_snippet OR n_data_nosnippet > 0 THEN 'warn' ELSE 'pass' END"),
    Check("E5b_raw_html_depth", "high", "CASE WHEN words >= 500 THEN 'pass' WHEN words >= 200 THEN 'warn' ELSE 'fail' END"),
    Check("E9_bing_verification", "low", "CASE WHEN has_msvalidate THEN 'pass' ELSE 'fail' END"),
    Check("E12_noarchive", "low", "CASE WHEN noarchive THEN 'fail' ELSE 'pass' END"),
    Check("E14_llms_txt", "medium", "CASE WHEN llms_status BETWEEN 200 AND 299 THEN CASE WHEN llms_empty OR llms_html THEN 'fail' ELSE 'pass' END WHEN llms_status BETWEEN 400 AND 499 THEN 'fail' ELSE 'na' END"),
    Check("F3_faq_pairs", "medium", "CASE WHEN n_faq_visible >= 3 THEN 'pass' WHEN n_faq_visible > 0 THEN 'warn' ELSE 'fail' END"),
    Check("F3b_faq_presence", "medium", "CASE WHEN n_faq_visible > 0 AND n_faq_schema > 0 THEN 'pass' WHEN n_faq_visible > 0 OR n_faq_schema > 0 THEN 'warn' ELSE 'fail' END"),
    Check("F4_faq_markup", "low", "CASE WHEN n_faq_visible = 0 THEN 'na' WHEN faq_method IN ('details_summary_question', 'dl_dt_dd_question') THEN 'pass' ELSE 'warn' END"),
    Check("F6_heading_phrases", "medium", "CASE WHEN n_subheads = 0 THEN 'fail' WHEN 2 * n_questions >= n_subheads THEN 'pass' WHEN 4 * n_questions >= n_subheads THEN 'warn' ELSE 'fail' END"),
    Check("F6b_question_headings", "medium", "CASE WHEN n_questions >= 2 OR (n_subheads > 0 AND 10 * n_questions >= 3 * n_subheads) THEN 'pass' WHEN n_questions = 1 OR n_subheads = 0 THEN 'warn' ELSE 'fail' END"),
    Check("F8_facts", "medium", "CASE WHEN n_numbers >= 5 THEN 'pass' WHEN n_numbers >= 2 THEN 'warn' ELSE 'fail' END"),
    Check("F8b_prices", "medium", "CASE WHEN n_prices > 0 THEN 'pass' WHEN n_schema_prices > 0 THEN 'warn' ELSE 'fail' END"),
    Check("F10_summary", "low", "CASE WHEN last_is_summary THEN 'pass' WHEN n_subheads > 0 THEN 'warn' ELSE 'fail' END"),
    Check("F12_tables_lists", "low", "CASE WHEN n_table > 0 THEN 'pass' WHEN n_li > 0 THEN 'warn' ELSE 'fail' END"),
    Check("G1_byline", "medium", "CASE WHEN has_byline THEN 'pass' WHEN n_schema_authors > 0 THEN 'warn' WHEN n_article > 0 OR n_schema_articles > 0 THEN 'fail' ELSE 'na' END"),
    Check("G2_author_linkage", "medium", "CASE WHEN n_authors = 0 THEN 'na' WHEN n_authors_linked > 0 THEN 'pass' WHEN n_authors_unlinked > 0 THEN 'warn' ELSE 'fail' END"),
    Check("G3_citations", "medium", "CASE WHEN n_authoritative >= 3 THEN 'pass' WHEN n_authoritative >= 1 THEN 'warn' ELSE 'fail' END"),
    Check("G4_published_date", "medium", "CASE WHEN is_home THEN 'na' WHEN has_date AND n_published > 0 THEN 'pass' WHEN has_date OR n_published > 0 THEN 'warn' ELSE 'fail' END"),
    Check("G6_organization_profiles", "medium", "CASE WHEN n_profiles >= 2 THEN 'pass' WHEN n_profiles = 1 THEN 'warn' ELSE 'fail' END"),
    Check("G7_legal_links", "low", "CASE WHEN has_legal THEN 'pass' ELSE 'fail' END"),
    Check("G7b_about_contact", "medium", "CASE WHEN has_about AND has_contact THEN 'pass' WHEN has_about OR has_contact THEN 'warn' ELSE 'fail' END"),
    Check("G7c_editorial_policy", "low", "CASE WHEN has_policy THEN 'pass' ELSE 'warn' END"),
    Check("J2_brand_spelling", "low", "CASE WHEN n_disguised > 0 THEN 'fail' ELSE 'pass' END"),
]
#: The checks of the light profile; its D9 asks only whether the questions of the structured data are to be seen.
LIGHT = [c for c in CHECKS if c.id.split("_")[0] in ("C13", "D15", "E5b", "E14", "F3b", "F6b", "F8b")] + [
    Check("D9_faqpage_schema_vs_visible", "medium", "CASE WHEN n_faq_questions = 0 AND n_faq_visible = 0 THEN 'na' WHEN n_faq_questions = 0 THEN 'warn' WHEN n_faq_matched >= n_faq_questions THEN 'pass' WHEN n_faq_matched >= (n_faq_questions + 1) div 2 THEN 'warn' ELSE 'fail' END"),
]

PRICE = r"(?:[€$£][ ]?[0-9])|(?:[0-9][ ]?(?:€|EUR|USD|GBP))"
#: What a price has.
CURRENCIES = ["€", "$", "£", "EUR", "USD", "GBP"]


#: What links to pages about the author, for contact and on editorial policy are called or named like.
ABOUT = r"(?i)\babout(?:[-_/ ]?us)?\b|\bcompany\b|\bwho[-_ ]we[-_ ]are\b|\bteam\b|\büber[-_ ]?uns\b|\bueber[-_ ]?uns\b"
CONTACT = r"(?i)\bcontact(?:[-_/ ]?us)?\b|\bkontakt\b|\bimpressum\b|\bimprint\b|\bget[-_ ]in[-_ ]touch\b"
POLICY = (
    r"(?i)editorial[-_ ](?:policy|guidelines|standards|process)|review[-_ ](?:policy|process|guidelines)|"
    r"content[-_ ](?:policy|standards|guidelines|integrity)|corrections?[-_ ]policy|fact[-_ ]?check(?:ing)?(?:[-_ ]policy)?|"
    r"publishing[-_ ]principles|ethics[-_ ](?:policy|statement)"
)
#: How an author is named in a text, and marked in a tag.
_NAME = r"[A-Z][\w.'\x{2019}-]+"
BYLINE = (
    rf"\b(?i:written\s+by|authored\s+by|reviewed\s+by|medically\s+reviewed\s+by|posted\s+by|verfasst\s+von|geschrieben\s+von)[:\s]+{_NAME}"
    rf"|\b(?i:author|autor)\s*:\s*{_NAME}|\b[Bb]y[:\s]+{_NAME}\s+{_NAME}"
)
#: What an author's naming has: one of these in lower case, or "by" before a capital.
BYLINE_WORDS = ["author", "autor", "verfasst", "geschrieben"]
BYLINE_BY = r"[bB][yY][:\s]+[A-Z]"
BYLINE_MARK = r"(?i)rel\s*=\s*[\"']?author|itemprop\s*=\s*[\"']?author|(?:class|id)\s*=\s*[\"'][^\"']*\b(?:byline|author)\b"
#: How a page begins that stands where a text file should.
HTML_MARKS = ["<!doctype html", "<html", "<head", "<body", "<script", "<div", "<meta "]
AUTHORITATIVE = r"(?i)^https?://[^/?#]*(?:\.gov|\.edu|wikipedia\.org|who\.int|nih\.gov)(?:[/:?#]|$)"
ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ].*)?$"

#: What a crawler may have learned of a page's response, beside the page: null where it is unknown.
RESPONSE = {
    "status": "int", "headers": "map<string,string>", "final_url": "string", "probe_status": "int", "probe_final": "string", "canonical_status": "int",
    "canonical_final": "string", "llms_status": "int", "llms_body": "string",
}


def page_features(pages: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Features of each page (page_id, url, html, and the columns of RESPONSE, as far as there are any).

    A null page counts as empty.  ``as_of`` is the moment that dates are compared with, by default the present one.
    """
    as_of = F.current_timestamp() if as_of is None else as_of
    pages = pages.withColumns({c: F.lit(None).cast(t) for c, t in RESPONSE.items() if c not in pages.columns})
    html = F.coalesce("html", F.lit(""))
    # Each pattern is a pass over what it reads, so a page is cut first, and patterns of tags don't read its text.  What
    # several features look at is cut out once: these columns are not merged with the projection after them.
    pages = pages.select("page_id", "url", *RESPONSE, html.alias("html"), F.lower(html).alias("low_html"), H.markup(html).alias("markup"))
    html, low_html, markup = (F.col(c) for c in ("html", "low_html", "markup"))
    if_any = lambda literals, value, otherwise: H.where_any(low_html, literals, value, otherwise)
    none = F.array().cast("array<string>")
    cut = {
        "texts": H.anchor_texts(html), "links": H.hrefs(markup), "link_locales": if_any(["hreflang"], H.link_locales(markup), none),
        "streamed_locales": if_any(["hreflang"], H.streamed_locales(html), none),
        "inline": F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<(?:script|style)\b[^>]*>(.*?)</(?:script|style)>"), F.lit(1)), F.length),
        "metas": H.runs(markup, "meta"), "imgs": H.runs(markup, "img"),
    } | H.faq_marks(html, low_html, markup)
    pages = pages.select("page_id", "url", *RESPONSE, "html", "low_html", "markup", *[v.alias(k) for k, v in cut.items()])
    texts, links, metas, imgs = (F.col(c) for c in ("texts", "links", "metas", "imgs"))
    images = H.tags(imgs, "img")
    url = F.coalesce("url", F.lit(""))
    final = F.coalesce("final_url", url)
    host = H.host_of(F.col("url"))
    header = lambda name: H.header(F.col("headers"), name)
    https = lambda u: F.coalesce(F.lower(u).startswith("https://"), F.lit(False))
    og = [F.when(H.meta_content(metas, f"og:{k}", "property") != "", 1).otherwise(0) for k in ("title", "description", "image")]
    count = lambda pattern, of=markup: F.regexp_count(of, F.lit(pattern)).cast("int")
    named = lambda pattern: F.exists(links, lambda x: x.rlike(pattern)) | F.exists(texts, lambda x: x.rlike(pattern))
    canonical = F.filter(H.tags(markup, "link"), lambda t: F.coalesce(F.array_contains(F.split(F.lower(H.tag_attribute(t, "rel")), r"\s+"), "canonical"), F.lit(False)))
    canonical = F.transform(canonical, lambda t: F.trim(F.coalesce(H.tag_attribute(t, "href"), F.lit(""))))
    faq_count, faq_method = H.faq_visible()
    cache = header("Cache-Control")
    llms = F.lower(F.ltrim(F.substring(F.coalesce("llms_body", F.lit("")), 1, 2048)))
    llms_html = F.lit(False)
    for mark in HTML_MARKS:
        llms_html = llms_html | llms.startswith(mark) | F.substring(llms, 1, 512).contains(mark)
    path = F.regexp_extract(url, r"^[^/?#]*//[^/?#]*([^?#]*)", 1)
    first = pages.select(
        "page_id", "url", "status", host.alias("host"), F.lower(url).startswith("https://").alias("is_https"),
        https(final).alias("final_https"), F.lower(url).startswith("http://").alias("asked_http"), "probe_status", https(F.col("probe_final")).alias("probe_https"),
        (F.coalesce(header("Strict-Transport-Security"), F.lit("")) != "").alias("has_hsts"),
        F.when(F.col("headers").isNotNull(), F.coalesce(F.lower(header("Content-Encoding")).rlike("gzip|br|zstd|deflate"), F.lit(False))).alias("compressed"),
        F.when(F.col("headers").isNotNull(), F.when(cache.isNull(), "none").when(F.lower(cache).rlike("max-age *= *0*[1-9]"), "max-age").otherwise("other")).alias("cached"),
        H.title_of(html).alias("title"), H.meta_content(metas, "description").alias("description"),
        F.try_element_at(canonical, F.lit(1)).alias("canonical"), final.alias("final"), "canonical_status", "canonical_final",
        count(r"(?i)<h1[ \t\n\r\f>]").alias("n_h1"), H.first_heading(html).alias("first_h1"), if_any(["<h1"], H.nested_h1(markup), F.lit(0)).alias("n_nested_h1"),
        H.skipped_levels(markup).alias("n_skipped"),
        F.regexp_extract(markup, r"(?is)<html[^>]*\blang=[\"']([^\"'>]*)", 1).alias("lang"),
        (F.regexp_extract(metas, r"(?is)<meta[^>]*\bname=[\"']viewport[\"']", 0) != "").alias("has_viewport"),
        (F.regexp_extract(metas, r"(?is)<meta[^>]*\bname=[\"']msvalidate.01[\"']", 0) != "").alias("has_msvalidate"),
        H.directives(metas, header("X-Robots-Tag")).alias("directives"),
        if_any(["data-nosnippet"], count(r"(?i)\bdata-nosnippet\b", html), F.lit(0)).alias("n_data_nosnippet"),
        H.visible_text(html).alias("text"),
        F.regexp_count(F.regexp_extract(markup, r"(?is)<head\b.*?</head>", 0), F.lit(r"(?i)<script[^>]*\bsrc=|<link[^>]*\brel=[\"']stylesheet")).cast("int").alias("n_blocking"),
        if_any(["http://"], count(r"(?i)<(?:script|iframe)[^>]*\bsrc=[\"']http://|<link[^>]*\brel=[\"']stylesheet[\"'][^>]*\bhref=[\"']http://"), F.lit(0)).alias("n_active_http"),
        if_any(["http://"], count(r"(?i)<(?:img|video|audio|source)[^>]*\bsrc=[\"']http://"), F.lit(0)).alias("n_passive_http"),
        F.size(F.filter("inline", lambda n: n > 5 * 1024)).alias("n_inline_big"), F.size(F.filter("inline", lambda n: n > 20 * 1024)).alias("n_inline_huge"),
        count(r"(?i)<img[ \t\n\r\f]", imgs).alias("n_img"),
        (count(r"(?i)<img[ \t\n\r\f]", imgs) - count(r"(?i)<img[^>]*\bwidth=[^>]*\bheight=|<img[^>]*\bheight=[^>]*\bwidth=", imgs)).alias("n_img_bare"),
        count(r"(?i)<img[^>]*\bsrc=[\"'][^\"'>]*\.(?:webp|avif|svg)\b", imgs).alias("n_modern"), (count(r"(?i)<picture\b") > 0).alias("has_picture"),
        F.size(F.filter(F.slice(images, F.lit(3), F.greatest(F.size(images), F.lit(1))), lambda t: F.lower(H.tag_attribute(t, "loading")) == "lazy")).alias("n_lazy"),
        F.size(F.filter(images, lambda t: ~t.rlike(r"(?i)\balt\s*="))).alias("n_no_alt"),
        F.size(F.filter(links, lambda u: (u.startswith("/") & ~u.startswith("//")) | (H.host_of(u) == host) & (host != ""))).alias("n_internal"),
        F.size(F.filter(links, lambda u: u.rlike(AUTHORITATIVE))).alias("n_authoritative"),
        F.size(F.filter(texts, lambda t: t.isin(H.GENERIC_ANCHORS))).alias("n_generic"),
        (og[0] + og[1] + og[2]).alias("n_og"), F.lower(H.meta_content(metas, "twitter:card")).alias("twitter_card"),
        F.size("link_locales").alias("n_hreflang"), F.size("streamed_locales").alias("n_streamed"),
        F.size(F.array_union("link_locales", "streamed_locales")).alias("n_locales"),
        count(r"(?i)<script[^>]*application/ld\+json").alias("n_jsonld"),
        (F.contains(html, F.lit('"@context"')) & html.rlike(r"\"@context\"\s*:\s*\"https://schema\.org/?\"")).alias("has_context"),
        count(r"(?i)<article[ \t\n\r\f>]").alias("n_article"), count(r"(?i)<table[ \t\n\r\f>]").alias("n_table"),
        H.chrome_links(markup).alias("n_chrome_links"), F.size(links).alias("n_links"),
        count(r"(?i)<li[ \t\n\r\f>]").alias("n_li"),
        named(ABOUT).alias("has_about"), named(CONTACT).alias("has_contact"), named(POLICY).alias("has_policy"),
        F.exists(texts, lambda t: t.rlike("privacy|terms|legal|cookie")).alias("has_legal"),
        if_any(["author", "byline"], html.rlike(BYLINE_MARK), F.lit(False)).alias("byline_mark"),
        H.headings(html, "23").alias("subheads"), faq_count.alias("n_faq_visible"), faq_method.alias("faq_method"),
        F.length(path).alias("n_path"), url.contains("?").alias("has_query"), path.rlike("[_A-Z%]").alias("odd_path"), path.isin("", "/").alias("is_home"),
        "llms_status", (F.trim(F.coalesce("llms_body", F.lit(""))) == "").alias("llms_empty"), llms_html.alias("llms_html"),
        if_any(["application/ld+json"], J.nodes(html), none).alias("nodes"),
    )
    nodes, directives = F.col("nodes"), F.col("directives")
    which = lambda test: F.filter(nodes, test)
    dates = lambda field: F.filter(F.transform(nodes, lambda n: F.trim(J.get(n, field))), lambda d: F.coalesce(d != "", F.lit(False)))
    entries = J.faq_entries(nodes)
    states = J.author_states(nodes)
    organizations = which(lambda n: J.is_a(n, "Organization"))
    brands = which(lambda n: J.is_a(n, "Organization", "MedicalBusiness", "LocalBusiness", "SoftwareApplication"))
    local = which(J.is_local)
    profiles = F.transform(organizations, lambda n: F.size(J.values(n, "sameAs")))
    second = first.select(
        "*",
        F.arrays_overlap(directives, F.array(F.lit("noindex"), F.lit("none"))).alias("noindex"),
        F.array_contains(directives, "noarchive").alias("noarchive"),
        (H.same_page_key(H.join_url(F.col("final"), F.col("canonical"))) == H.same_page_key(F.col("final"))).alias("canonical_self"),
        F.size(which(lambda n: F.size(J.kinds(n)) > 0)).alias("n_entities"),
        F.size(which(lambda n: (F.size(J.kinds(n)) > 0) & ~J.given(J.get(n, "@id")))).alias("n_without_id"),
        J.people(nodes).alias("people"), F.size(which(J.is_article)).alias("n_schema_articles"), F.size(J.author_names(nodes)).alias("n_schema_authors"),
        states.alias("authors"), F.size(local).alias("n_local"), F.size(F.filter(local, J.has_geo)).alias("n_local_geo"),
        F.size(F.filter(local, lambda n: J.given(J.get(n, "address")))).alias("n_local_address"), F.nullif(H.match_key(J.city(nodes)), F.lit("")).alias("city_key"),
        F.size(entries).alias("n_faq_schema"), F.filter(F.transform(entries, lambda q: J.get(q, "name")), lambda q: q.isNotNull()).alias("faq_questions"),
        J.price_fields(nodes).alias("n_schema_prices"), dates("dateModified").alias("modified"), dates("datePublished").alias("published"),
        F.filter(F.transform(brands, lambda n: J.get(n, "name")), lambda n: n.isNotNull()).alias("brands"),
        F.coalesce(F.array_max(profiles), F.lit(0)).alias("n_profiles"),
        F.exists(nodes, lambda n: J.is_a(n, "BreadcrumbList")).alias("has_breadcrumbs"), F.exists(nodes, lambda n: J.is_a(n, "Organization", "WebSite")).alias("has_organization"),
        H.match_key(F.col("text")).alias("text_key"), F.lower("text").alias("low"), H.snippet_limits(directives).alias("snippets"),
    )
    moments = F.transform("modified", lambda d: F.struct((F.unix_timestamp(as_of) - F.unix_timestamp(F.try_to_timestamp(d))).alias("age"), d.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$").alias("day")))
    aged = lambda test: F.size(F.filter(moments, lambda m: F.coalesce(test(m["age"], m["day"]), F.lit(False))))
    last = F.try_element_at("subheads", F.lit(-1))
    asked = F.filter(F.transform("faq_questions", H.match_key), lambda q: (q != "") & F.contains(F.col("text_key"), q))
    return second.select(
        "*",
        (F.array_contains(directives, "nosnippet") | F.exists("snippets", lambda n: n == 0)).alias("nosnippet"),
        F.exists("snippets", lambda n: (n > 0) & (n < 50)).alias("short_snippet"),
        F.length("title").alias("n_title"),
        F.length("description").alias("n_description"),
        H.word_count(F.col("text")).alias("words"),
        F.size("subheads").alias("n_subheads"),
        F.size(F.filter("subheads", H.looks_like_question)).alias("n_questions"),
        F.coalesce(F.lower(last).rlike("summary|takeaway|conclusion|tl;dr|key points"), F.lit(False)).alias("last_is_summary"),
        H.where_any(F.col("text"), CURRENCIES, F.regexp_count("text", F.lit(PRICE)).cast("int"), F.lit(0)).alias("n_prices"),
        F.when(F.col("text").rlike("[0-9]"), F.regexp_count("text", F.lit(r"\b[0-9][0-9.,]*")).cast("int")).otherwise(0).alias("n_numbers"),
        (F.contains("text", F.lit("20")) & F.col("text").rlike(r"\b20[0-9]{2}-[0-9]{2}-[0-9]{2}\b")).alias("has_date"),
        (F.col("byline_mark") | ((H.any_of(F.col("low"), BYLINE_WORDS) | F.col("text").rlike(BYLINE_BY)) & F.col("text").rlike(BYLINE))).alias("has_byline"),
        F.size("people").alias("n_people"), F.size(F.filter("people", lambda p: J.given(J.get(p, "hasCredential")))).alias("n_credentialed"),
        F.size("authors").alias("n_authors"), *[F.size(F.filter("authors", _is(s))).alias(f"n_authors_{s}") for s in ("linked", "unlinked")],
        F.size("faq_questions").alias("n_faq_questions"), F.size(asked).alias("n_faq_matched"),
        (F.size("modified") + F.size("published")).alias("n_schema_dates"), F.size("published").alias("n_published"),
        F.exists("modified", lambda d: d.rlike(ISO_DATE)).alias("iso_modified"), F.exists("published", lambda d: d.rlike(ISO_DATE)).alias("iso_published"),
        aged(lambda age, day: (age >= 0) & (age < 60) & ~day).alias("n_just_now"), aged(lambda age, day: age > 91 * 86400).alias("n_stale"),
        aged(lambda age, day: (age >= 0) & (age <= 91 * 86400) & ((age >= 60) | day)).alias("n_fresh"),
        F.coalesce(F.contains(H.match_key(F.col("title")), F.col("city_key")) | F.contains(H.match_key(F.col("first_h1")), F.col("city_key")), F.lit(False)).alias("city_in_title"),
        F.coalesce(F.contains(F.col("text_key"), F.col("city_key")), F.lit(False)).alias("city_in_text"),
        F.size(H.disguised_names(F.col("text"), F.col("low"), F.col("brands"))).alias("n_disguised"),
    )


def _is(value: str):
    return lambda x: x == value


def page_checks(features: DataFrame, checks: list[Check] = CHECKS, more: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """One row for each page and check: ``page_id, host, ord, check_id, section, status, severity``.

    A page that wasn't got (a status of 0, or of 300 and more) has no verdict but na.  ``more`` are columns by name that
    follow from the check's id alone: they are worked out once for each check, not for each row.
    """
    got = F.coalesce(F.col("status").between(1, 299), F.lit(True))
    rows = [
        F.struct(
            F.lit(k).alias("ord"), F.lit(c.id).alias("check_id"), F.lit(c.id[0]).alias("section"), F.when(got, F.expr(c.status)).otherwise("na").alias("status"), F.lit(c.severity).alias("severity"),
            *[f(F.lit(c.id)).alias(name) for name, f in (more or {}).items()],
        )
        for k, c in enumerate(checks)
    ]
    # The features are computed once, before the rows are dealt out.
    return features.select("page_id", "host", F.inline(F.array(*rows)))
