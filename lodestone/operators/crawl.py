"""What crawlers may and do see: robots rules, sitemaps, probes by user agent, structured data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.rounding import py_round

# Crawlers that are looked at, and those that decide the first gate.
BOTS = [
    "Googlebot", "Bingbot", "BingPreview", "GPTBot", "ChatGPT-User", "OAI-SearchBot", "ClaudeBot", "Claude-Web", "anthropic-ai",
    "PerplexityBot", "Google-Extended", "Applebot", "Applebot-Extended", "CCBot", "DuckDuckBot", "Bytespider",
]
GATE_BOTS = ["GPTBot", "ClaudeBot", "Google-Extended", "PerplexityBot"]
FIXED_STATUS = {401: "bot_blocked", 403: "bot_blocked", 429: "bot_blocked"}


def robots_rules(files: DataFrame) -> DataFrame:
    """``host, group_ix, token, rule_ix, directive, pattern`` of each host's robots file (host, body).

    A group is a run of user-agent lines and the rules below it; a group without rules keeps one row with a null
    directive.  Lines are numbered and grouped by window functions, so a file is never parsed by a loop.
    """
    lines = files.select("host", F.posexplode(F.split(F.coalesce("body", F.lit("")), r"\r\n|\r|\n")).alias("line", "raw"))
    plain = F.trim(F.regexp_replace("raw", r"#.*$", ""))
    key = F.lower(F.trim(F.regexp_extract(plain, r"^([^:]*):", 1)))
    value = F.trim(F.regexp_extract(plain, r"^[^:]*:(.*)$", 1))
    lines = lines.select("host", "line", key.alias("key"), value.alias("value")).filter(F.col("key").isin("user-agent", "allow", "disallow"))
    by_line = Window.partitionBy("host").orderBy("line")
    starts = (F.col("key") == "user-agent") & F.coalesce(F.lag("key").over(by_line) != "user-agent", F.lit(True))
    lines = lines.withColumn("group_ix", F.sum(starts.cast("int")).over(by_line)).filter("group_ix > 0")
    agents = lines.filter("key = 'user-agent'").select("host", "group_ix", F.col("value").alias("token"))
    rules = lines.filter("key <> 'user-agent'").select(
        "host", "group_ix", F.col("line").alias("rule_ix"), F.col("key").alias("directive"), F.col("value").alias("pattern")
    )
    return agents.join(rules, ["host", "group_ix"], "left").select("host", "group_ix", "token", "rule_ix", "directive", "pattern")


def _pattern_regex(pattern: Column) -> Column:
    """A path pattern with ``*`` and a closing ``$`` as a regular expression."""
    quoted = F.concat(F.lit("\\Q"), F.replace(F.regexp_replace(pattern, r"\$$", ""), F.lit("*"), F.lit("\\E.*\\Q")), F.lit("\\E"))
    return F.concat(F.lit("^"), quoted, F.when(pattern.endswith("$"), "$").otherwise(""))


def robots_access(rules: DataFrame, paths: DataFrame, bots: list[str] = BOTS) -> DataFrame:
    """``host, path, bot, allowed``: whether each bot may fetch each path (host, path); what no rule forbids is allowed.

    A group's token is a case-insensitive beginning of the bot's name; the longest tokens win and ``*`` counts only
    where none fits.  The longest fitting pattern decides, allow before disallow; an empty disallow allows all.
    """
    names = F.explode(F.array(*map(F.lit, bots)))
    fits = F.lower(F.col("bot")).startswith(F.lower("token")) & (F.col("token") != "")
    # Bots are a fixed list, so groups are dealt to them by explode and filter instead of a theta join.
    chosen = rules.withColumn("bot", names).withColumn("rank", F.when(fits, F.length("token")).when(F.col("token") == "*", 0)).filter("rank IS NOT NULL")
    best = F.max("rank").over(Window.partitionBy("host", "bot"))
    chosen = chosen.withColumn("best", best).filter("rank = best AND directive IS NOT NULL")
    asked = paths.select("host", "path").distinct().withColumn("bot", names)
    met = asked.join(chosen.select("host", "bot", "directive", "pattern"), ["host", "bot"], "left")
    empty = F.col("pattern") == ""
    hit = F.when(empty, F.col("directive") == "disallow").otherwise(F.rlike("path", _pattern_regex(F.col("pattern"))))
    allows = (F.col("directive") == "allow") | empty
    length = F.when(empty, 0).otherwise(F.length("pattern"))
    verdict = F.max(F.when(F.coalesce(hit, F.lit(False)), F.struct(length.alias("n"), allows.alias("allows"))))
    out = met.groupBy("host", "path", "bot").agg(verdict.alias("v"))
    return out.select("host", "path", "bot", F.coalesce(F.col("v.allows"), F.lit(True)).alias("allowed"))


def gate_access(access: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``host, path, ai_bot_allowed``: false where any gate bot is denied.

    With ``files`` (host, code) it is null where the robots file could not be read (no response, or one of 500 and more);
    a file that isn't there (400 to 499) forbids nothing.
    """
    rows = access.filter(F.col("bot").isin(GATE_BOTS))
    out = rows.groupBy("host", "path").agg(F.bool_and("allowed").alias("ai_bot_allowed"))
    if files is None:
        return out
    lost = files.filter("code = 0 OR code >= 500").select("host", F.lit(True).alias("lost")).distinct()
    return out.join(lost, "host", "left").select("host", "path", F.when(F.col("lost").isNull(), F.col("ai_bot_allowed")).alias("ai_bot_allowed"))


# The checks that ask whether crawlers are let in, and the crawlers of each; crawlers of AI companies.
BOT_CHECKS = {
    "E1": ["PerplexityBot"],
    "E2": ["Bingbot", "BingPreview"],
    "E3": ["Googlebot"],
    "E10": ["ClaudeBot", "Claude-Web", "anthropic-ai", "GPTBot", "ChatGPT-User", "OAI-SearchBot", "Applebot", "Applebot-Extended"],
    "E13": ["CCBot"],
}
AI_CRAWLERS = ["GPTBot", "ChatGPT-User", "OAI-SearchBot", "ClaudeBot", "Claude-Web", "anthropic-ai", "PerplexityBot", "Google-Extended", "Applebot-Extended", "CCBot"]


def _robots_known(access: DataFrame, files: DataFrame) -> DataFrame:
    """``host, path, denied, code, body, read, declares, n_listed`` of each path: the bots that are denied, and its host's file.

    A file is read if its host answers with less than 400.  ``n_listed``: crawlers of AI companies that it names.
    """
    body = F.coalesce("body", F.lit(""))
    named = F.filter(F.array(*map(F.lit, AI_CRAWLERS)), lambda bot: F.rlike(body, F.concat(F.lit(r"(?im)^\s*user-agent\s*:\s*"), bot, F.lit(r"\s*(?:#.*)?$"))))
    known = files.select(
        "host", "code", body.alias("body"), F.coalesce(F.col("code").between(1, 399), F.lit(False)).alias("read"),
        body.rlike(r"(?im)^\s*sitemap\s*:").alias("declares"), F.size(named).alias("n_listed"),
    )
    denied = access.groupBy("host", "path").agg(F.collect_set(F.when(~F.col("allowed"), F.col("bot"))).alias("denied"))
    return denied.join(known, "host")


def robots_findings(access: DataFrame, files: DataFrame) -> DataFrame:
    """``host, path, check_id, status``: whether crawlers are let in (E1, E2, E3, E10, E13: those of a company; A10: all that
    are looked at) and whether the file declares a sitemap (A11).

    Where the robots file could not be read nothing is known: warn, and na for A11.  ``files``: host, code, body.
    """
    rows = [F.struct(F.lit(c).alias("check_id"), F.arrays_overlap(F.array(*map(F.lit, bots)), "denied").alias("shut")) for c, bots in BOT_CHECKS.items()]
    rows.append(F.struct(F.lit("A10").alias("check_id"), (F.size("denied") > 0).alias("shut")))
    known = _robots_known(access, files)
    found = known.select("host", "path", "read", F.inline(F.array(*rows)))
    found = found.select("host", "path", "check_id", F.when(~F.col("read"), "warn").when(F.col("shut"), "fail").otherwise("pass").alias("status"))
    maps = F.when(~F.col("read"), "na").when(F.col("declares"), "pass").otherwise("warn")
    return found.unionByName(known.select("host", "path", F.lit("A11").alias("check_id"), maps.alias("status")))


def robots_checks(access: DataFrame, files: DataFrame) -> DataFrame:
    """``host, path, check, status`` of the robots file itself: reachable, declares_sitemap, googlebot, ai_crawlers_all, target_path.

    A file that is lost or absent fails to be reachable, an empty one warns.  Any denied crawler of an AI company fails;
    all pass only if the file names all of them.  What a file that can't be read says about access is unknown: warn.
    """
    shut = lambda bad, good="pass": F.when(~F.col("read"), "warn").when(bad, "fail").otherwise(good)
    all_named = F.when(F.col("n_listed") == len(AI_CRAWLERS), "pass").otherwise("warn")
    checks = {
        "reachable": F.when(~F.col("read"), "fail").when(~F.col("body").rlike(r"\S"), "warn").otherwise("pass"),
        "declares_sitemap": F.when(~F.col("read"), "na").when(F.col("declares"), "pass").otherwise("warn"),
        "googlebot": shut(F.array_contains("denied", "Googlebot")),
        "ai_crawlers_all": shut(F.arrays_overlap("denied", F.array(*map(F.lit, AI_CRAWLERS))), all_named),
        "target_path": shut(F.size("denied") > 0),
    }
    rows = F.inline(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("status")) for k, v in checks.items()]))
    return _robots_known(access, files).select("host", "path", rows)


def sitemap_sources(files: DataFrame, probes: DataFrame) -> DataFrame:
    """``host, source, sitemap``: where each host's sitemaps are: declared in its robots file, else at the usual places.

    ``files``: host, body.  ``probes``: host, path, code.  All declared ones count; of the usual ones the first that answers.
    """
    declared = files.select("host", F.explode(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), F.lit(1))).alias("sitemap"))
    usual = F.when(F.col("path") == "/sitemap.xml", 1).when(F.col("path") == "/sitemap_index.xml", 2)
    found = probes.withColumn("rank", usual).filter("rank IS NOT NULL AND code BETWEEN 200 AND 299")
    found = found.join(declared.select("host").distinct(), "host", "left_anti").groupBy("host").agg(F.min_by("path", "rank").alias("sitemap"))
    return declared.distinct().select("host", F.lit("robots").alias("source"), "sitemap").unionByName(found.select("host", F.lit("usual").alias("source"), "sitemap"))


def sitemap_checks(urls: DataFrame, targets: DataFrame, probes: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """``host, urls, target, one_domain, size, alive``: each host's sitemap against its target page (host, url).

    ``urls``: host, loc.  ``probes``: loc, code of a sample.  ``entries``: those of each file (host, sitemap, kind, loc); a
    file holds 50,000 at most.  URLs are alike without scheme, www. and trailing slash.  Other domains are a warning.
    Dead ones (neither 200 to 399 nor 403) pass from 90 percent of good ones on and warn from 70; 403 may be a challenge
    and warns; na where nothing was probed.
    """
    key = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"^https?://(?:www\.)?", ""), r"/+$", "")
    own = urls.join(probes, "loc", "left").join(targets, "host", "left")
    host_of = F.regexp_extract(F.lower("loc"), r"^[a-z][a-z0-9+.-]*://([^/?#:]*)", 1)
    code = F.col("code")
    sums = own.groupBy("host").agg(
        F.count("*").alias("urls"), F.bool_or(key(F.col("loc")) == key(F.col("url"))).alias("has"), F.count_if(host_of != F.col("host")).alias("others"),
        F.count("code").alias("probed"), F.count_if(code.between(200, 399)).alias("good"), F.count_if(code == 403).alias("blocked"),
    )
    if entries is None:
        sums = sums.withColumn("largest", F.col("urls"))
    else:
        files = entries.filter("kind = 'urlset'").groupBy("host", "sitemap").agg(F.count("loc").alias("n")).groupBy("host").agg(F.max("n").alias("largest"))
        sums = sums.join(files, "host", "left")
    share = F.col("good") / F.nullif(F.col("probed"), F.lit(0))
    dead = F.col("probed") - F.col("good") - F.col("blocked")
    alive = F.when(share.isNull(), "na").when(dead > 0, F.when(share >= 0.9, "pass").when(share >= 0.7, "warn").otherwise("fail")).when(F.col("blocked") > 0, "warn").otherwise("pass")
    return sums.select(
        "host", "urls", F.when(F.coalesce("has", F.lit(False)), "pass").otherwise("fail").alias("target"), F.when(F.col("others") == 0, "pass").otherwise("warn").alias("one_domain"),
        F.when(F.coalesce("largest", F.lit(0)) <= 50_000, "pass").otherwise("fail").alias("size"), alive.alias("alive"),
    )


def sitemap_entries(maps: DataFrame) -> DataFrame:
    """``host, sitemap, kind, loc, lastmod`` of sitemap files (host, sitemap, body); null loc for a file that fails to parse.

    Namespaces, entities and CDATA are the XML parser's business.
    """
    xml = F.regexp_replace(F.coalesce("body", F.lit("")), r"\sxmlns(:\w+)?=\"[^\"]*\"", "")
    kind = F.when(F.col("body").contains("<sitemapindex"), "index").when(F.col("body").contains("<urlset"), "urlset").otherwise("parse_error")
    blocks = F.regexp_extract_all(xml, F.lit(r"(?s)<(?:url|sitemap)>.*?</(?:url|sitemap)>"), F.lit(0))
    rows = maps.select("host", "sitemap", kind.alias("kind"), F.explode_outer(blocks).alias("block"))
    text = lambda tag: F.trim(F.xpath_string("block", F.lit(f"*/{tag}")))
    return rows.select(
        "host", "sitemap", "kind", F.when(F.col("block").isNotNull(), text("loc")).alias("loc"), F.nullif(text("lastmod"), F.lit("")).alias("lastmod")
    )


def walk_sitemaps(entries: DataFrame, roots: DataFrame, depth: int = 2, children: int = 20) -> DataFrame:
    """Page URLs reached from root sitemaps (host, sitemap), ``depth`` indexes deep, at most ``children`` of each."""
    level = roots.select("host", "sitemap", F.lit(0).alias("depth"))
    seen, found = level, []
    for d in range(depth + 1):
        rows = level.join(entries, ["host", "sitemap"])
        found.append(rows.filter("kind = 'urlset' AND loc IS NOT NULL").select("host", "loc", "lastmod", "depth"))
        w = Window.partitionBy("host", "sitemap").orderBy("loc")
        below = rows.filter("kind = 'index' AND loc IS NOT NULL").withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= children)
        level = below.select("host", F.col("loc").alias("sitemap"), F.lit(d + 1).alias("depth")).dropDuplicates(["host", "sitemap"])
        level = level.join(seen.select("host", "sitemap"), ["host", "sitemap"], "left_anti")
        seen = seen.unionByName(level)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy("host", "loc").agg(F.min("depth").alias("depth"), F.max("lastmod").alias("lastmod"))


def sitemap_coverage(urls: DataFrame) -> DataFrame:
    """Dated share of each host's sitemap URLs and its band."""
    n, dated = F.count("*"), F.count("lastmod")
    pct = dated * 100.0 / n
    status = F.when(pct >= 80, "pass").when(pct >= 40, "warn").otherwise("fail")
    return urls.groupBy("host").agg(n.alias("urls"), py_round(pct, 1).alias("dated_pct"), status.alias("status"))


def rendering_class(code: Column, same_as_404: Column, words: Column, signals: Column) -> Column:
    """What a probe saw: transport failures first, then shells, then bands of visible words."""
    return (
        F.when(code <= 0, "fetch_failed")
        .when((code >= 300) & (code < 400), "unresolved_redirect")
        .when(code.isin(*FIXED_STATUS), "bot_blocked")
        .when(code >= 400, "http_error")
        .when(F.coalesce(same_as_404, F.lit(False)), "spa_no_ssr")
        .when((words < 200) & (F.size(signals) > 0), "js_dependent")
        .when(words < 200, "minimal_content")
        .when(words < 500, "partial_ssr")
        .otherwise("fully_accessible")
    )


def cross_agent(probes: DataFrame, default: str = "default") -> DataFrame:
    """Each probe (page_id, ua, http_code, words, final_url) beside its page's default one: cloaking, blocking, divergence.

    One that is refused where the default is served is blocked, and nothing else is compared.  Cloaked: both served, and
    words apart by more than 50 and by a fifth of the default's.  Diverged: both have a final URL, and not the same.
    """
    base = probes.filter(F.col("ua") == default).select(
        "page_id", F.col("words").alias("words_0"), F.col("http_code").alias("code_0"), F.col("final_url").alias("final_0")
    )
    rows = probes.filter(F.col("ua") != default).join(base, "page_id")
    ok = lambda c: F.coalesce((c >= 200) & (c < 300), F.lit(False))
    words, base_words = (F.coalesce(c, F.lit(0)) for c in ("words", "words_0"))
    apart = F.abs(words - base_words)
    blocked = ok(F.col("code_0")) & ~ok(F.col("http_code"))
    cloaked = ok(F.col("code_0")) & ok(F.col("http_code")) & (apart > 50) & ((base_words == 0) | (apart > 0.2 * base_words))
    named = (F.coalesce("final_0", F.lit("")) != "") & (F.coalesce("final_url", F.lit("")) != "")
    return rows.select("page_id", "ua", cloaked.alias("cloaked"), blocked.alias("blocked"), (~blocked & named & (F.col("final_url") != F.col("final_0"))).alias("diverged"))


def ttfb_verdict(samples: DataFrame) -> DataFrame:
    """Upper median and positional 95th percentile of each page's successful response times (page_id, code, ms)."""
    good = samples.filter("code BETWEEN 200 AND 299").groupBy("page_id").agg(F.array_sort(F.collect_list("ms")).alias("ms"))
    n = F.size("ms")
    median = F.element_at("ms", (F.floor(n / 2) + 1).cast("int"))
    p95 = F.element_at("ms", F.least(F.floor(n * 0.95).cast("int") + 1, n))
    rows = samples.select("page_id").distinct().join(good.select("page_id", median.alias("median"), p95.alias("p95")), "page_id", "left")
    status = F.when(F.col("median").isNull(), "na").when(F.col("median") < 800, "pass").when(F.col("median") < 1800, "warn").otherwise("fail")
    return rows.withColumn("status", status)


def mobile_parity(desktop: DataFrame, mobile: DataFrame) -> DataFrame:
    """Both renderings of a page (page_id, words, title, h1, headings): ratio of words, lost headings and the verdict."""
    m = mobile.select("page_id", *[F.col(c).alias(f"m_{c}") for c in ("words", "title", "h1", "headings")])
    rows = desktop.join(m, "page_id", "left")
    lost = F.size(F.array_except("headings", "m_headings"))
    n = F.size(F.array_distinct("headings"))
    ratio = F.when(F.col("words") > 0, F.col("m_words") / F.col("words"))
    other = (F.col("title") != F.col("m_title")) | (F.col("h1") != F.col("m_h1"))
    status = (
        F.when(ratio.isNull(), "na")
        .when((ratio < 0.5) | ((n >= 3) & (lost * 2 > n)), "fail")
        .when((ratio < 0.85) | (lost > 0) | F.coalesce(other, F.lit(False)), "warn")
        .otherwise("pass")
    )
    return rows.select("page_id", py_round(ratio, 2).alias("ratio"), lost.alias("lost_headings"), status.alias("status"))


def schema_checks(entities: DataFrame, states: DataFrame) -> DataFrame:
    """``page_id, parse, present, no_invalid, ids, recommended, known_types`` of each page that has structured data.

    Both come from ``structured``: ``entities`` and, from ``entity_status``, ``states``.
    """
    judged = states.groupBy("page_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("invalid", "incomplete", "valid", "no_spec")])
    sums = entities.groupBy("page_id").agg(
        F.count_if(F.col("types").isNull()).alias("bad"), F.count("types").alias("n"), F.count_if(F.col("types").isNotNull() & (F.coalesce("entity_id", F.lit("")) == "")).alias("bare"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = sums.join(judged, "page_id", "left")
    state = lambda ok, bad="fail": F.when(F.col("n") == 0, "na").when(ok, "pass").otherwise(bad)
    return rows.select(
        "page_id", F.when(F.col("bad") == 0, "pass").otherwise("fail").alias("parse"), F.when(F.col("n") > 0, "pass").otherwise("fail").alias("present"), state(zero("invalid") == 0).alias("no_invalid"),
        F.when(F.col("n") == 0, "na").when(F.col("bare") == 0, "pass").when(2 * F.col("bare") >= F.col("n"), "fail").otherwise("warn").alias("ids"),
        state(zero("incomplete") == 0, "warn").alias("recommended"), state(zero("no_spec") == 0, "warn").alias("known_types"),
    )
