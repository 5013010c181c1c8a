"""Verdicts that follow fixed rules, each case written from the rule and not from the code."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.operators import corpus, crawl, grounding

ALL_TEN = "".join(f"User-agent: {b}\n" for b in crawl.AI_CRAWLERS) + "Allow: /\nSitemap: https://h.example/s.xml"
FILES = {
    "named": (200, ALL_TEN), "plain": (200, "User-agent: *\nDisallow: /private"), "gpt": (200, "User-agent: GPTBot\nDisallow: /"), "bing": (200, "User-agent: Bingbot\nDisallow: /"),
    "blank": (200, " \n "), "absent": (404, ""), "lost": (503, ALL_TEN), "silent": (0, None), "nine": (200, ALL_TEN.replace("User-agent: CCBot\n", "")),
}


@pytest.fixture(scope="module")
def robots(spark):
    files = spark.createDataFrame([(h, c, b) for h, (c, b) in FILES.items()], "host string, code int, body string")
    return crawl.robots_access(crawl.robots_rules(files), files.select("host", F.lit("/x").alias("path"))), files


def test_robots_checks(robots):
    got = {(r.host, r.check): r.status for r in crawl.robots_checks(*robots).collect()}
    per = lambda check: {h: got[h, check] for h in FILES}
    gone = dict.fromkeys(("absent", "lost", "silent"), "warn")
    read = dict.fromkeys(("named", "plain", "gpt", "bing", "blank", "nine"), "pass")
    assert per("reachable") == read | {"blank": "warn"} | dict.fromkeys(gone, "fail")
    assert per("declares_sitemap") == dict.fromkeys(read, "warn") | {"named": "pass", "nine": "pass"} | dict.fromkeys(gone, "na")
    assert per("googlebot") == read | gone
    assert per("ai_crawlers_all") == dict.fromkeys(read, "warn") | {"named": "pass", "gpt": "fail"} | gone
    assert per("target_path") == read | {"gpt": "fail", "bing": "fail"} | gone


def test_robots_findings(robots):
    got = {(r.host, r.check_id): r.status for r in crawl.robots_findings(*robots).collect()}
    assert {c for (h, c), s in got.items() if h == "gpt" and s == "fail"} == {"E10", "A10"}
    assert {c for (h, c), s in got.items() if h == "bing" and s == "fail"} == {"E2", "A10"}
    for host in ("absent", "lost", "silent"):
        assert {c: s for (h, c), s in got.items() if h == host} == dict.fromkeys(("E1", "E2", "E3", "E10", "E13", "A10"), "warn") | {"A11": "na"}
    assert got["blank", "A10"] == "pass" and got["blank", "A11"] == "warn" and got["named", "A11"] == "pass"


def test_probes_by_agent(spark):
    rows = [
        (1, "default", 200, 300, "u"), (1, "a", 200, 365, "u"), (1, "b", 200, 360, "u"), (1, "c", 403, 5, "v"), (1, "d", 200, 300, "v"), (1, "e", 200, 300, ""),
        (2, "default", 500, 300, "u"), (2, "a", 200, 10, "v"), (3, "default", 200, 0, "u"), (3, "a", 200, 51, "u"), (3, "b", 200, 0, "u"), (4, "default", 200, 200, None), (4, "a", 200, 250, "u"),
    ]
    got = {(r.page_id, r.ua): (r.cloaked, r.blocked, r.diverged) for r in crawl.cross_agent(spark.createDataFrame(rows, "page_id int, ua string, http_code int, words int, final_url string")).collect()}
    assert got[1, "a"] == (True, False, False) and got[1, "b"] == (False, False, False) and got[1, "c"] == (False, True, False) and got[1, "d"] == (False, False, True)
    assert got[1, "e"] == (False, False, False) and got[2, "a"] == (False, False, True) and got[3, "a"] == (True, False, False) and got[3, "b"] == got[4, "a"] == (False, False, False)


def test_light_gates(spark):
    cases = [
        ("fully_accessible", False, 200, "pass", "pass", "pass"), ("spa_no_ssr", False, 200, "pass", "fail", "pass"), ("http_error", False, 404, "warn", "fail", "fail"), ("fetch_failed", None, None, "warn", "fail", "fail"),
        ("bot_blocked", False, 200, "fail", "fail", "pass"), ("partial_ssr", True, 200, "fail", "warn", "pass"), ("minimal_content", False, 503, "fail", "warn", "pass"), ("js_dependent", False, 0, "warn", "fail", "pass"), (None, False, 200, "pass", "fail", "pass"),
    ]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "page_id int, rendering string, bot_blocking boolean, robots_code int, c string, a string, e string")
    got = {r.page_id: (r.crawlability, r.content_access, r.page_existence) for r in corpus.light_gates(df).collect()}
    assert got == {k: c[3:] for k, c in enumerate(cases)}


def test_sitemap_bands(spark):
    urls = [("h", f"https://h.example/{k}") for k in range(10)] + [("o", "https://o.example/a/"), ("o", "https://elsewhere.example/")]
    urls = [(h + ".example", u) for h, u in urls]
    targets = spark.createDataFrame([("h.example", "http://www.h.example/3/"), ("o.example", "https://o.example/b")], "host string, url string")
    df = spark.createDataFrame(urls, "host string, loc string")
    alive = lambda codes: {r.host: r for r in crawl.sitemap_checks(df, targets, spark.createDataFrame([(f"https://h.example/{k}", c) for k, c in enumerate(codes)], "loc string, code int")).collect()}
    got = alive([200] * 9 + [404])
    assert (got["h.example"].target, got["h.example"].one_domain, got["h.example"].alive) == ("pass", "pass", "pass")
    assert (got["o.example"].target, got["o.example"].one_domain, got["o.example"].alive) == ("fail", "warn", "na")
    assert [alive(c)["h.example"].alive for c in ([200] * 7 + [404] * 3, [200] * 6 + [404] * 4, [200, 403], [403], [301, 200], [403, 404])] == ["warn", "fail", "warn", "warn", "pass", "fail"]
    # Two files of 50,000 are well; one of 50,001 is not.
    entries = spark.range(100_001).select(F.lit("h.example").alias("host"), F.when(F.col("id") < 50_000, "a").otherwise("b").alias("sitemap"), F.lit("urlset").alias("kind"), F.col("id").cast("string").alias("loc"))
    none = spark.createDataFrame([], "loc string, code int")
    assert crawl.sitemap_checks(df, targets, none, entries).filter("host = 'h.example'").first().size == "fail"
    assert crawl.sitemap_checks(df, targets, none, entries.filter("loc <> '60000'")).filter("host = 'h.example'").first().size == "pass"


def test_regrounding(spark):
    body = "structured data helps answer engines cite pages"
    rows = spark.createDataFrame([("rule", "1", body), ("ap", "1", "compress images early"), ("principle", "2", body)], "kind string, id string, body string")
    cites = [
        (1, "rule", "1", "structured data helps engines", "rule", "kept"), (2, "rule", "1", "compress images early", "ap", "recovered"), (3, "rule", "1", None, "rule", "kept"), (4, "rule", "1", "gardening weather tulips", "rule", "lost"),
        (5, "rule", "2", None, "rule", "lost"), (6, "rule", "2", "structured data helps engines", "principle", "recovered"), (7, "ap", "9", "structured data", "ap", "lost"),
    ]
    got = grounding.reground(spark.createDataFrame([c[:4] for c in cites], "cite_id int, kind string, id string, text string"), rows)
    assert {r.cite_id: (r.kind, r.state) for r in got.collect()} == {c[0]: c[4:] for c in cites}


def test_vocabulary(spark):
    canon = spark.createDataFrame([("A2_title_present",), ("A5_robots_meta",), ("A2b_title_unique",)], "canonical string")
    aliases = spark.createDataFrame([("A5_crawl_tags", "A5_robots_meta")], "variant string, canonical string")
    cases = [
        (1, 1, "A2_title_tag", "A2_title_present", "aliased"), (1, 2, "A2_title_length", "A2_title_length", "foreign"), (1, 3, "A2b_titles_differ", "A2b_titles_differ", None), (1, 4, "A2b_title_unique", "A2b_title_unique", "canonical"),
        (1, 5, "A5_crawl_tags", "A5_robots_meta", "aliased"), (2, 1, "A5_present_page", "A5_present_page", "foreign"), (2, 2, "A2_title_tag", "A2_title_tag", "foreign"), (2, 3, "A2_title_present", "A2_title_present", "canonical"),
        (2, 4, "Z9_title", "Z9_title", "foreign"), (2, 5, "A2", "A2", "foreign"),
    ]
    got = grounding.canonical_checks(spark.createDataFrame([c[:3] for c in cases], "audit_id int, ord int, check_id string"), canon, aliases)
    assert sorted(map(tuple, got.collect())) == sorted(cases)
