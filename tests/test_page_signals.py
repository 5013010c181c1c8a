"""Directives, headers, questions, structured data, grounding and gates, case by case."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestone.functions import html as H
from lodestone.operators import corpus, grounding
from lodestone.operators.checks import CHECKS, LIGHT, page_checks, page_features
from lodestone.streaming import jobs

LD = '<script type="application/ld+json">{}</script>'
FAQ = LD.format('{"@type":"FAQPage","mainEntity":[{"@type":"Question","name":"What is it?"},{"@type":"Question","name":"Is it \\u201cfree\\u201d?"}]}')
SHOWN = '<details><summary>What is it?</summary>a</details><details><summary>Is it "free"?</summary>b</details>'
PERSON = '{"@type":"Person","@id":"#p","name":"Ann Lee","jobTitle":"Dr"}'
GEO = '"geo":{"latitude":1,"longitude":2},"address":{"addressLocality":"Köln"}'
COLUMNS = "page_id long, url string, html string, status int, headers map<string,string>, final_url string, probe_status int, probe_final string, canonical_status int, llms_status int, llms_body string"
BASE = ("https://x.example/p", "", 200, {}, None, 200, "https://x.example/p", 404, None, None)
NAMES = ["url", "html", "status", "headers", "final_url", "probe_status", "probe_final", "canonical_status", "llms_status", "llms_body"]
# What is changed of a plain page, the check, and its verdict.
CASES = [
    ({"html": '<meta name="robots" content="max-image-preview:none">'}, "A5", "pass"), ({"html": "<meta content='NOINDEX , follow' name='Googlebot'>"}, "A5", "fail"),
    ({"headers": {"x-robots-tag": "otherbot: none"}}, "A5", "fail"), ({"headers": {"X-ROBOTS-TAG": "max-snippet: 0"}}, "E4", "fail"), ({"html": "<meta name=bingbot content=max-snippet:49>"}, "E4", "warn"),
    ({"html": "<p data-nosnippet>x</p>"}, "E4", "warn"), ({"html": '<meta name="robots" content="noarchived">'}, "E12", "pass"),
    ({"headers": {"strict-transport-security": "max-age=1"}}, "A1", "pass"), ({}, "A1", "warn"), ({"probe_final": "http://x.example/p"}, "A1", "fail"), ({"final_url": "http://x.example/p"}, "A1", "fail"),
    ({"url": "http://x.example/p", "final_url": "https://x.example/p", "probe_final": None, "headers": {"Strict-Transport-Security": "1"}}, "A1", "pass"), ({"probe_status": 0, "probe_final": None, "headers": {"Strict-Transport-Security": "1"}}, "A1", "pass"),
    ({"html": '<a href="/privacy">Privacy policy</a>'}, "G7c", "warn"), ({"html": '<a href="/editorial-policy">How we work</a>'}, "G7c", "pass"), ({"html": '<a href="/kontakt">x</a><a href="/y">About us</a>'}, "G7b", "pass"),
    ({"html": '<link rel="canonical" href="/p#top">'}, "A4b", "pass"), ({"html": '<link rel="canonical" href="/P">', "canonical_status": 301}, "A4b", "fail"), ({"html": '<link href="" rel="canonical">'}, "A4b", "warn"), ({}, "A4b", "warn"),
    ({"html": "<h2>a <h1>b</h1></h2>"}, "A7b", "fail"), ({"html": "<h2>a <h3>c</h3><h1>b</h1></h2>"}, "A7b", "pass"),
    ({"html": FAQ + SHOWN}, "D9", "pass"), ({"html": FAQ}, "D9", "fail"), ({"html": FAQ + "<p>What is it? Is it 'free'?</p>"}, "D9", "warn"), ({}, "D9", "na"), ({"html": FAQ + SHOWN.replace("What is it", "Who are you")}, "D9", "warn"),
    ({"html": SHOWN}, "F3b", "warn"), ({"html": FAQ + SHOWN}, "F3b", "pass"), ({"html": "<details><summary>France</summary></details>"}, "F3b", "fail"),
    ({"html": LD.format(PERSON)}, "D12", "warn"), ({"html": LD.format('{"author":[{"@type":["X","Person"],"hasCredential":"MD"}]}')}, "D12", "pass"), ({"html": LD.format('{"@type":"Thing"')}, "D12", "fail"),
    ({"html": LD.format('[{"@type":"BlogPosting","author":{"@id":"#p"}},' + PERSON + "]")}, "G2", "pass"), ({"html": LD.format('{"@type":"Article","author":"Jo"}')}, "G2", "warn"), ({"html": LD.format('{"@type":"Report"}')}, "G2", "fail"), ({"html": LD.format(PERSON)}, "G2", "na"),
    ({"html": LD.format('{"@graph":[{"@type":"Person","@id":"#a"},{"@type":"Thing"},{"@type":"X","@id":"#b"}]}')}, "D4", "warn"), ({"html": LD.format('{"@type":"Thing"}')}, "D4", "fail"), ({"html": LD.format(PERSON)}, "D4", "pass"),
    ({"html": LD.format('{"@type":["Thing","Dentist"],' + GEO + "}")}, "D15", "pass"), ({"html": LD.format('{"@type":"Hotel","address":"x"}')}, "D15", "warn"), ({"html": LD.format(PERSON)}, "D15", "fail"),
    ({"html": "<title>Zahnarzt köln</title>" + LD.format('{"@type":"Dentist",' + GEO + "}")}, "C13", "pass"), ({"html": "<p>in Köln</p>" + LD.format('{"@type":"Dentist",' + GEO + "}")}, "C13", "warn"), ({"html": LD.format('{"@type":"Dentist",' + GEO + "}")}, "C13", "fail"), ({}, "C13", "na"),
    ({"html": LD.format('{"@type":"Article","dateModified":"2026-06-20T11:59:30Z"}')}, "C12b", "fail"), ({"html": LD.format('{"@type":"Article","dateModified":"2026-06-20"}')}, "C12b", "pass"), ({"html": LD.format('{"@type":"Article","dateModified":"2025-06-20"}')}, "C12b", "warn"),
    ({"llms_status": 200, "llms_body": "# x"}, "E14", "pass"), ({"llms_status": 200, "llms_body": " <!doctype HTML>"}, "E14", "fail"), ({"llms_status": 404}, "E14", "fail"), ({"llms_status": 503}, "E14", "na"), ({"llms_status": 200, "llms_body": " "}, "E14", "fail"),
    ({"html": '<script>{\\"hrefLang\\":\\"de-DE\\"}</script>'.replace("\\\\", "\\")}, "D14", "warn"), ({"html": "<p>Wegovy and W3govy</p>"}, "J2", "fail"), ({"html": "<p>W3govy</p>"}, "J2", "pass"),
    ({"html": "<article>By using this</article>"}, "G1", "fail"), ({"html": "<p>Reviewed by Ann Lee</p>"}, "G1", "pass"), ({"html": LD.format('{"@type":"Article","author":"Jo Doe"}')}, "G1", "warn"),
    ({"html": LD.format('{"@type":"Hotel","priceRange":"$$"}')}, "F8b", "warn"), ({"status": 500}, "A5", "na"), ({"status": 0}, "F3b", "na"),
]


@pytest.fixture(scope="module")
def verdicts(spark):
    plain = dict(zip(NAMES, BASE))
    rows = [(k, *[(plain | change)[n] for n in NAMES]) for k, (change, *_) in enumerate(CASES)]
    features = page_features(spark.createDataFrame(rows, COLUMNS), F.lit("2026-06-20 12:00:00").cast("timestamp"))
    return {(r.page_id, r.check_id.split("_")[0]): r.status for r in page_checks(features).collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_verdict(verdicts, k):
    _, check, want = CASES[k]
    assert verdicts[k, check] == want, CASES[k]


def test_light_profile(spark):
    pages = spark.createDataFrame([(1, "https://x.example/", SHOWN), (2, "https://x.example/", FAQ), (3, "https://x.example/", None)], "page_id long, url string, html string")
    got = {(r.page_id, r.check_id.split("_")[0]): r.status for r in page_checks(page_features(pages), LIGHT).collect()}
    assert [got[k, "D9"] for k in (1, 2, 3)] == ["warn", "fail", "na"] and len({c.id for c in LIGHT}) == 8
    assert len({c.id for c in CHECKS}) == len(CHECKS) >= 60


@pytest.mark.parametrize(
    ("text", "hints"),
    [("LCP: 12,417 ms", "12.4 seconds load time speed"), ("took 2 min", "120 seconds load time speed"), ("a 1,536 kb page", "1.5 mb megabytes page size weight"), ("512 bytes", "0.5 kb kilobytes page size weight"),
     ("33.3% of 40 images", "33.3 percent percentage ratio image count"), ("version v2.3s and page-2s", ""), ("1,200 words in 3 s", "3 seconds load time speed word count"), (None, "")],
)
def test_numeric_hints(spark, text, hints):
    got = spark.createDataFrame([(text,)], "t string").select(F.array_join(grounding.numeric_hints(F.col("t")), " ").alias("h")).first().h
    assert got[: len(hints)] == hints and (hints or got == "")


def test_query_texts_and_fixes(spark):
    rows = spark.createDataFrame([("page:B1_ttfb_median", "Slow:  900 ms"), ("A2_title_tag", None), ("odd", " ")], "c string, e string")
    got = [r.q for r in rows.select(grounding.query_text(F.col("c"), F.col("e")).alias("q")).collect()]
    assert got == ["slow: 900 ms ttfb median performance core web vitals speed 0.9 seconds load time", "title tag technical seo crawl index", "odd"]
    row = spark.range(1).select(grounding.supports_fix(F.lit("add alpha beta gamma"), F.lit("alpha beta gamma delta")).alias("yes"), grounding.supports_fix(F.lit(""), F.lit("alpha")).alias("none")).first()
    assert (row.yes, row.none) == (True, False)


def test_urls(spark):
    base = F.lit("https://X.example/a/b?q#f")
    refs = ["c", "/c", "?z", "#t", "", "//y.example/d", "http://z.example"]
    got = spark.range(1).select(*[H.join_url(base, F.lit(ref)).alias(f"c{k}") for k, ref in enumerate(refs)], H.same_page_key(base).alias("key")).first()
    assert list(got) == ["https://X.example/a/c", "https://X.example/c", "https://X.example/a/b?z", "https://X.example/a/b?q#t", "https://X.example/a/b?q", "https://y.example/d", "http://z.example", "https://x.example/a/b?q"]


def test_two_broken_checks_in_a_row(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    at = dt.datetime(2026, 1, 1)
    rows = [("u", at + dt.timedelta(hours=k), k, v) for k, v in enumerate(["ok", "broken", "broken", "broken", "ok", "broken"])] + [("v", at, 9, "broken")]
    schema = "url string, ts timestamp, check_id long, verdict string"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = jobs.broken_twice(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("twice").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.url, r.check_id) for r in spark.table("twice").collect()} == {("u", 2), ("u", 3)}


def test_scores_of_unreached_pages(spark):
    scores = spark.createDataFrame([(1, 80.0, "B+"), (2, 70.0, "C+"), (3, None, "INCONCLUSIVE")], "audit_id long, pcr double, grade string")
    gone = spark.createDataFrame([(2, True)], "audit_id long, unreached boolean")
    assert {r.audit_id: (r.pcr, r.grade) for r in corpus.finalised(scores, gone).collect()} == {1: (80.0, "B+"), 2: (None, "INCONCLUSIVE"), 3: (None, "INCONCLUSIVE")}
