from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestone.operators import crawl, structured
from lodestone.plans import queries
from lodestone.sources import tables
from lodestone.streaming import jobs

ROBOTS = """# rules
User-agent: *
Disallow: /private
Allow: /private/open
User-agent: GPTBot
User-agent: google-ext
Disallow: /
User-agent: ClaudeBot
"""


def test_robots(spark):
    files = spark.createDataFrame([("h", ROBOTS), ("n", "")], "host string, body string")
    paths = spark.createDataFrame([("h", "/private/x"), ("h", "/private/open/y"), ("h", "/"), ("n", "/")], "host string, path string")
    got = {(r.host, r.path, r.bot): r.allowed for r in crawl.robots_access(crawl.robots_rules(files), paths).collect()}
    assert got["h", "/private/x", "Googlebot"] is False and got["h", "/private/open/y", "Googlebot"] is True
    assert got["h", "/", "GPTBot"] is False and got["h", "/", "Google-Extended"] is False and got["h", "/", "CCBot"] is True
    # What no rule forbids is allowed: a group without rules, and a file without groups.
    assert got["h", "/private/x", "ClaudeBot"] is True and got["n", "/", "GPTBot"] is True
    access = crawl.robots_access(crawl.robots_rules(files), paths.filter("path = '/'"))
    assert {r.host: r.ai_bot_allowed for r in crawl.gate_access(access).collect()} == {"h": False, "n": True}
    for code, want in ((404, True), (200, True), (503, None), (0, None)):
        files = spark.createDataFrame([("n", code)], "host string, code int")
        assert {r.host: r.ai_bot_allowed for r in crawl.gate_access(access, files).collect()} == {"h": False, "n": want}


@pytest.mark.parametrize(("rule", "path", "allowed"), [("/a*b$", "/axxb", False), ("/a*b$", "/axxbc", True), ("/a.b", "/axb", True), ("", "/x", True), ("/", "/x", False)])
def test_robots_patterns(spark, rule, path, allowed):
    files = spark.createDataFrame([("h", f"User-agent: *\nDisallow: {rule}")], "host string, body string")
    got = crawl.robots_access(crawl.robots_rules(files), spark.createDataFrame([("h", path)], "host string, path string"), ["Bingbot"]).first()
    assert got.allowed is allowed


def test_sitemaps(spark):
    index = "<sitemapindex xmlns='x'><sitemap><loc>b.xml</loc></sitemap><sitemap><loc>a.xml</loc></sitemap></sitemapindex>"
    urls = '<urlset xmlns="http://s"><url><loc><![CDATA[https://x.example/?a=1&b=2]]></loc><lastmod>2026-01-01</lastmod></url><url><loc>https://x.example/?c&amp;d</loc></url></urlset>'
    maps = spark.createDataFrame([("h", "a.xml", index), ("h", "b.xml", urls), ("h", "c.xml", "oops")], "host string, sitemap string, body string")
    entries = crawl.sitemap_entries(maps)
    found = crawl.walk_sitemaps(entries, spark.createDataFrame([("h", "a.xml")], "host string, sitemap string"))
    assert {(r.loc, r.depth) for r in found.collect()} == {("https://x.example/?a=1&b=2", 1), ("https://x.example/?c&d", 1)}
    assert crawl.sitemap_coverage(found).first().status == "warn"
    assert entries.filter("kind = 'parse_error'").count() == 1


def test_probes(spark):
    none = F.array().cast("array<string>")
    cases = [(0, 900, "fetch_failed"), (308, 0, "unresolved_redirect"), (403, 900, "bot_blocked"), (500, 900, "http_error"), (200, 100, "minimal_content"), (200, 300, "partial_ssr"), (200, 500, "fully_accessible")]
    rows = spark.createDataFrame(cases, "code int, words int, want string").withColumn("got", crawl.rendering_class(F.col("code"), F.lit(False), F.col("words"), none))
    assert rows.filter("got <> want").count() == 0
    samples = spark.createDataFrame([(1, 200, 100), (1, 200, 900), (1, 500, 5000), (2, 404, 10)], "page_id long, code int, ms int")
    assert {r.page_id: (r.median, r.status) for r in crawl.ttfb_verdict(samples).collect()} == {1: (900, "warn"), 2: (None, "na")}


def test_parity(spark):
    schema = "page_id long, words int, title string, h1 string, headings array<string>"
    full = (600, "t", "h", ["a", "b", "c", "d"])
    desktop = spark.createDataFrame([(k, *full) for k in range(4)], schema)
    mobile = spark.createDataFrame([(0, *full), (1, 200, "t", "h", ["a"]), (2, 600, "t", "h", ["a", "b", "c"])], schema)
    assert {r.page_id: r.status for r in crawl.mobile_parity(desktop, mobile).collect()} == {0: "pass", 1: "fail", 2: "warn", 3: "na"}


def test_jsonld(spark):
    html = '<script type="application/ld+json">{"@graph": [{"@type": ["X", "LocalBusiness"], "@id": "#a", "address": {"@type": "PostalAddress"}}]}</script><script type="application/ld+json">{oops</script>'
    got = structured.entities(spark.createDataFrame([(1, html)], "page_id long, html string"))
    assert {(r.block, r.depth, r.type) for r in got.collect()} == {(0, 1, "X"), (0, 2, "PostalAddress"), (1, 0, None)}
    specs = spark.createDataFrame([("X", "required", "name"), ("PostalAddress", "recommended", "streetAddress")], "type string, tier string, field string")
    assert {(r.type, r.status) for r in structured.entity_status(got, specs).collect()} == {("X", "invalid"), ("PostalAddress", "incomplete")}
    local = spark.createDataFrame([("LocalBusiness", "google_required", "address"), ("LocalBusiness", "required", "address")], "type string, tier string, field string")
    assert {(r.type, r.status) for r in structured.entity_status(got, local).collect()} == {("LocalBusiness", "valid"), ("PostalAddress", "no_spec")}
    row = crawl.schema_checks(got, structured.entity_status(got, specs)).first()
    assert (row.parse, row.present, row.no_invalid, row.ids, row.recommended, row.known_types) == ("fail", "pass", "fail", "fail", "warn", "pass")


def _drain(spark, stream, mode, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_idempotent_starts(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    at = dt.datetime(2026, 1, 1)
    rows = [("t", "a", at, False), ("t", "b", at + dt.timedelta(seconds=30), False), ("t", "c", at + dt.timedelta(seconds=61), False), ("u", "x", at, True), ("u", "y", at + dt.timedelta(seconds=5), False)]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "target string, job_id string, ts timestamp, failed boolean"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    got = _drain(spark, jobs.idempotent_starts(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "append", tmp_path, "starts")
    assert {r.job_id: r.answered_by for r in got} == {"a": "a", "b": "a", "c": "c", "x": "x", "y": "y"}


def test_repeats_within_the_watermark(spark, tmp_path):
    at = dt.datetime(2026, 1, 1)
    spark.createDataFrame([(1, at), (1, at), (2, at)], "event_id long, ts timestamp_ntz").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp_ntz").parquet(str(tmp_path / "in"))
    assert len(_drain(spark, jobs.first_events(stream, ["event_id"]), "append", tmp_path, "once")) == 2


def test_drained_streams_are_files(spark, tmp_path):
    """The whole result is written by the tasks and read from files, not held in the driver."""
    at = dt.datetime(2026, 1, 30)
    rows = [(k, at + dt.timedelta(minutes=k * m), k % 3, "ab"[k % 2], 1.5) for m in (7, 200) for k in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    next((tmp_path / "in").glob("part-*.parquet")).rename(tmp_path / "events.parquet")
    for name, batch in (("tumbling", jobs.tumbling_counts), ("monthly_usage", jobs.monthly_usage), ("sessions", jobs.sessions)):
        got = queries.QUERIES[f"stream_{name}"](spark, str(tmp_path))
        want = batch(queries.read(spark, str(tmp_path), "events"))
        assert got.inputFiles() and got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sources(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"id": "1", "title": "a"}, {"title": "b"}, {"id": "1", "title": "c"}]')
    got = tables.read_snapshot(spark, str(tmp_path / "s.json"), "id string, title string").collect()
    assert [(r.id, r.title) for r in got] == [("1", "c")]
    wide = tables.with_columns(spark.createDataFrame([("1",)], "ID string"), "id string, status string")
    assert wide.columns == ["id", "status"] and wide.first().status is None
    (tmp_path / "t.md").write_text("héllo")
    assert tables.read_text(spark, str(tmp_path / "t.md")).first().size == 6
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert tables.read_lines(spark, str(tmp_path / "l.jsonl"), "a int").count() == 2
