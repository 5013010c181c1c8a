"""Allowed addresses, retired guidance, kept verdicts and database reads, against the standard library and plain cases."""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import addresses, grounding, joins, verdicts
from lodestone.sources import tables

METADATA = {"169.254.169.254", "100.100.100.200", "fd00:ec2::254"}


def refused(text):
    """Whether a literal is refused; None where it is none."""
    try:
        ip = ipaddress.ip_address(text)
    except ValueError:
        return None
    ip = getattr(ip, "ipv4_mapped", None) or ip
    special = ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified
    return special or str(ip).split("%")[0] in METADATA


def literals():
    random.seed(5)
    for nets in addresses.RANGES.values():
        for net in map(ipaddress.ip_network, nets):
            for n in (int(net[0]) - 1, int(net[0]), int(net[-1]), int(net[-1]) + 1):
                if 0 <= n < 1 << net.max_prefixlen:
                    yield str(type(net[0])(n))
                    if net.version == 4:
                        yield f"::ffff:{ipaddress.IPv4Address(n)}"
    for _ in range(300):
        yield str(ipaddress.IPv4Address(random.getrandbits(32)))
        six = ipaddress.IPv6Address(random.getrandbits(128) & random.getrandbits(128) & random.getrandbits(128))
        yield from (str(six), six.exploded)
    yield from ["", "1.2.3", "01.2.3.4", "1.2.3.256", "1.2.3.4.5", "1.2.3.4%e", "::", ":::", "1::2::3", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::", "::1:2:3:4:5:6:7:8"]
    yield from ["1:2:3:4:5:6:1.2.3.4", "1::1.2.3", "1::1.2.3.4:5", "fe80::1%eth0", "12345::", "g::", ":1::", "::a.b.c.d", "1.2.3.4::", "FE80::A", "x" * 100_000]


def test_literals_and_their_ranges_are_those_of_the_standard_library(spark):
    texts = list(literals())
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string").withColumn("number", addresses.address(F.col("text")))
    got = {r["text"]: r["use"] for r in rows.withColumn("use", addresses.use_of(F.col("number"))).collect()}
    assert got.pop(None) is None
    assert {t: None if u is None else u != "" for t, u in got.items()} == {t: refused(t) for t in texts}


def test_urls(spark, monkeypatch):
    monkeypatch.setattr(joins, "LIGHT_ROWS", 3)
    cases = {
        None: "empty", "": "empty", " \n": "empty", "ftp://a.example/": "scheme", "a.example": "scheme", "javascript:alert(1)": "scheme",
        "http:///x": "host", "http://:80/": "host", "https://[1.2.3.4]/": "host", "https://[::1": "host", "https://[zz]/": "host",
        "http://u@a.example/": "credentials", "http://:p@a.example/": "credentials", "http://@open.example/": None, "http://a@127.0.0.1/": "credentials",
        "HTTPS://LOCALHOST:1/": "blocked", "http://metadata.google.internal": "blocked",
        "http://127.0.0.1:80": "loopback", "https://[::ffff:10.0.0.1]:8/": "private", "http://169.254.169.254/x": "metadata", "http://8.8.8.8?x": None,
        "https://[2606:4700::1]/": None, "http://127.1/": "unresolved", "https://unknown.example#a": "unresolved",
        "http://open.example/": None, "http://Mixed.example/": "private", "http://junk.example/": "unresolved", "http://\topen.example/": None,
    }
    answers = [("Open.example", "8.8.8.8"), ("open.example", "2606:4700::1"), ("mixed.example", "9.9.9.9"), ("mixed.example", "fd00::1"), ("mixed.example", "10.0.0.1"), ("junk.example", "none"), ("junk.example", None), (None, "10.0.0.1")]
    rows = spark.createDataFrame([(k, u, "kept") for k, u in enumerate(cases)] + [(100 + k, "http://open.example/", "kept") for k in range(40)], "id long, url string, Reason string")
    got = addresses.url_safety(rows, spark.createDataFrame(answers, "host string, address string"))
    assert got.columns == ["id", "url", "url_host", "allowed", "reason"]
    found = {r["id"]: r for r in got.collect()}
    assert {u: found[k]["reason"] for k, u in enumerate(cases)} == cases
    assert len(found) == len(cases) + 40 and all(r["allowed"] == (r["reason"] is None) for r in found.values())
    alone = addresses.url_safety(rows.filter("id < 100")).filter("reason = 'unresolved'")
    assert alone.count() == 0
    assert addresses.url_safety(rows.limit(0)).count() == 0


def test_own_ranges(spark):
    rows = spark.createDataFrame([("http://10.1.2.3/",), ("http://10.1.2.4/",), ("http://8.8.8.8/",)], "url string")
    got = addresses.url_safety(rows, ranges={"office": ["10.0.0.0/8"], "": ["10.1.2.4/32"]})
    assert [r["reason"] for r in got.collect()] == ["office", None, None]


@pytest.mark.parametrize(
    ("text", "feature"),
    [
        ("Add HowTo schema to guides", "howto"), ("We used a how-to structured data block", "howto"), ("Never use HowTo schema", None), ("Don't add howto markup", None),
        ("HowTo markup and, with luck, rich results", "howto"), ("HowTo markup. Rich results follow", None), ("how to rich snippet", "howto"), ("HowTo schema exists", None),
        ("Use HowTo schema; Google no longer shows it", None), ("FAQ schema helps pages qualify for rich results", "faq"), ("FAQPage markup makes it eligible for Q&A rich results", None),
        ("FAQ schema was deprecated and can't earn rich results", None), ("", None), (None, None), ("x " * 100_000 + "use howto schema", "howto"),
    ],
)
def test_retired_features(spark, text, feature):
    rows = spark.createDataFrame([("Name", text, 1)], "Name string, then_action string, id int")
    assert rows.select(grounding.retired_feature(rows)).first()[0] == feature


def test_curated_leaves_retired_guidance_out(spark):
    every = "kind string, id long, name string, tier int, confidence double, page_types array<string>, industries array<string>, status string, superseded_by string"
    rows = [("rule", k, n, 1, 0.9, None, None, "active", None) for k, n in enumerate(["Use HowTo schema", "Use headings", "HowTo schema is deprecated, so don't use HowTo schema"])]
    corpus = spark.createDataFrame(rows, every)
    asks = spark.createDataFrame([(1, "k", None, None)], "query_id long, key string, page_type string, industry string")
    got = grounding.curated(asks, corpus.selectExpr("'k' AS key", "kind", "id"), corpus)
    assert [(r["rank"], r["id"]) for r in got.orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_verdict_keys(spark):
    def short(x):
        return hashlib.sha256(x.encode()).hexdigest()[:16]

    schema = "check_id string, evidence string, kind string, id long, name string, condition string, action string, excerpt string"
    rows = [
        ("page:A2b_title", " Slow Page\n", "Rule", 7, "n" * 300, "c" * 400, None, "e" * 900), ("A2b_other", "slow page", "rule", 7, "n" * 200, "c" * 300, "", "e" * 500),
        ("plain", None, None, None, None, None, None, None), (None, "x", "ap", None, "A name", None, None, None),
    ]
    pairs = spark.createDataFrame(rows, schema)
    got = [r[0] for r in pairs.select(verdicts.verdict_key(pairs, "v", "m")).collect()]
    first = hashlib.sha256(f"v:m:rule:7:A2b:{short('slow page')}:{short('n' * 200 + chr(10) + 'c' * 300 + chr(10) * 2 + 'e' * 500)}".encode()).hexdigest()
    assert got[0] == got[1] == first
    assert got[2] == hashlib.sha256(f"v:m:?:?:plain:{short('')}:{short('(unnamed)' + chr(10) * 3)}".encode()).hexdigest()
    assert got[3] == hashlib.sha256(f"v:m:ap:A name:?:{short('x')}:{short('A name' + chr(10) * 3)}".encode()).hexdigest()
    assert pairs.select(verdicts.verdict_key(pairs, "v", "m2")).first()[0] != first


def at(day):
    return dt.datetime(2026, 1, day)


def test_first_writer_wins(spark, tmp_path):
    schema = "key string, verdict string, written timestamp, writer string"
    table = verdicts.VerdictTable(spark, str(tmp_path / "kept"))
    assert table.read().count() == 0
    table.append(spark.createDataFrame([("a", "supports", at(3), "x"), ("a", "related", at(2), "y"), ("b", "maybe", at(1), "x"), (None, "related", at(1), "x")], schema))
    table.append(spark.createDataFrame([("a", "unrelated", at(1), "z"), ("c", "supports", at(4), "z")], schema))
    verdicts.VerdictTable(spark, str(tmp_path / "kept"))
    assert {r["key"]: r["verdict"] for r in table.read().collect()} == {"a": "related", "c": "supports"}
    # Two writers that didn't see each other: both rows are there, and all readers take the same one.
    for writer, said in (("q", "related"), ("p", "unrelated")):
        spark.createDataFrame([("d", said, at(5), writer)], schema).write.mode("append").parquet(table.path)
    assert {r["key"]: r["verdict"] for r in table.read().collect()}["d"] == "unrelated"


def test_gate_comes_before_what_is_kept(spark, monkeypatch):
    monkeypatch.setattr(joins, "LIGHT_ROWS", 2)
    pairs = [(1, "a", "fail", False), (2, "a", "warn", True), (3, "b", "fail", True), (4, "c", "fail", True), (5, "d", "fail", True), (6, "a", "pass", True), (7, "a", "fail", None), (8, None, "fail", True)]
    pairs += [(20 + k, "a", "fail", True) for k in range(30)]
    rows = spark.createDataFrame(pairs, "n long, key string, status string, faithful boolean")
    said = lambda *r: spark.createDataFrame(list(r), "key string, verdict string")
    got = verdicts.stamp(rows, said(("a", "supports"), ("x", "related"), (None, "related")), said(("a", "unrelated"), ("b", "related"), ("b", "junk"), ("c", "junk")))
    found = {r["n"]: (r["entailment"], r["how"]) for r in got.collect()}
    assert {n: v for n, v in found.items() if n < 20} == {
        1: ("unjudged", "blocked"), 2: ("supports", "cached"), 3: ("related", "judged"), 4: ("unjudged", "invalid"), 5: ("unjudged", "unanswered"), 7: ("unjudged", "blocked"), 8: ("unjudged", "unanswered"),
    }
    assert len(found) == 37
    counts = verdicts.verdict_counts(got.withColumn("g", F.lit(1)), "g").first().asDict()
    assert counts == {"g": 1, "citations_seen": 37, "cache_hits": 31, "api_calls": 1, "source_unattested": 2, "errors": 1, "supports": 31, "related": 1, "unrelated": 0, "unjudged": 5}


def test_database_read(spark):
    url = "jdbc:derby:memory:guidance;create=true"
    rows = spark.range(1000).selectExpr("id * 3 + 7 AS id", "concat('n', id) AS name").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS id, 'none' AS name"))
    rows.write.format("jdbc").option("url", url).option("dbtable", "rules").mode("overwrite").save()
    assert tables.key_bounds(spark, url, "rules", "id") == ("7", "3004")
    got = tables.read_database(spark, url, "rules", "ID long, name string, added date", "ID", parts=5)
    assert got.columns == ["ID", "name", "added"] and got.rdd.getNumPartitions() == 5
    assert got.count() == 1001 and got.filter("added IS NOT NULL").count() == 0
    assert {r["ID"] for r in got.collect()} == {None, *range(7, 3007, 3)}
    # Rows are spread over the ranges, and only what is asked for is read.
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 5 and max(sizes) < 300
    plan = got.filter("name = 'n5'").select("name")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(name), *EqualTo(name,n5)]" in plan and "ReadSchema: struct<name:string>" in plan
    with pytest.raises(ValueError, match="no column"):
        tables.read_database(spark, url, "rules", "id long", "missing")
    spark.createDataFrame([], "id long").write.format("jdbc").option("url", url).option("dbtable", "bare").mode("overwrite").save()
    assert tables.read_database(spark, url, "bare", "id long", "id").count() == 0


def test_full_text_is_the_same_with_words_joined_by_shuffle(spark):
    docs = spark.createDataFrame([(k, " ".join(f"word{(k * j) % 13}" for j in range(30))) for k in range(40)] + [(99, None), (98, "")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "word1 word5 word5"), (2, "nothing"), (3, None), (4, "word12")], "query_id long, text string")
    rows = lambda n: sorted(tuple(r) for r in grounding.full_text(docs, queries, 5, broadcast_terms=n).collect())
    assert rows(0) == rows(1000)
    counts = {k: [f"word{(k * j) % 13}" for j in range(30)].count("word12") for k in range(40)}
    best = sorted((-n, k) for k, n in counts.items() if n)[:5]
    assert [r[2:] for r in rows(0) if r[0] == 4] == [(k, -n) for n, k in best]
