"""Pages are cut before patterns are tried: results as from the whole page, in few passes over it."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lodestone.functions import html as H
from lodestone.operators.checks import page_features
from lodestone.plans import guidance  # noqa: F401  (registers its queries)
from lodestone.plans.queries import QUERIES

ODD = [
    'a > b <p>text <b>bold</b> > more</p><h2 x="<h1 >">in <h1>x</h1></h2><img alt="<img src=a.webp" width=1><meta name="viewport"',
    "<metadata <META content='c' name='description' >t<h4>4</h4>u<h1>v</h1><a href='/x'>click here</a><nav><a href=/y>z</a></nav>",
    "plain text, no tags > at all",
    "",
]
PATTERNS = [
    r"(?i)<img[ \t\n\r\f]", r"(?i)<img[^>]*\bsrc=[\"']?[^\"'>]*\.(?:webp|avif|svg)\b", r"(?i)<h1[ \t\n\r\f>]", r"(?is)<nav\b.*?</nav>",
    r"(?is)<h2[^>]*>(.*?)</h2>", r"(?is)<meta[^>]*\bname=[\"']viewport[\"']", r"(?is)<meta\b[^>]*>",
]


def test_markup_holds_what_tags_hold(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "k long, html string").withColumn("tags", H.markup(F.col("html")))
    for name, found in [(None, F.col("tags")), ("meta", H.runs(F.col("tags"), "meta")), ("img", H.runs(F.col("tags"), "img"))]:
        for pattern in PATTERNS:
            if name is None or f"<{name}" in pattern:
                of = lambda x: F.regexp_count(x, F.lit(pattern))  # noqa: B023, E731
                assert [r for r in rows.select("k", of(F.col("html")).alias("whole"), of(found).alias("cut")).collect() if r.whole != r.cut] == []


def test_few_patterns_read_the_whole_page(spark):
    """Each is a pass over all of its text; there were 64 in one projection alone."""
    pages = spark.createDataFrame([(1, "https://a.example/", ODD[0])], "page_id long, url string, html string")
    plan = page_features(pages, F.lit("2026-06-20 12:00:00").cast("timestamp"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"(?:regexp_\w+|rlike|RLIKE)\((?:coalesce\()?html#", plan)) <= 30


def test_checks_know_their_method_without_patterns(spark):
    """What follows from a check's id is a literal, not worked out 62 times a page."""
    for name in ("section_status_counts", "shadow_scores", "audit_history"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "model-judgment" not in re.sub(r"Generate inline\(.*", "", plan)


def test_two_runs_share_their_features(spark):
    plan = QUERIES["run_comparison"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "inline(" not in plan
