"""Checks on pages that reach both sides of every verdict."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.functions import html as H
from lodestone.operators.checks import page_checks, page_features

CLEAN = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>A title that is long enough to pass the length check now</title>
<meta name="viewport" content="width=device-width"><meta name="description" content="{d}"><meta content="max-snippet:-1" name="robots">
<meta property="og:title" content="t"><meta property="og:description" content="d"><meta property="og:image" content="i">
<link rel="alternate" hreflang="de" href="http://x.example/de"><link rel="alternate" hreflang="fr" href="https://x.example/fr">
<script type="application/ld+json">{{"@type": "Article"}}</script></head><body><article><h1>One</h1><p>By Jane Doe. Costs 9 EUR. {w}</p>
<h2>What is it?</h2><h3>Why now?</h3><img src="a.webp" width="1" height="2"><a href="/about">About us</a><a href="/contact">Contact</a>
<a href="https://x.example/p">Editorial policy</a><!-- hidden <b>no</b> --></article></body></html>""".format(d="d" * 130, w="word " * 600)
BROKEN = """<html><head><title>Short</title><meta name="description" content="Short"><meta name="robots" content="noindex, nosnippet, noarchive">
<script src="http://x.example/a.js"></script><script src="b.js"></script><link rel="stylesheet" href="http://x.example/c.css"></head>
<body><article><h1>a</h1><h1>b</h1><h1>c</h1><img src="http://x.example/i.png"><a href="http://other.example/">click here</a><a href="//y">here</a><a href="#">more</a></article></body></html>"""


@pytest.fixture(scope="module")
def verdicts(spark):
    pages = spark.createDataFrame(
        [(1, "https://X.example/p", CLEAN), (2, "https://x.example/q", BROKEN), (3, "http://x.example/r", None), (4, None, "")], "page_id long, url string, html string"
    )
    return {(r.page_id, r.check_id.split("_")[0]): r.status for r in page_checks(page_features(pages)).collect()}


@pytest.mark.parametrize("check", ["A2", "A3", "A5", "A6", "A8", "A9", "A12", "B2", "B9", "B11", "C3", "C4", "C10", "D14", "D1", "E4", "E12", "E5b", "F6b", "F8b", "G1", "G7b", "G7c"])
def test_clean_page_passes(verdicts, check):
    assert verdicts[1, check] == "pass"


@pytest.mark.parametrize(
    ("check", "status"),
    [("A2", "fail"), ("A3", "warn"), ("A5", "fail"), ("A6", "fail"), ("A8", "fail"), ("A9", "fail"), ("A12", "fail"), ("B2", "fail"), ("B9", "fail"), ("B11", "fail"),
     ("C3", "fail"), ("C4", "fail"), ("C10", "fail"), ("D14", "na"), ("D1", "fail"), ("E4", "fail"), ("E12", "fail"), ("F6b", "warn"), ("F8b", "fail"), ("G1", "fail"), ("G7b", "fail"), ("G7c", "warn")],
)
def test_broken_page(verdicts, check, status):
    assert verdicts[2, check] == status


def test_empty_pages_have_verdicts(verdicts):
    assert verdicts[3, "A1"] == "fail" and verdicts[3, "B9"] == "na" and verdicts[4, "G1"] == "na"


def test_text_functions(spark):
    row = spark.createDataFrame([("<p>a&amp;b <script>x</script><STYLE>y</style> c&nbsp;d</p>", "https://WWW.x.example:80/a/b/?q#f")], "h string, u string").select(
        H.visible_text(F.col("h")).alias("text"), H.host_of(F.col("u")).alias("host"), H.bare_domain(F.col("u")).alias("domain"),
        H.url_key(F.col("u")).alias("key"), H.url_specificity(F.col("u")).alias("spec"), H.looks_like_question(F.lit("Wie geht das")).alias("asks"),
    ).first()
    assert (row.text, row.host, row.domain, row.key, row.spec, row.asks) == ("a&b c d", "www.x.example", "x.example", "https://www.x.example:80/a/b/?q", 0, True)
