"""Scores held against values worked out by hand."""

from __future__ import annotations

import statistics

import pytest
from pyspark.sql import functions as F

from lodestone.functions.rounding import clamp, loose_number, py_round
from lodestone.operators import scoring
from lodestone.plans import queries

SCHEMA = "audit_id string, ord int, check_id string, section string, status string, severity string, observed_method string"
MIXED = [
    ("A1", "A", "fail", "measured-on-page"), ("A6", "A", "pass", None), ("B1", None, "pass", "measured-on-page"), ("C1", "C", "warn", None),
    ("F3", "F", "fail", "model-judgment"), ("H1", "H", "warn", "observed-off-page"), ("E9", "E", "pass", None), ("J1", "J", "pass", None),
    ("I2", "I", "pass", None), ("D9", "D", "na", None),
]


def rows(spark, items, audit="a"):
    return spark.createDataFrame([(audit, k, c, s, st, "high", m) for k, (c, s, st, m) in enumerate(items)], SCHEMA)


def test_rounding_is_exact_half_even(spark):
    values = [(58.55, 58.5), (0.25, 0.2), (41.25, 41.2), (66.85, 66.8), (0.35, 0.3), (-17.45, -17.4), (12345.65, 12345.6)]
    got = spark.createDataFrame([(v,) for v, _ in values], "v double").select(py_round(F.col("v"), 1).alias("r")).collect()
    assert [r.r for r in got] == [w for _, w in values]


def test_clamp_and_loose_numbers(spark):
    got = spark.createDataFrame([("87.5/100",), ("true",), (None,), ("x",)], "t string").select(loose_number(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [87.5, None, None, None]
    assert spark.range(1).select(clamp(F.lit(120.0)).alias("c")).first().c == 100.0


def test_mixed_evidence(spark):
    got = scoring.audit_scores(rows(spark, MIXED)).first()
    assert [got[f"score_{s}"] for s in "ABCDEFGHIJ"] == [50.0, 100.0, 50.0, None, 100.0, 0.0, None, 50.0, 100.0, 100.0]
    assert (got.pcr, got.grade) == (58.6, "D+")
    assert (got.shadow, got.shadow_grade, got.shadow_delta) == (41.2, "F", -17.4)
    assert (got.findings_backed, got.findings_total) == (3, 8)


def test_brand_presence_and_combined(spark):
    got = scoring.brand_presence(rows(spark, MIXED)).first()
    assert (got.bap, got.bap_confidence) == (100.0, "low")
    pair = spark.range(1).select(scoring.combined(F.lit(58.6), F.lit(100.0)).alias("x"), scoring.combined(F.lit(58.6), F.lit(None).cast("double")).alias("y")).first()
    assert (pair.x, pair.y) == (66.9, 58.6)


def test_last_status_of_a_brand_check_counts(spark):
    again = rows(spark, [("I1", "I", "fail", None), ("I1_x", "I", "pass", None), ("I4", "I", "na", None)])
    got = scoring.brand_presence(again).first()
    assert (got.bap, got.bap_confidence) == (100.0, "low")


def test_unknown_statuses_and_sections(spark):
    got = scoring.audit_scores(rows(spark, [("robots_reachable", None, "pass", None), ("det:A1_x", "", "odd", None), ("A2", "a", "PASS ", None)])).first()
    assert got.score_A == 100.0 and got.findings_total == 1


def test_grades(spark):
    scores = [100.0, 95.0, 94.9, 80.0, 60.0, 53.0, 44.9, None, 150.0]
    got = spark.createDataFrame([(k, s) for k, s in enumerate(scores)], "k int, s double").orderBy("k").select(scoring.grade_of(F.col("s")).alias("g")).collect()
    assert [r.g for r in got] == ["A+", "A+", "A", "B+", "C", "D+", "F", "INCONCLUSIVE", "A+"]


GATES = "audit_id string, ai_bot_allowed boolean, server_rendered boolean, reachable_200 boolean, https boolean, page_type string, confidence string, unreached boolean"


def test_cite_readiness(spark):
    items = [(c, c[0], s, None) for c, s in [("D9_x", "pass"), ("F4_x", "pass"), ("F3_x", "pass"), ("F6_x", "warn"), ("E14_x", "fail"), ("A1_x", "pass")]]
    findings = rows(spark, items, "good")
    for name in ("denied", "thin", "away", "unknown"):
        findings = findings.unionByName(rows(spark, items, name))
    gates = spark.createDataFrame(
        [
            ("good", True, True, True, True, "article", "high", False), ("denied", False, True, True, True, "service", "high", False),
            ("thin", True, False, True, True, "service", "low", False), ("away", True, True, True, True, None, None, True),
            ("unknown", None, None, None, None, "local_business", "medium", False), ("empty", True, True, True, True, None, None, False),
        ],
        GATES,
    )
    got = {r.audit_id: r for r in scoring.cite_readiness(findings, gates).collect()}
    assert got["good"].cite_score == 60.2 and got["good"].business_type == "product" and got["good"].own_site_weight == 0.4
    assert got["denied"].cite_score == 0.0 and got["denied"].failed_gates == ["ai_bot_allowed"] and got["denied"].business_type == "local_service"
    assert got["thin"].cite_score == 0.0 and got["thin"].business_type == "product"
    assert got["away"].cite_score is None and got["unknown"].cite_score == 60.2 and got["empty"].cite_score is None


def test_rule_weight(spark):
    row = spark.range(1).select(
        scoring.rule_weight(0.0, F.lit(True), F.lit("rule"), F.lit(1.0), F.lit(None)).alias("off"),
        scoring.rule_weight(2.0, F.lit(True), F.lit("ap"), F.lit(0.0), F.lit("high")).alias("most"),
        scoring.rule_weight(0.5, F.lit(True), F.lit("rule"), F.lit(0.5), F.lit(None)).alias("some"),
        scoring.rule_weight(0.5, F.lit(False), F.lit("rule"), F.lit(0.5), F.lit(None)).alias("unverified"),
    ).first()
    assert (row.off, row.most, row.some, row.unverified) == (1.0, 1.5, 1.25, 1.0)


def test_compare_runs(spark):
    a = rows(spark, [("A1", "A", "pass", None), ("A2", "A", "fail", None)])
    b = rows(spark, [("A1", "A", "fail", None), ("A3", "A", "fail", None)])
    got = {r.check_id: (r.n_same, r.n_flipped, r.n_new, r.n_gone) for r in scoring.compare_runs(a, b).collect()}
    assert got == {"A1": (0, 1, 0, 0), "A2": (0, 0, 0, 1), "A3": (0, 0, 1, 0)}


@pytest.mark.parametrize("words", [[5], [0, 0], [5, 9], [0, 4, 4, 4, 7], [1, 2, 3, 4], [9, 1, 5, 5, 2, 8, 0], list(range(40, 1, -3))])
def test_host_median_depth(spark, tmp_path, words):
    pages = [(k, f"https://h{k}.example/", "<p>" + "w " * n + "</p>") for k, n in enumerate(words)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.host: (r.words, r.median_words, r.hosts) for r in queries.QUERIES["host_median_depth"](spark, str(tmp_path)).collect()}
    others = [[w for j, w in enumerate(words) if j != k and w > 0] for k in range(len(words))]
    assert got == {f"h{k}.example": (w, statistics.median(others[k]) if others[k] else None, len(others[k])) for k, w in enumerate(words)}


def test_generic_anchors_and_upserts_see_all_pages(spark, tmp_path):
    html = "<a href='/a'>Click <b>here</b></a><a href='/b'>Prices of 2026</a><a href='/c'>more</a>"
    pages = [(k, f"https://h{k}.example/", html if k == 1 else "<a href='/'>more</a><a href='/'>Home</a>") for k in range(1, 8)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert {r.anchor: r.n for r in queries.QUERIES["anchor_text_generic"](spark, str(tmp_path)).collect()} == {"click here": 1, "more": 7}
    assert {r["mode"]: r.n for r in queries.QUERIES["upserted_audits"](spark, str(tmp_path)).collect()} == {"old": 5, "new": 2}
