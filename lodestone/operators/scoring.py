"""Scores and grades from findings: sections, page readiness, brand presence, shadow score and citation readiness.

A finding is ``(audit_id, ord, check_id, section, status, observed_method)``.  Statuses other than pass, warn, fail and
na count as na.  Points are summed as integers (pass 2, warn 1), so no score depends on the order of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.rounding import clamp, py_round

# Section keys and their weights in the page score, the groups of the brand score, grades and factors.
SECTIONS = {
    "A": "A_technical", "B": "B_performance", "C": "C_onpage", "D": "D_schema", "E": "E_aeo_discovery", "F": "F_aeo_extraction",
    "G": "G_aeo_trust", "H": "H_aeo_selection", "I": "I_geo", "J": "J_entity",
}
PAGE_WEIGHTS = {"A": 0.16, "B": 0.10, "C": 0.13, "D": 0.16, "E": 0.13, "F": 0.13, "G": 0.08, "H": 0.08, "J": 0.03}
BRAND_GROUPS = {"presence": (["I1", "I2", "I8"], 0.40), "accuracy": (["I3", "I4", "I7"], 0.35), "favorability": (["I5", "I6"], 0.25)}
GRADES = [(95.0, "A+"), (85.0, "A"), (80.0, "B+"), (75.0, "B"), (68.0, "C+"), (60.0, "C"), (53.0, "D+"), (45.0, "D"), (0.0, "F")]
MEASURED = [
    "A1", "A2b", "A3", "A4b", "A5", "A7b", "B1", "B9", "C10", "C12b", "D4", "D9", "D12", "D14", "E4", "E12", "G1", "G2", "G7b",
    "G7c", "J2", "A9b", "A10", "A11", "E1", "E2", "E3", "E10", "E13", "E14", "E8", "C13", "D15", "E5b", "F3b", "F6b", "F8b",
]
REAL_METHODS = ["measured-on-page", "observed-off-page", "observed-competitor"]
UNREACHED = ["unresolved_redirect", "bot_blocked", "http_error", "fetch_failed"]
FACTORS = {
    "faq_schema": (["D9", "F4", "F3"], 22), "depth_structure": (["C6", "C1", "F12"], 18), "question_headings": (["F6"], 15),
    "article_schema": (["D3", "D11"], 12), "llms_txt": (["E14"], 12), "answer_shaped_intro": (["F1", "F2"], 10),
    "byline_eeat": (["G1", "G2"], 6), "delivery_hardening": (["B7", "B8"], 5),
}
OWN_SITE_WEIGHT = {"product": 0.4, "local_service": 1.0}
RISK = {"high": 1.0, "medium": 0.6, "low": 0.3}


def clean_id(check_id: Column) -> Column:
    """A check id without its ``source:`` prefix."""
    return F.trim(F.regexp_replace(F.coalesce(check_id, F.lit("")), r"^[^:]*:", ""))


def base_of(check_id: Column) -> Column:
    """Letter, number and sub-letter of a check id; empty where it has none."""
    return F.regexp_extract(clean_id(check_id), r"^([A-J][0-9]{1,2}[a-z]?)(_|$)", 1)


def section_of(section: Column, check_id: Column) -> Column:
    """The explicit section's letter, else the check id's; null outside A-J."""
    given = F.upper(F.substring(F.trim(F.coalesce(section, F.lit(""))), 1, 1))
    letter = F.substring(clean_id(check_id), 1, 1)
    inside = lambda c: c.isin(*SECTIONS)
    return F.when(inside(given), given).when(inside(letter), letter)


def evidence_tier(check_id: Column) -> Column:
    return F.when(base_of(check_id).isin(MEASURED), "measured").otherwise("llm-judged")


def observed_method(check_id: Column, has_competitor: Column) -> Column:
    family = F.upper(F.substring(clean_id(check_id), 1, 1))
    return (
        F.when((family == "H") & has_competitor, "observed-competitor")
        .when(family.isin("H", "I"), "observed-off-page")
        .when(base_of(check_id).isin(MEASURED), "measured-on-page")
        .otherwise("model-judgment")
    )


def rule_weight(strength: float, verified: Column, kind: Column, confidence: Column, risk: Column) -> Column:
    """1 + strength * severity of a verified binding, within 1 and 1.5."""
    by_risk = F.lit(0.6)
    for name, value in RISK.items():
        by_risk = F.when(F.lower(risk) == name, value).otherwise(by_risk)
    severity = F.when(kind == "ap", by_risk).otherwise(clamp(F.coalesce(confidence, F.lit(0.0)), 0.0, 1.0))
    return F.when(F.lit(strength > 0) & F.coalesce(verified, F.lit(False)), clamp(1.0 + strength * severity, 1.0, 1.5)).otherwise(1.0)


def grade_of(score: Column) -> Column:
    """Letter grade of a score clamped to 0-100; null is INCONCLUSIVE."""
    grade = F.when(score.isNull(), "INCONCLUSIVE")
    for least, name in GRADES:
        grade = grade.when(clamp(score) >= least, name)
    return grade.otherwise("F")


def normal_status(status: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(status, F.lit("na"))))
    return F.when(s.isin("pass", "warn", "fail"), s).otherwise("na")


def _points(status: Column) -> Column:
    return F.when(status == "pass", 2).when(status == "warn", 1).when(status == "fail", 0)


def _sectioned(findings: DataFrame) -> DataFrame:
    return findings.select(
        "audit_id", section_of(F.col("section"), F.col("check_id")).alias("section"), normal_status(F.col("status")).alias("status"),
        F.coalesce(F.col("observed_method").isin(REAL_METHODS), F.lit(False)).alias("backed"),
    )


def section_counts(findings: DataFrame) -> DataFrame:
    """``audit_id, section, n_pass, n_warn, n_fail, n_na``."""
    count = lambda s: F.count_if(F.col("status") == s)
    rows = _sectioned(findings).filter("section IS NOT NULL")
    return rows.groupBy("audit_id", "section").agg(*[count(s).alias(f"n_{s}") for s in ("pass", "warn", "fail", "na")])


def _percent(points: Column, n: Column) -> Column:
    """Mean of the points in percent, one decimal; null without rows."""
    return py_round(points / F.lit(2.0) / F.nullif(n, F.lit(0)) * 100, 1)


def _weighted(scores: dict[str, Column], weights: dict[str, float], digits: int | None = 1) -> Column:
    """Weighted mean over the scores that are there, summed in a fixed order."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for k, w in weights.items():
        total = total + F.coalesce(scores[k] * w, F.lit(0.0))
        weight = weight + F.when(scores[k].isNotNull(), w).otherwise(0.0)
    mean = F.when(weight > 0, total / F.nullif(weight, F.lit(0.0)))
    return py_round(mean, digits) if digits is not None else mean


def audit_scores(findings: DataFrame) -> DataFrame:
    """One row for each audit: section scores, page score, shadow score and coverage, in one aggregation.

    The shadow score counts only findings with a real observation.  A section without applicable findings has none,
    and weights are shared among the others.
    """
    rows = _sectioned(findings)
    points = _points(F.col("status"))
    aggregates = []
    for s in SECTIONS:
        mine = F.col("section") == s
        for name, extra in (("", F.lit(True)), ("shadow_", F.col("backed"))):
            aggregates.append(F.sum(F.when(mine & extra, points)).alias(f"{name}points_{s}"))
            aggregates.append(F.count(F.when(mine & extra, points)).alias(f"{name}n_{s}"))
    scored = F.col("section").isin(*PAGE_WEIGHTS) & points.isNotNull()
    aggregates += [
        F.count_if(F.col("status") == "fail").alias("n_fail"),
        F.count_if(F.col("status") == "warn").alias("n_warn"),
        F.count_if(scored).alias("findings_total"),
        F.count_if(scored & F.col("backed")).alias("findings_backed"),
    ]
    sums = rows.groupBy("audit_id").agg(*aggregates)
    for name in ("", "shadow_"):
        sums = sums.withColumns({f"{name}score_{s}": _percent(F.col(f"{name}points_{s}"), F.col(f"{name}n_{s}")) for s in SECTIONS})
    part = lambda name: {s: F.col(f"{name}score_{s}") for s in SECTIONS}
    sums = sums.withColumn("pcr", _weighted(part(""), PAGE_WEIGHTS)).withColumn("shadow", _weighted(part("shadow_"), PAGE_WEIGHTS))
    return sums.select(
        "audit_id", *[f"score_{s}" for s in SECTIONS], "pcr", grade_of(F.col("pcr")).alias("grade"), "shadow",
        grade_of(F.col("shadow")).alias("shadow_grade"), py_round(F.col("shadow") - F.col("pcr"), 1).alias("shadow_delta"),
        "findings_total", "findings_backed", "n_fail", "n_warn",
    )


def brand_presence(findings: DataFrame) -> DataFrame:
    """``audit_id, bap, bap_confidence``: last status of each I check, three weighted groups.

    na checks of a group that scored count towards confidence.
    """
    number = F.regexp_extract(clean_id(F.col("check_id")), r"^(I[0-9]+)", 1)
    last = findings.select("audit_id", "ord", "status", number.alias("number")).filter("number <> ''")
    last = last.groupBy("audit_id", "number").agg(F.max_by("status", "ord").alias("status"))
    points = _points(F.lower(F.trim("status")))
    aggregates = []
    for name, (ids, _) in BRAND_GROUPS.items():
        mine = F.col("number").isin(ids)
        aggregates += [
            F.sum(F.when(mine, points)).alias(f"p_{name}"), F.count(F.when(mine, points)).alias(f"n_{name}"), F.count_if(mine).alias(f"seen_{name}")
        ]
    sums = last.groupBy("audit_id").agg(*aggregates)
    scores = {g: F.col(f"p_{g}") / F.lit(2.0) / F.nullif(F.col(f"n_{g}"), F.lit(0)) * 100 for g in BRAND_GROUPS}
    bap = _weighted(scores, {g: w for g, (_, w) in BRAND_GROUPS.items()})
    seen = sum((F.when(F.col(f"n_{g}") > 0, F.col(f"seen_{g}")).otherwise(0) for g in BRAND_GROUPS), F.lit(0))
    sure = F.when(F.col("bap").isNull(), "none").when(seen < 3, "low").when(seen < 6, "medium").otherwise("high")
    return sums.withColumn("bap", bap).select("audit_id", "bap", sure.alias("bap_confidence"))


def combined(page: Column, brand: Column) -> Column:
    """80 parts page score and 20 parts brand score, the page score standing in for a missing brand score."""
    return py_round(page * 0.8 + F.coalesce(brand, page) * 0.2, 1)


def cite_factors(findings: DataFrame) -> DataFrame:
    """``audit_id, factor, weight, points, n``: each factor's applicable findings."""
    base = base_of(F.col("check_id"))
    factor, weight = F.lit(None).cast("string"), F.lit(None).cast("int")
    for name, (bases, w) in FACTORS.items():
        factor = F.when(base.isin(bases), name).otherwise(factor)
        weight = F.when(base.isin(bases), w).otherwise(weight)
    rows = findings.select("audit_id", factor.alias("factor"), weight.alias("weight"), _points(F.lower(F.trim("status"))).alias("points"))
    rows = rows.filter("factor IS NOT NULL AND points IS NOT NULL")
    return rows.groupBy("audit_id", "factor", "weight").agg(F.sum("points").alias("points"), F.count("*").alias("n"))


def cite_readiness(findings: DataFrame, gates: DataFrame) -> DataFrame:
    """``audit_id, cite_score, failed_gates, business_type, own_site_weight`` for each row of ``gates``.

    ``gates``: audit_id, ai_bot_allowed, server_rendered, reachable_200, https (booleans, null unknown), page_type,
    confidence, unreached (boolean).  An unreached page has no score; a failed gate makes it 0; unknown gates pass.
    """
    names = ["ai_bot_allowed", "server_rendered", "reachable_200", "https"]
    factors = cite_factors(findings)
    per = factors.groupBy("audit_id").pivot("factor", list(FACTORS)).agg(F.first(F.col("points") / F.lit(2.0) / F.col("n")))
    score = _weighted({f: F.col(f) for f in FACTORS}, {f: float(w) for f, (_, w) in FACTORS.items()}, None)
    rows = gates.join(per.withColumn("factor_score", py_round(clamp(score * 100), 1)).select("audit_id", "factor_score"), "audit_id", "left")
    failed = F.array_compact(F.array(*[F.when(F.col(g) == F.lit(False), F.lit(g)) for g in sorted(names)]))
    local = F.lower(F.trim("page_type")).isin("local_business", "service") & F.lower(F.trim("confidence")).isin("high", "medium")
    business = F.when(F.coalesce(local, F.lit(False)), "local_service").otherwise("product")
    rows = rows.withColumn("failed_gates", failed).withColumn("business_type", business)
    cite = F.when(F.coalesce("unreached", F.lit(False)), F.lit(None)).when(F.size("failed_gates") > 0, 0.0).otherwise(F.col("factor_score"))
    own = F.when(F.col("business_type") == "product", OWN_SITE_WEIGHT["product"]).otherwise(OWN_SITE_WEIGHT["local_service"])
    return rows.select("audit_id", cite.cast("double").alias("cite_score"), "failed_gates", "business_type", own.alias("own_site_weight"))


def legacy_composites(scores: DataFrame) -> DataFrame:
    """Search, answer-engine and citation composites of older reports, over the sections that are there."""
    s = {k: F.col(f"score_{k}") for k in SECTIONS}
    return scores.select(
        "audit_id",
        _weighted(s, {"A": 0.30, "B": 0.20, "C": 0.25, "D": 0.25}).alias("seo_score"),
        _weighted(s, {"E": 0.30, "F": 0.30, "G": 0.20, "H": 0.20}).alias("aeo_score"),
        _weighted(s, {"F": 0.35, "E": 0.25, "D": 0.25, "G": 0.15}).alias("citation_readiness"),
    )


def top_issues(findings: DataFrame, limit: int = 20) -> DataFrame:
    """Each audit's failing and warning findings, fails first, then by severity and order."""
    from pyspark.sql import Window

    severity = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    bad = findings.filter(F.col("status").isin("fail", "warn"))
    w = Window.partitionBy("audit_id").orderBy(F.when(F.col("status") == "fail", 0).otherwise(1), severity, "ord")
    ranked = bad.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return ranked.select("audit_id", "rank", "check_id", "status", "severity")


def severity_histogram(findings: DataFrame) -> DataFrame:
    """Failing and warning findings by severity for each audit."""
    bad = findings.filter(F.col("status").isin("fail", "warn"))
    return bad.groupBy("audit_id").agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("high", "medium", "low")])


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two runs' statuses by check: how many agree, flip, appear and go."""
    a = before.select("audit_id", "check_id", F.col("status").alias("was"))
    b = after.select("audit_id", "check_id", F.col("status").alias("now"))
    both = a.join(b, ["audit_id", "check_id"], "full_outer")
    return both.groupBy("check_id").agg(
        F.count_if(F.col("was") == F.col("now")).alias("n_same"),
        F.count_if(F.col("was") != F.col("now")).alias("n_flipped"),
        F.count_if(F.col("was").isNull()).alias("n_new"),
        F.count_if(F.col("now").isNull()).alias("n_gone"),
    )


def median_of_others(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` with ``median_<value>`` and ``hosts``: the median and number of all other rows whose value is positive.

    Leaving one row out moves the middle by one place at most, so the few values around it serve all rows.  They are
    found in the table of distinct values with their counts.
    """
    counts = rows.filter(F.col(value) > 0).groupBy(value).agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy(value)))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    places = sorted({k for k in range((total - 2) // 2, total // 2 + 2) if 0 <= k < total})
    near = F.lit(False)
    for k in places:
        near = near | ((F.col("upto") > k) & (F.col("upto") - F.col("n") <= k))
    held = upto.filter(near)
    spans = [(r["upto"] - r["n"], r["upto"], r[value]) for r in held.collect()]
    at = {k: v for k in places for first, end, v in spans if first <= k < end}

    def middle(size: int, pick) -> Column:
        return (pick((size - 1) // 2) + pick(size // 2)) / F.lit(2.0) if size > 0 else F.lit(None).cast("double")

    # Without the row itself, what stands at a place is the next value unless the row is larger.
    others = middle(total - 1, lambda k: F.when(F.col(value) > at[k], F.lit(at[k])).otherwise(F.lit(at[k + 1])))
    counted = F.coalesce(F.col(value) > 0, F.lit(False))
    rows = rows.withColumn(f"median_{value}", F.when(counted, others).otherwise(middle(total, lambda k: F.lit(at[k]))))
    return rows.withColumn("hosts", F.lit(total).cast("long") - counted.cast("long"))
