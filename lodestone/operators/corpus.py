"""The guidance corpus as tables: sources of rows, shares, plans, and the gates of an audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.rounding import py_round
from lodestone.operators.scoring import UNREACHED, clean_id

# What an impact and an effort make together.
PRIORITY = {
    "critical": ["DO NOW", "DO NOW", "DO NOW", "PLAN NOW"], "high": ["DO NOW", "DO NOW", "PLAN", "PLAN"], "medium": ["DO NOW", "PLAN", "LATER", "SKIP"],
    "low": ["OPTIONAL", "OPTIONAL", "SKIP", "SKIP"],
}
EFFORT = ["trivial", "easy", "moderate", "complex"]


def with_source(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """``rows`` with ``url``: their own, if they have one, else that of their document (document_id, document_url)."""
    return rows.join(documents, "document_id", "left").withColumn("url", F.coalesce(F.nullif(F.trim("source_url"), F.lit("")), "document_url"))


def unnested_references(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """``id, nth, document_id, document_url``: one row for each number in the JSON list ``refs``; rows with an empty list give none."""
    spread = rows.select("id", F.posexplode(F.from_json("refs", "array<bigint>")).alias("nth", "document_id"))
    return spread.join(documents, "document_id", "left").select("id", "nth", "document_id", "document_url")


def by_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows of listed ids, each once however often it is listed."""
    return rows.join(ids.select(key), key, "left_semi")


def sources_beside(sources: DataFrame, rules: DataFrame) -> DataFrame:
    """``sources`` (source_org) with ``n_rules``, how many rules name them."""
    counts = rules.groupBy("source_org").agg(F.count("*").alias("n_rules"))
    return sources.join(counts, "source_org", "left").withColumn("n_rules", F.coalesce("n_rules", F.lit(0)))


def tagged_union(tables: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """All tables one under another, with their ``kind``."""
    parts = [t.select(F.lit(k).alias("kind"), *columns) for k, t in tables.items()]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def shares(rows: DataFrame, by: str) -> DataFrame:
    """``by, n, pct``: rows by a column, with their share of all."""
    counts = rows.groupBy(by).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(by, "n", py_round(F.col("n") * 100.0 / F.col("total"), 1).alias("pct"))


def source_mode(cites: DataFrame) -> DataFrame:
    """``audit_id, mode``: none, live, snapshot or mixed, by the layers that an audit's citations came from."""
    layers = cites.groupBy("audit_id").agg(F.bool_or(F.col("layer").isin("vector", "fts")).alias("live"), F.bool_or(F.col("layer") == "snapshot").alias("held"))
    live, held = F.coalesce("live", F.lit(False)), F.coalesce("held", F.lit(False))
    return layers.select("audit_id", F.when(live & held, "mixed").when(live, "live").when(held, "snapshot").otherwise("none").alias("mode"))


def observed(findings: DataFrame, results: DataFrame) -> DataFrame:
    """``findings`` with ``value``: what a script observed under their check's clean id (results: audit_id, check, value)."""
    rows = findings.withColumn("check", clean_id(F.col("check_id")))
    return rows.join(results, ["audit_id", "check"], "left").drop("check")


def with_fix(findings: DataFrame, fixes: DataFrame) -> DataFrame:
    """``findings`` (check_id, original_id) with ``fix``: that of their id, else that of the id they were found under."""
    own = fixes.select(F.col("check_id"), F.col("fix").alias("own_fix"))
    old = fixes.select(F.col("check_id").alias("original_id"), F.col("fix").alias("old_fix"))
    return findings.join(own, "check_id", "left").join(old, "original_id", "left").withColumn("fix", F.coalesce("own_fix", "old_fix")).drop("own_fix", "old_fix")


def best_of(rows: DataFrame, cap: int = 10) -> DataFrame:
    """``tier, nth, id, verdict``: each id once, under its best verdict, and the first ``cap`` of each tier."""
    rank = F.when(F.col("verdict") == "supports", 0).when(F.col("verdict") == "related", 1).otherwise(2)
    once = rows.groupBy("tier", "id").agg(F.min(F.struct(rank.alias("r"), "verdict")).alias("v"))
    w = Window.partitionBy("tier").orderBy("v.r", "id")
    return once.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= cap).select("tier", "nth", "id", F.col("v.verdict").alias("verdict"))


def evict_finished(jobs: DataFrame, cap: int) -> DataFrame:
    """``jobs`` (job_id, state, ended) without the oldest finished ones of each profile beyond ``cap``."""
    done = F.col("state").isin("completed", "error")
    w = Window.partitionBy("profile", done).orderBy(F.col("ended").desc_nulls_last(), F.col("job_id").desc())
    return jobs.withColumn("nth_", F.row_number().over(w)).filter(~done | (F.col("nth_") <= cap)).drop("nth_")


def admitted(jobs: DataFrame, caps: dict[str, int]) -> DataFrame:
    """``jobs`` (profile, running, as ``store.running_jobs`` counts them) with ``admitted``: whether their profile's cap let them in."""
    cap = F.lit(None).cast("int")
    for name, n in caps.items():
        cap = F.when(F.col("profile") == name, n).otherwise(cap)
    return jobs.withColumn("admitted", F.coalesce(F.col("running") <= cap, F.lit(True)))


def rule_key_edges(rows: DataFrame) -> DataFrame:
    """``block, a, b``: rows (id, block, rule_key) of one key linked with the smallest id of it; null and empty keys link nothing."""
    keyed = rows.filter(F.coalesce(F.trim("rule_key"), F.lit("")) != "")
    least = keyed.groupBy("block", "rule_key").agg(F.min("id").alias("a"))
    x, y = keyed.alias("x"), least.alias("y")
    same = F.col("x.block").eqNullSafe(F.col("y.block")) & (F.col("x.rule_key") == F.col("y.rule_key")) & (F.col("y.a") < F.col("x.id"))
    return x.join(y, same).select("x.block", "y.a", F.col("x.id").alias("b"))


def plan_by_size(elected: DataFrame, limit: int) -> DataFrame:
    """``root, n, head``: the largest clusters of an election first, ties to the smaller root."""
    rows = elected.groupBy("root").agg(F.count("*").alias("n"), F.min(F.when(F.col("canonical"), F.col("id"))).alias("head"))
    return rows.orderBy(F.col("n").desc(), "root").limit(limit)


def inconclusive(ssr_class: Column, page_existence: Column) -> Column:
    """Whether a page wasn't reached, so that no score of it means anything."""
    return F.coalesce(ssr_class.isin(UNREACHED), F.lit(False)) | F.coalesce(page_existence == "fail", F.lit(False))


def gates(pages: DataFrame) -> DataFrame:
    """The gates of citation readiness from what was observed: null where nothing is known.

    ``pages``: audit_id, final_url, words, ssr_class, bots (array of allowed yes/no, null where unknown), probes (array of
    response codes of answer engines' agents), default_code, page_type, confidence, page_existence.
    """
    known = F.filter("bots", lambda b: b.isNotNull())
    asked = F.filter("probes", lambda p: p.isNotNull())
    ok = lambda c: (c >= 200) & (c < 300)
    return pages.select(
        "audit_id",
        F.when(F.size(known) > 0, F.forall(known, lambda b: b)).alias("ai_bot_allowed"),
        F.when(F.col("words").isNotNull(), F.col("words") >= 300).alias("server_rendered"),
        F.when(F.size(asked) > 0, F.forall(asked, ok)).when(F.col("default_code").isNotNull(), ok(F.col("default_code"))).alias("reachable_200"),
        F.when(F.col("final_url").isNotNull(), F.lower("final_url").startswith("https://")).alias("https"),
        "page_type", "confidence", inconclusive(F.col("ssr_class"), F.col("page_existence")).alias("unreached"),
    )


def finalised(scores: DataFrame, unreached: DataFrame) -> DataFrame:
    """``scores`` (audit_id, pcr, grade) with no score and no grade for pages that weren't reached (audit_id, unreached)."""
    rows = scores.join(unreached, "audit_id", "left")
    gone = F.coalesce("unreached", F.lit(False))
    return rows.select("audit_id", F.when(~gone & F.col("pcr").isNotNull(), F.greatest(F.least("pcr", F.lit(100.0)), F.lit(0.0))).alias("pcr"), F.when(gone, "INCONCLUSIVE").otherwise(F.col("grade")).alias("grade"))


# What each rendering class says of access to content; all others fail.
CONTENT_ACCESS = {"fully_accessible": "pass", "partial_ssr": "warn", "minimal_content": "warn"}


def light_gates(pages: DataFrame) -> DataFrame:
    """``page_id, crawlability, content_access, page_existence`` of the light profile (page_id, rendering, bot_blocking, robots_code).

    A page doesn't exist only if its transport failed: a shell equal to the 404 page is a matter of content.  A robots
    file that is lost to a server error forbids all; one that can't be read otherwise is a warning.
    """
    rendering, code = F.coalesce("rendering", F.lit("")), F.coalesce("robots_code", F.lit(0))
    exists = F.when(rendering.isin("http_error", "fetch_failed", "unresolved_redirect"), "fail").otherwise("pass")
    blocked = (rendering == "bot_blocked") | F.coalesce("bot_blocking", F.lit(False)) | (code >= 500)
    crawl = F.when(blocked, "fail").when((code < 1) | (code >= 400), "warn").otherwise("pass")
    content = F.lit("fail")
    for name, status in CONTENT_ACCESS.items():
        content = F.when(rendering == name, status).otherwise(content)
    return pages.select("page_id", crawl.alias("crawlability"), content.alias("content_access"), exists.alias("page_existence"))


def page_kind(types: Column, url: Column) -> Column:
    """What a page is, by the types of its structured data (lower case) and its URL, first fit first."""
    low = F.lower(F.coalesce(url, F.lit("")))
    path = F.regexp_extract(low, r"^[^/?#]*//[^/?#]*([^?#]*)", 1)
    holds = lambda *names: F.arrays_overlap(types, F.array(*map(F.lit, names)))
    return (
        F.when(holds("blogposting", "article") | low.contains("/blog/"), "blog")
        .when(holds("product") | low.contains("/product") | low.contains("/shop"), "product")
        .when(holds("localbusiness", "medicalbusiness", "medicalclinic"), "local_business")
        .when(holds("softwareapplication", "mobileapplication"), "software_application")
        .when(path.isin("", "/"), "homepage")
        .otherwise("service")
    )


def authority_tier(verified: Column, metric: Column, samples: Column, age_days: Column) -> Column:
    """HIGH, MID or LOW of a profile: verified, with a number, a cited sample and activity of the last 180 days."""
    ok, has, cited = F.coalesce(verified, F.lit(False)), metric.isNotNull(), F.coalesce(samples > 0, F.lit(False))
    return F.when(ok & has & cited & F.coalesce(age_days <= 180, F.lit(False)), "HIGH").when(ok & (has | cited), "MID").otherwise("LOW")


def priority(impact: Column, effort: Column) -> Column:
    """What to do first: the cell of an impact and an effort; null outside the matrix."""
    cell = F.lit(None).cast("string")
    for name, row in PRIORITY.items():
        for e, value in zip(EFFORT, row, strict=True):
            cell = F.when((impact == name) & (effort == e), value).otherwise(cell)
    return cell
