"""The audit store: latest and earlier audits, deltas between them, and writes that upsert, replace and delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BAD = ("fail", "warn")


def newest_first(audits: DataFrame, by: str = "domain", order: str = "created") -> DataFrame:
    """``audits`` with ``age``: 1 for each domain's newest, ties to the larger audit id."""
    w = Window.partitionBy(by).orderBy(F.col(order).desc(), F.col("audit_id").desc())
    return audits.withColumn("age", F.row_number().over(w))


def latest_per_domain(audits: DataFrame) -> DataFrame:
    return newest_first(audits).filter("age = 1").drop("age")


def history(audits: DataFrame, limit: int = 5) -> DataFrame:
    """Each domain's newest audits with the change of the score since the one before."""
    w = Window.partitionBy("domain").orderBy("created", "audit_id")
    rows = audits.withColumn("score_before", F.lag("score").over(w))
    return newest_first(rows).filter(F.col("age") <= limit)


def with_prior(audits: DataFrame) -> DataFrame:
    """Each audit with the audit of its domain before it; null for the first."""
    w = Window.partitionBy("domain").orderBy("created", "audit_id")
    return audits.withColumn("prior_id", F.lag("audit_id").over(w))


def change_of(was: Column, now: Column) -> Column:
    """How a check changed from one audit to the next; absent checks are null."""
    before, after = F.coalesce(was, F.lit("absent")), F.coalesce(now, F.lit("absent"))
    bad_before, bad_after = before.isin(*BAD), after.isin(*BAD)
    return (
        F.when(bad_before & ~bad_after, "resolved")
        .when(~bad_before & bad_after & (before != "absent"), "regressed")
        .when(bad_after & before.isin("absent", "na"), "new")
        .when(bad_before & bad_after, "persisting")
    )


def delta(pairs: DataFrame, findings: DataFrame) -> DataFrame:
    """``audit_id, prior_id, check_id, change`` for each pair (audit_id, prior_id): a full outer join of findings.

    Of repeated checks of an audit the last one counts.
    """
    last = findings.groupBy("audit_id", "check_id").agg(F.max_by("status", "ord").alias("status"))
    now = pairs.join(last, "audit_id").select("audit_id", "prior_id", "check_id", F.col("status").alias("now"))
    was = pairs.join(last.withColumnRenamed("audit_id", "prior_id"), "prior_id")
    was = was.select("audit_id", "prior_id", "check_id", F.col("status").alias("was"))
    both = now.join(was, ["audit_id", "prior_id", "check_id"], "full_outer")
    return both.select("audit_id", "prior_id", "check_id", change_of(F.col("was"), F.col("now")).alias("change")).filter("change IS NOT NULL")


def delta_summary(changes: DataFrame) -> DataFrame:
    kinds = ("resolved", "regressed", "new", "persisting")
    return changes.groupBy("audit_id", "prior_id").agg(*[F.count_if(F.col("change") == k).alias(f"n_{k}") for k in kinds])


def upsert(table: DataFrame, rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``table`` with ``rows`` written over rows of the same key; of repeated new keys the last by ``order`` wins."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc() if order else F.lit(1))
    fresh = rows.withColumn("nth_", F.row_number().over(w)).filter("nth_ = 1").drop("nth_")
    return table.join(fresh.select(key), key, "left_anti").unionByName(fresh.select(*table.columns))


def insert_if_absent(table: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """``table`` with those ``rows`` whose key it doesn't have; the first writer of a key wins."""
    w = Window.partitionBy(key).orderBy(order)
    first = rows.withColumn("nth_", F.row_number().over(w)).filter("nth_ = 1").drop("nth_")
    return table.unionByName(first.join(table.select(key), key, "left_anti").select(*table.columns))


def replace_children(table: DataFrame, rows: DataFrame, key: str, evidence: str = "evidence", longest: int = 4000) -> DataFrame:
    """``table`` with all rows of the new rows' keys replaced by them, evidence cut to ``longest`` characters."""
    if evidence in rows.columns:
        rows = rows.withColumn(evidence, F.substring(evidence, 1, longest))
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows.select(*table.columns))


def delete_domains(table: DataFrame, domains: list[str], column: str = "domain") -> DataFrame:
    """``table`` without the domains, with and without a leading www."""
    bare = [d.lower().removeprefix("www.") for d in domains]
    return table.filter(~F.coalesce(F.regexp_replace(F.lower(column), r"^www\.", "").isin(bare), F.lit(False)))


def suppress(table: DataFrame, suppressed: DataFrame, column: str = "domain") -> DataFrame:
    """``table`` without suppressed domains."""
    gone = suppressed.select(F.regexp_replace(F.lower("domain"), r"^www\.", "").alias("gone_"))
    return table.join(gone, F.regexp_replace(F.lower(F.col(column)), r"^www\.", "") == F.col("gone_"), "left_anti")


def running_usage(calls: DataFrame, quota: int) -> DataFrame:
    """``key, month, nth, allowed``: each call's place in its key's month, and whether the quota admits it.

    ``calls``: call_id, key, ts.
    """
    month = F.date_format("ts", "yyyy-MM")
    w = Window.partitionBy("key", "month").orderBy("ts", "call_id")
    rows = calls.withColumn("month", month).withColumn("nth", F.row_number().over(w))
    return rows.select("call_id", "key", "month", "nth", (F.col("nth") <= quota).alias("allowed"))


def last_two_broken(checks: DataFrame) -> DataFrame:
    """URLs whose two newest checks (url, checked_at, check_id, verdict) are both broken."""
    w = Window.partitionBy("url").orderBy(F.col("checked_at").desc(), F.col("check_id").desc())
    two = checks.withColumn("nth", F.row_number().over(w)).filter("nth <= 2")
    both = two.groupBy("url").agg(F.count("*").alias("n"), F.bool_and(F.col("verdict") == "broken").alias("all_broken"))
    return both.filter("n = 2 AND all_broken").select("url")


def link_verdict(code: Column, error: Column) -> Column:
    return (
        F.when(error.isNotNull() & (error != ""), "error")
        .when(code.isin(404, 410), "broken")
        .when(code.isin(401, 403, 406, 429, 999), "blocked")
        .when((code >= 200) & (code < 400), "ok")
        .otherwise("error")
    )


def running_jobs(jobs: DataFrame, bucket_s: int = 3_600) -> DataFrame:
    """How many jobs (job_id, profile, started, ended) of its profile ran when each started, itself included.

    An interval overlap counted as a running sum over starts and ends, without a join of jobs.  Time is cut into buckets
    of ``bucket_s`` seconds; the sum runs inside each from the level at its start, which comes from the buckets' totals.
    """
    edges = jobs.select("job_id", "profile", F.col("started").alias("at"), F.lit(1).alias("step"))
    edges = edges.unionByName(jobs.filter("ended IS NOT NULL").select("job_id", "profile", F.col("ended").alias("at"), F.lit(-1).alias("step")))
    edges = edges.withColumn("bucket", F.floor(F.col("at").cast("double") / bucket_s))
    totals = edges.groupBy("profile", "bucket").agg(F.sum("step").alias("steps"))
    w = Window.partitionBy("profile").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    levels = totals.withColumn("level", F.coalesce(F.sum("steps").over(w), F.lit(0)))
    x, y = edges.alias("x"), levels.alias("y")
    same = F.col("x.profile").eqNullSafe(F.col("y.profile")) & F.col("x.bucket").eqNullSafe(F.col("y.bucket"))
    w = Window.partitionBy("profile", "bucket").orderBy("at", "step", "job_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = x.join(y, same).select("x.*", "y.level").withColumn("running", F.col("level") + F.sum("step").over(w))
    return rows.filter("step = 1").select("job_id", "profile", "running")
