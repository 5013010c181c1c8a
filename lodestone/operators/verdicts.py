"""Verdicts on whether a citation proves a finding: kept once by key, looked up, and given to citations.

The judge itself is outside: what it answered comes in as a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.joins import lookup
from lodestone.operators.scoring import base_of

# What a judge may say; which findings are judged; how much of each text of a citation the judge is shown.
VERDICTS = ["supports", "related", "unrelated"]
UNJUDGED = "unjudged"
JUDGED_STATUSES = ["fail", "warn"]
SHOWN = {"name": 200, "condition": 300, "action": 300, "excerpt": 500}
_SCHEMA = "key string, verdict string, written timestamp, writer string"


def _short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def verdict_key(pair: DataFrame, prompt: str, model: str) -> Column:
    """SHA-256 over all that a verdict depends on: prompt, model, citation, check, evidence and the texts that the judge is shown.

    ``pair``: check_id, evidence, kind, id (null: its name stands for it), and any of name, condition, action, excerpt.
    """
    held = {c.lower() for c in pair.columns}
    text = {c: F.coalesce(F.col(c), F.lit("")) if c in held else F.lit("") for c in SHOWN}
    shown = F.concat_ws("\n", *[F.substring(F.when(text[c] == "", "(unnamed)").otherwise(text[c]) if c == "name" else text[c], 1, n) for c, n in SHOWN.items()])
    said = F.lower(F.regexp_replace(F.coalesce("evidence", F.lit("")), r"^\s+|\s+$", ""))
    base = F.coalesce(F.nullif(base_of(F.col("check_id")), F.lit("")), F.nullif("check_id", F.lit("")), F.lit("?"))
    who = F.coalesce(F.col("id").cast("string"), F.nullif(text["name"], F.lit("")), F.lit("?"))
    kind = F.lower(F.coalesce(F.nullif("kind", F.lit("")), F.lit("?")))
    return F.sha2(F.concat_ws(":", F.lit(prompt), F.lit(model), kind, who, base, _short_hash(said), _short_hash(shown)), 256)


class VerdictTable:
    """A table of verdicts that only grows; of each key the first one written counts.

    Writers don't wait for each other.  Two that write one key at once both leave a row; readers take the earlier one, of
    equal times that of the smaller writer, so that all readers agree.  Rows whose key is known are not written again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        # A folder without files has no schema: an empty write makes it one, and leaves what is there alone.
        spark.createDataFrame([], _SCHEMA).write.mode("append").parquet(path)

    def read(self) -> DataFrame:
        """``key, verdict``, one row a key."""
        rows = self.spark.read.schema(_SCHEMA).parquet(self.path)
        return rows.groupBy("key").agg(F.min(F.struct("written", "writer", "verdict")).alias("first")).select("key", F.col("first.verdict").alias("verdict"))

    def append(self, rows: DataFrame) -> None:
        """Add ``rows`` (key, verdict, written, writer): valid verdicts of keys that the table lacks, the first of each key."""
        fresh = rows.filter(F.col("verdict").isin(VERDICTS) & F.col("key").isNotNull())
        fresh = fresh.groupBy("key").agg(F.min(F.struct("written", "writer", "verdict")).alias("first")).select("key", "first.*")
        known = self.spark.read.schema(_SCHEMA).parquet(self.path).select("key")
        fresh.join(known, "key", "left_anti").select("key", "verdict", "written", "writer").write.mode("append").parquet(self.path)


def stamp(pairs: DataFrame, stored: DataFrame, answers: DataFrame) -> DataFrame:
    """``pairs`` of findings to be judged, with ``entailment`` and ``how`` it came about.

    ``pairs``: key, status, faithful (whether the citation is proven to be its source's), others stay.  Findings of other
    statuses are left out.  A citation that isn't faithful is ``blocked`` whatever is stored; then what is ``stored`` (key,
    verdict) counts, then the judge's ``answers`` (key, verdict; of several the smallest valid one).  What has no valid
    verdict is unjudged: ``invalid`` where the judge said something else, else ``unanswered``.
    """
    asked = pairs.filter(F.col("status").isin(JUDGED_STATUSES))
    valid = F.when(F.col("verdict").isin(VERDICTS), F.col("verdict"))
    said = answers.groupBy("key").agg(F.min(valid).alias("said_"), F.lit(True).alias("answered_"))
    known = stored.filter(F.col("verdict").isin(VERDICTS)).groupBy("key").agg(F.min("verdict").alias("stored_"))
    # One table of verdicts by key, so that pairs, of which many may share a key, are joined once.
    rows = lookup(asked, known.join(said, "key", "full_outer"), "key")
    faithful = F.coalesce("faithful", F.lit(False))
    how = (
        F.when(~faithful, "blocked").when(F.col("stored_").isNotNull(), "cached").when(F.col("said_").isNotNull(), "judged")
        .when(F.col("answered_"), "invalid").otherwise("unanswered")
    )
    verdict = F.when(faithful, F.coalesce("stored_", "said_"))
    return rows.withColumn("entailment", F.coalesce(verdict, F.lit(UNJUDGED))).withColumn("how", how).drop("stored_", "said_", "answered_")


def verdict_counts(stamped: DataFrame, by: str) -> DataFrame:
    """How many citations of each ``by`` were seen, cached, asked for, blocked, in error, and what was said of them."""
    n = lambda c: F.count_if(c)
    return stamped.groupBy(by).agg(
        F.count("*").alias("citations_seen"), n(F.col("how") == "cached").alias("cache_hits"), n(F.col("how") == "judged").alias("api_calls"),
        n(F.col("how") == "blocked").alias("source_unattested"), n(F.col("how") == "invalid").alias("errors"),
        *[n(F.col("entailment") == v).alias(v) for v in [*VERDICTS, UNJUDGED]],
    )
