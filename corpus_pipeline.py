"""A corpus pipeline: quality filter, near-duplicate removal, secret redaction, source mixing, tokenising.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's documents.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, jaccard_join, mixing, quality, secrets
from lodestone.llm._scratch import Scratch


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from ``labels`` outside the held-out fold.

    A null text counts as empty, repeated rows are judged alike, an empty table stays empty, and without usable labels
    every document is accepted (its score is 0.5).
    """
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(quality.quality_score(model, F.col("text")) >= quality.THRESHOLD)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id.

    Texts without words, null ones included, have no duplicates, but equal rows of them are one; see ``drop_near_duplicates``.
    """
    return jaccard_join.drop_near_duplicates(spark, docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets masked in their texts; null and empty texts stay, repeated rows are treated alike."""
    return secrets.redact_secrets(spark, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: null and empty texts weigh nothing, a null source is one of its own."""
    return mixing.write_mix(spark, docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's doc_id, lang, source, token ids, their number, and a digest of their decoded text; no ids for null and empty texts."""
    done = bpe.encode_digests(spark, docs, names=("doc_id", "lang", "source"), with_ids=True)
    return done.select("doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256")


STAGES = [
    ("quality_filter", keep_good),
    ("near_duplicates", keep_one_of_each_group),
    ("secret_redaction", redact),
    ("source_mixing", mix),
    ("tokenising", tokenise),
]

#: The classifier, the forest and the tokenizer are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to shared scratch storage and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        done = scratch.save(stage(spark, docs, sf_dir))
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
