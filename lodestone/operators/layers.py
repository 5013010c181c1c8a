"""Layered retrieval as one plan: nearest vectors of each kind, or words where vectors can't be asked, one floor a layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.grounding import KINDS, full_text
from lodestone.operators.nearest import nearest, usable
from lodestone.operators.retrieval import VECTOR_FLOOR, band_rank, tier_of, trusted

#: The kind that has words only; the floor of the text layer; the kind whose recorded model counts.
TEXT_ONLY, TEXT_FLOOR, RECORDED_FOR = "playbook", 0.0, "rule"


def recorded_model(meta: DataFrame) -> str | None:
    """The model that the corpus was embedded with last (kind, model, embedded_at); null where none is recorded."""
    rows = meta.filter((F.col("kind") == RECORDED_FOR) & F.col("embedded_at").isNotNull())
    return rows.agg(F.max_by("model", F.struct("embedded_at", "model"))).first()[0]


def layered_hits(corpus: DataFrame, queries: DataFrame, meta: DataFrame, model: str, k: int) -> DataFrame:
    """``query_id, kind, id, layer, relevance, degraded``: ``k`` hits of each query and kind at most, from one layer.

    ``corpus``: kind, id long, body, embedding and the trust columns; only trusted rows of ``KINDS`` count.  ``queries``:
    query_id long, text, embedding (null or without a direction: words only).  The vector layer is asked, and nothing else
    where it has no hit, of kinds that hold any vector; words are asked of the others.  If the recorded model isn't
    ``model``, vectors are refused as a whole and ``degraded`` says so.  Null texts hold no words.
    """
    rows = trusted(corpus.filter(F.col("kind").isin(KINDS)))
    known = recorded_model(meta)
    refused = known not in (None, "", model)
    asked = usable(queries)
    # At most as many rows as there are kinds.
    embedded = [] if refused else [r.kind for r in corpus.filter(F.col("kind").isin(KINDS) & (F.col("kind") != TEXT_ONLY)).groupBy("kind").agg(F.count("embedding").alias("n")).filter("n > 0").collect()]
    docs = rows.select(F.col("id").alias("doc_id"), "kind", F.col("body").alias("text"))
    words = lambda docs, queries: full_text(docs, queries.select("query_id", "text"), k, by=("kind",)).select("query_id", "kind", F.col("doc_id").alias("id"), F.lit("fts").alias("layer"), F.col("score").cast("double").alias("relevance"))
    if not embedded:
        hits = words(docs, queries)
    else:
        near = nearest(rows.filter(F.col("kind").isin(embedded)).select(F.col("id").alias("vec_id"), "kind", "embedding"), asked, k, VECTOR_FLOOR, by="kind", own=True)
        near = near.select("query_id", "kind", F.col("vec_id").alias("id"), F.lit("vector").alias("layer"), "relevance")
        bare = queries.join(asked.select("query_id"), "query_id", "left_anti")
        hits = near.unionByName(words(docs.filter(~F.col("kind").isin(embedded)), asked)).unionByName(words(docs, bare))
    return hits.withColumn("degraded", F.lit("model_mismatch" if refused else None).cast("string"))


def layered_citations(corpus: DataFrame, queries: DataFrame, meta: DataFrame, model: str, most: int = 3) -> DataFrame:
    """``query_id, rank, kind, id, layer, relevance, degraded``: the best ``most`` hits of each query's layers.

    Each layer gives ``max(8, 4 * most)`` of a kind, whatever is cut later.  Hits below their layer's floor go; the rest are
    ranked by band of relevance, tier, confidence and so on (``band_rank``).  ``corpus`` also has source_org, confidence,
    source_url and provenance.
    """
    hits = layered_hits(corpus, queries, meta, model, max(8, 4 * most))
    facts = corpus.select("kind", "id", tier_of(F.col("source_org")).alias("tier"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "source_url", "provenance")
    floor = F.when(F.col("layer") == "fts", TEXT_FLOOR).otherwise(VECTOR_FLOOR)
    ranked = band_rank(hits.join(facts, ["kind", "id"]), most, floor)
    return ranked.select("query_id", "rank", "kind", "id", "layer", "relevance", "degraded")
