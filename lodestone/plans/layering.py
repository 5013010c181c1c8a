"""Layered retrieval over documents that have vectors, some of them, or none; beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import layers
from lodestone.plans.oracle import ORACLE, TOKENS, r
from lodestone.plans.queries import query, read

#: A guidance row of each document and a query of each benchmark item, in SQL that both engines read.
_FACTS = """CASE doc_id % 4 WHEN 0 THEN 'rule' WHEN 1 THEN 'ap' WHEN 2 THEN 'principle' ELSE 'playbook' END AS kind, doc_id AS id, text AS body,
CASE doc_id % 5 WHEN 0 THEN 'Google' WHEN 1 THEN 'Moz' WHEN 2 THEN 'HubSpot' WHEN 3 THEN 'Reforge' ELSE 'nobody' END AS source_org,
(doc_id % 10) / CAST(10 AS DOUBLE) AS confidence, CASE doc_id % 3 WHEN 0 THEN 'https://x.example/a/b' WHEN 1 THEN 'https://x.example' ELSE '' END AS source_url,
CASE WHEN doc_id % 9 < 3 THEN 'extracted' WHEN doc_id % 9 < 6 THEN 'neighbor-inferred' ELSE 'none' END AS provenance,
CASE WHEN doc_id % 7 = 0 THEN 'retired' ELSE 'active' END AS status, CASE WHEN doc_id % 11 = 0 THEN '1' END AS superseded_by"""
_MODELS = "SELECT 'rule' AS kind, concat('m', coalesce(label, 0) % 2) AS model, vec_id AS embedded_at FROM {0} UNION ALL SELECT 'ap', 'm9', 1000000000 + vec_id FROM {0}"
RUNTIMES = ["m0", "m1"]


@query
def layered_citations(spark, folder):
    """Citations of benchmark items under two models; the corpus was embedded with one of them, so that the other is refused.

    Principles hold no vectors, playbooks' are not asked, and every fourth item has none.
    """
    vectors = read(spark, folder, "embeddings")
    documents = spark.sql(f"SELECT doc_id, {_FACTS} FROM {{documents}}", documents=read(spark, folder, "documents"))
    corpus = documents.join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    corpus = corpus.withColumn("embedding", F.when(F.col("kind") != "principle", F.col("embedding")))
    items = read(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    asked = vectors.filter("vec_id % 3 = 0 AND vec_id % 4 <> 3").selectExpr("CAST(vec_id / 3 AS BIGINT) AS query_id", "embedding")
    meta = spark.sql(_MODELS.format("{vectors}"), vectors=vectors)
    found = [layers.layered_citations(corpus, items.join(asked, "query_id", "left"), meta, m).withColumn("runtime", F.lit(m)) for m in RUNTIMES]
    return found[0].unionByName(found[1])


def _double(x: str) -> str:
    return f"list_transform({x}, lambda x: CAST(x AS DOUBLE))"


ORACLE["layered_citations"] = f"""WITH rows_ AS (SELECT {_FACTS} FROM documents),
corpus AS (SELECT c.*, CASE WHEN kind <> 'principle' THEN embedding END AS v, status = 'active' AND superseded_by IS NULL AS alive FROM rows_ c LEFT JOIN embeddings e ON e.vec_id = c.id),
recorded AS (SELECT arg_max(model, embedded_at) AS known FROM ({_MODELS.format('embeddings')}) WHERE kind = 'rule'),
runtimes AS (SELECT unnest({RUNTIMES}) AS runtime),
items AS (SELECT runtime, runtime <> known AS refused, item_id AS query_id, text, embedding FROM runtimes, recorded, benchmark LEFT JOIN embeddings ON vec_id = item_id * 3 AND vec_id % 4 <> 3),
near AS (
  SELECT runtime, query_id, kind, id, 'vector' AS layer, round(list_cosine_similarity({_double('i.embedding')}, {_double('c.v')}), 6) AS relevance
  FROM items i JOIN corpus c ON NOT refused AND i.embedding IS NOT NULL AND c.v IS NOT NULL AND kind <> 'playbook' AND alive),
bags AS (SELECT kind, id, term, count(*) AS tf FROM (SELECT kind, id, unnest({TOKENS.format('body')}) AS term FROM corpus WHERE alive) GROUP BY ALL),
asks AS (SELECT DISTINCT runtime, query_id, refused OR embedding IS NULL AS bare, unnest({TOKENS.format('text')}) AS term FROM items),
words AS (SELECT runtime, query_id, kind, id, 'fts' AS layer, CAST(sum(tf) AS DOUBLE) AS relevance FROM asks JOIN bags USING (term) WHERE bare OR kind IN ('principle', 'playbook') GROUP BY ALL),
hits AS (
  SELECT * FROM near WHERE relevance >= 0.28 QUALIFY row_number() OVER (PARTITION BY runtime, query_id, kind ORDER BY relevance DESC, id) <= 12
  UNION ALL (SELECT * FROM words QUALIFY row_number() OVER (PARTITION BY runtime, query_id, kind ORDER BY relevance DESC, id) <= 12)),
ranked AS (
  SELECT h.*, row_number() OVER (PARTITION BY runtime, query_id ORDER BY -floor(relevance / 0.1::DOUBLE), id % 5, -{r('confidence')}, -{r('relevance', 4)}, id % 3,
    CASE provenance WHEN 'extracted' THEN 0 WHEN 'none' THEN 1 ELSE 2 END, kind, CAST(id AS VARCHAR)) AS rank
  FROM hits h JOIN corpus c USING (kind, id))
SELECT query_id, rank, kind, id, layer, relevance, CASE WHEN runtime <> known THEN 'model_mismatch' END AS degraded, runtime FROM ranked, recorded WHERE rank <= 3"""
