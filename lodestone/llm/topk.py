"""Exact top-k inner products over an impact-ordered, score-at-a-time index.

Candidates are dealt into shards and queries into blocks; each shard meets each block once, in a task of bounded size.
A shard's index holds, for every term (component), its postings in descending order of quantised impact |v|; the
postings of one impact level over all terms are a segment.  Segments are processed from the highest impact down.  After
each, what a candidate can still gain is bounded by the query's norm times the norm of the candidate's postings not
processed yet (Cauchy-Schwarz) and by the query's weight times the next level's impact.  A query stops as soon as few
candidates can still reach its k-th best exact score; those possible members are rescored exactly in integers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm._scratch import Scratch
from lodestone.llm.embedding_dedup import _matrix

SCALE = 256
#: Candidates of a shard: a 32nd of all, within these bounds.  Queries of a block.
SHARD_ROWS, QUERY_ROWS = (4_096, 65_536), 8_192
#: Lower bounds of the impact levels as shares of the shard's largest impact.
LEVELS = (0.5, 0.35, 0.25, 0.175, 0.125, 0.0875, 0.0625, 0.03, 0.0)
#: Queries that share one pass over a shard's segments, to bound the table of partial scores.
TILE = 128


class ImpactIndex:
    """Posting segments of one shard, highest impact first: lists of (candidate, value) by level and term."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values, self.terms = ids, values, values.shape[1]
        size = np.abs(values).astype(float)
        top = size.max(initial=0.0)
        floors = np.array([np.ceil(share * top) for share in LEVELS])
        at = np.flatnonzero(size.ravel())  # a component of 0 is no posting
        impact, term = size.ravel()[at], at % max(1, self.terms)
        level = len(LEVELS) - np.searchsorted(floors[::-1], impact, "right")
        order = np.lexsort((at, term, level))  # within a list by candidate: its order doesn't matter there, memory does
        self.candidate, self.value = (at[order] // max(1, self.terms)).astype(np.int32), values.ravel()[at[order]].astype(np.float32)
        self.edges = np.searchsorted((level * self.terms + term)[order], np.arange(len(LEVELS) * self.terms + 1))
        self.norm = np.sqrt((size**2).sum(1))
        #: Each candidate's norm of the postings below a level, and the largest impact below it.
        rests = [np.where(size < floor, size, 0.0) for floor in floors]
        self.left, self.below = [np.sqrt((rest**2).sum(1)) for rest in rests], [float(rest.max(initial=0.0)) for rest in rests]

    def accumulate(self, level: int, queries: np.ndarray, partial: np.ndarray) -> None:
        """Adds a segment's postings, list by list, to the partial scores (candidates by queries, single precision)."""
        queries = np.ascontiguousarray(queries.T, np.float32)
        for term in range(self.terms):
            lo, hi = self.edges[level * self.terms + term : level * self.terms + term + 2]
            if lo < hi:
                partial[self.candidate[lo:hi]] += np.multiply.outer(self.value[lo:hi], queries[term])

    def search(self, q_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per tile: query number, candidate number and exact score of every possible member, k best at least."""
        few = max(8 * k, len(self.ids) // 100)
        for at in range(0, len(queries), TILE):
            active = np.arange(at, min(at + TILE, len(queries)))
            partial = np.zeros((len(self.ids), len(active)), np.float32)
            for level in range(len(LEVELS)):
                q = queries[active].astype(float)
                self.accumulate(level, q, partial)
                seen = np.where(self.ids[None, :] == q_ids[active, None], -np.inf, partial.T.astype(float))
                n = min(k, seen.shape[1])
                lead = np.argpartition(-seen, n - 1, axis=1)[:, :n]
                exact = np.einsum("qd,qkd->qk", queries[active], self.values[lead])
                exact = np.where(np.isinf(np.take_along_axis(seen, lead, 1)), np.iinfo(np.int64).min, exact)
                worst = exact.min(1).astype(float)
                norm = np.linalg.norm(q, axis=1)[:, None]
                gain = np.minimum(norm * self.left[level][None, :], np.abs(q).sum(1)[:, None] * self.below[level])
                # What sums in single precision can be off by is below this share of the norms' product.
                possible = seen + gain + (self.terms + 8) * 2.0**-22 * norm * self.norm[None, :] + 0.5 >= worst[:, None]
                done = (possible.sum(1) <= few) | (level == len(LEVELS) - 1)
                rows, cols = np.nonzero(possible[done])
                if len(rows):
                    own = active[done][rows]
                    keep = self.ids[cols] != q_ids[own]
                    own, cols = own[keep], cols[keep]
                    yield own, cols, np.einsum("nd,nd->n", queries[own], self.values[cols])
                active, partial = active[~done], partial[:, ~done]
                if not len(active):
                    break


def _whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(SCALE * x) as integers, rows padded with zeros to the longest; which rows are too large for 64-bit sums, and
    zero there; and the numbers themselves."""
    values, sizes = _matrix(column)
    out = np.zeros((len(sizes), sizes.max(initial=0)))
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = values
    with np.errstate(over="ignore"):
        whole = np.floor(SCALE * out)
    huge = (np.abs(whole) > np.sqrt(2.0**62 / max(1, out.shape[1]))).any(1)
    return np.where(huge[:, None], 0, whole).astype(np.int64), huge, out


def _exact(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) without a limit of size: doubles from 2**53 on are whole."""
    return np.array([int(v) * SCALE if abs(v) >= 2.0**53 else int(np.floor(SCALE * v)) for v in x.ravel()], object).reshape(x.shape)


_LEAST, _MOST = -(2**63), 2**63 - 1


def _beyond(score: int) -> bytes | None:
    """Of a score beyond 64 bits: bytes that sort as such scores of one sign do."""
    if _LEAST < score < _MOST:
        return None
    raw = abs(score).to_bytes((abs(score).bit_length() + 7) // 8, "big")
    raw = len(raw).to_bytes(4, "big") + raw
    return raw if score > 0 else bytes(255 - b for b in raw)


def top_k(spark: SparkSession, vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best candidates of each row whose vec_id is divisible by ``every``.

    Components are turned into floor(256 * x); the score is their integer inner product, ties to the smaller vec_id.
    Rows with the query's own vec_id are not its candidates.  A query with fewer candidates gets all of them.  Null
    vectors, vectors with null or non-finite components and rows without an id take no part; missing components of
    shorter vectors count as 0.  Repeated rows are candidates of their own and repeated query ids are asked once.
    Components of any size count exactly; a score beyond 64 bits is ranked as it is and shown as the nearest of 64 bits.
    Other columns are ignored.  An empty table gives an empty result.
    """
    scratch = Scratch(spark)
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", "embedding").filter("vec_id IS NOT NULL").filter(F.coalesce(~bad, F.lit(False)))
    is_query = F.col("vec_id") % every == 0
    n, n_queries = rows.agg(F.count("*"), F.count_if(is_query)).first()
    per_shard = min(max(SHARD_ROWS[0], n // 32), SHARD_ROWS[1])
    shards, blocks = max(1, -(-n // per_shard)), max(1, -(-n_queries // QUERY_ROWS))
    deal = lambda m, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id", "embedding"), F.lit(m)).cast("int")
    every_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    candidates = rows.select(F.lit(0).alias("query"), deal(shards, 1).alias("shard"), every_of(blocks).alias("block"), "vec_id", "embedding")
    queries = rows.filter(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    queries = queries.select(F.lit(1).alias("query"), every_of(shards).alias("shard"), deal(blocks, 2).alias("block"), "vec_id", "embedding")
    kind = rows.schema["vec_id"].dataType.simpleString()

    def searched(table: pa.Table) -> pa.Table:
        asked = table["query"].to_numpy() == 1
        values, huge, numbers = _whole(table["embedding"].combine_chunks())
        ids = table["vec_id"].to_numpy()
        own, plain = np.flatnonzero(asked), np.flatnonzero(asked & ~huge)
        index, large = ImpactIndex(ids[~asked & ~huge], values[~asked & ~huge]), np.flatnonzero(~asked & huge)
        out = []
        if len(plain) and len(index.ids):
            for q, cols, score in index.search(ids[plain], values[plain], k):
                order = np.lexsort((index.ids[cols], -score, q))
                q, cols, score = q[order], cols[order], score[order]
                best = np.arange(len(q)) - np.searchsorted(q, q) < k
                out += zip(ids[plain][q[best]].tolist(), index.ids[cols[best]].tolist(), score[best].tolist(), strict=True)
        # What 64 bits can't sum: few rows if any, in integers of any size.
        for q in own if len(large) or huge[own].any() else ():
            others = np.flatnonzero(~asked) if huge[q] else large
            others = others[ids[others] != ids[q]]
            found = zip((_exact(numbers[others]) @ _exact(numbers[q])).tolist() if len(others) else (), ids[others].tolist(), strict=True)
            out += [(int(ids[q]), i, score) for score, i in heapq.nsmallest(k, found, key=lambda x: (-x[0], x[1]))]
        names = ["query_id", "vec_id", "score", "beyond"]
        columns = [[r[0] for r in out], [r[1] for r in out], [min(max(r[2], _LEAST), _MOST) for r in out], [_beyond(r[2]) for r in out]]
        kinds = [table["vec_id"].type, table["vec_id"].type, pa.int64(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    both = candidates.unionByName(queries).groupBy("shard", "block")
    found = scratch.save(both.applyInArrow(searched, f"query_id {kind}, vec_id {kind}, score long, beyond binary"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("beyond").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best candidates of every 50th vector."""
    return top_k(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_sql() -> str:
    return f"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
