"""Exact nearest vectors by cosine: blocks of queries against slices of vectors, as matrix products in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of vectors and of queries that one task holds at a time, and rows of vectors multiplied at once.
SLICE_ROWS, BLOCK_ROWS, STEP_ROWS = 20_000, 2_000, 1_024


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose ``embedding`` is neither null, zero, nor holds null or non-finite components."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.coalesce(good & F.exists("embedding", lambda x: x != 0), F.lit(False)))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    # The largest component first, so that squares of very large or small ones stay finite.
    flat /= np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _best(asked: np.ndarray, asked_ids: np.ndarray, held: np.ndarray, held_ids: np.ndarray, k: int, floor: float, own: bool) -> tuple[np.ndarray, ...]:
    """Place of the query, id and cosine (six decimals) of each query's best ``k`` from ``floor`` on, ties to the smaller id."""
    at, ids, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    least = np.full(len(asked), floor)
    for start in range(0, len(held), STEP_ROWS):
        part = asked @ held[start : start + STEP_ROWS].T
        part = np.copysign(np.floor(np.abs(part) * 1e6 + 0.5) / 1e6, part) + 0.0
        q, v = np.nonzero(part >= least[:, None])
        found = held_ids[start + v]
        if not own:
            other = found != asked_ids[q]
            q, v, found = q[other], v[other], found[other]
        at, ids, scores = np.concatenate([at, q]), np.concatenate([ids, found]), np.concatenate([scores, part[q, v]])
        order = np.lexsort((ids, -scores, at))
        at, ids, scores = at[order], ids[order], scores[order]
        first = np.searchsorted(at, at, side="left")
        nth = np.arange(len(at)) - first
        full = nth == k - 1
        least[at[full]] = scores[full]
        kept = nth < k
        at, ids, scores = at[kept], ids[kept], scores[kept]
    return at, ids, scores


def _compare(k: int, floor: float, own: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if vectors.num_rows and queries.num_rows:
            asked, asked_ids = _matrix(queries["embedding"]), queries["query_id"].to_numpy()
            groups = np.asarray(vectors["part"].combine_chunks().dictionary_encode().indices)
            names = vectors["part"].combine_chunks().dictionary_encode().dictionary.to_pylist()
            for g, name in enumerate(names):
                rows = vectors.filter(pa.array(groups == g))
                at, ids, scores = _best(asked, asked_ids, _matrix(rows["embedding"]), rows["vec_id"].to_numpy(), k, floor, own)
                for held, more in zip(out, (asked_ids[at], [name] * len(at), ids, scores), strict=True):
                    held.extend(more)
        types = [pa.int64(), pa.string(), pa.int64(), pa.float64()]
        return pa.table([pa.array(o, t) for o, t in zip(out, types, strict=True)], names=["query_id", "part", "vec_id", "relevance"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, floor: float, by: str | None = None, own: bool = False) -> DataFrame:
    """``query_id, [by,] rank, vec_id, relevance``: each query's ``k`` nearest vectors (of each ``by``) from the floor on, exactly.

    ``vectors``: vec_id long, embedding, and the text column ``by`` (null: the empty one).  ``queries``: query_id long,
    embedding.  Cosine in double precision, six decimals, ties to the smaller id; a query's own id is left out unless ``own``.
    Vectors that say nothing (``usable``) or have another length than the query are near to nothing.  Rows repeated under one
    id are hits of their own.

    The queries are a stated set against all rows.  Both sides are dealt into parts that one task holds, by counts taken
    first, and each part of the one meets each of the other once; ``k`` rows a query and part are shuffled.
    """
    rows = usable(vectors).select(F.col("vec_id").cast("long"), "embedding", (F.coalesce(by, F.lit("")) if by else F.lit("")).alias("part"))
    asks = usable(queries).select(F.col("query_id").cast("long"), "embedding")
    slices = max(1, -(-rows.count() // SLICE_ROWS))
    blocks = max(1, -(-asks.count() // BLOCK_ROWS))
    dealt = lambda n: F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    length = F.size("embedding").alias("length")
    rows = rows.withColumn("slice", dealt(slices)).select("*", length, every(blocks).alias("block"))
    asks = asks.withColumn("block", dealt(blocks)).select("*", length, every(slices).alias("slice"))
    keys = ["length", "slice", "block"]
    hits = rows.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(_compare(k, floor, own), "query_id long, part string, vec_id long, relevance double")
    w = Window.partitionBy("query_id", "part").orderBy(F.col("relevance").desc(), "vec_id")
    hits = hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return hits.select("query_id", *([F.col("part").alias(by)] if by else []), "rank", "vec_id", "relevance")
