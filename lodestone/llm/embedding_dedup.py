"""Embedding near-duplicates by spherical-cap filters from structured random product codes.

A filter is a random direction.  Directions are sums of one code word for each half of a randomly rotated vector, so
the ``B * B`` directions of a rotation come from ``2 * B`` code words, and a vector's list of directions above the cap's
threshold is decoded from two sorted lists without looking at the others.  Vectors are joined on shared filters, and
every candidate pair is verified once, in double precision, under the smallest filter that both lists hold.

Recall: of random pairs at cosine exactly 0.95 in 64 dimensions, with the four rotations of the defaults, all shared a
filter: 4,000 each with 256 and 512 (the check tables), 1,024 and 2,048 code words, 2,000 with 4,096, and
600 with 32,768 (74 million rows, 30 GB).  Two rotations found 0.998, 0.996, 0.993, 0.985 and 0.952 with 256, 1,024, 2,048,
4,096 and 32,768, as the chance falls slowly while code words grow.  Closer pairs are found more often.
The number of directions grows with the table, so lists stay short and the
rows under a filter few.  Filters with many members are cut into blocks of ``BLOCK`` and compared block by block; no
pair leaves a task, only link counts and a spanning star of each block's links do.  A vector goes by a 64-bit hash, and by
another one where two vectors share the first; joins on vectors and components deal out keys that hold many rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._graph import connected_components
from lodestone.llm._scratch import Scratch, broadcast_if_small, checked, exact_name, spread_join

THRESHOLD = 0.95
#: Members of a filter that are compared in one block; larger filters become pairs of blocks.
BLOCK = 256
#: Filters over BLOCK members are broadcast up to so many; more are joined by shuffle.
MAX_BROADCAST_FILTERS = 100_000


class CapCodes:
    """Product codes for one dimension and rotation."""

    def __init__(self, dim: int, code_words: int, rotation: int, expected: float, least: int, seed: int):
        rng = np.random.default_rng((seed, rotation, dim))
        self.half = (dim + 1) // 2
        self.rotate = np.linalg.qr(rng.standard_normal((2 * self.half, 2 * self.half)))[0][:dim]
        words = [rng.standard_normal((code_words, self.half)) for _ in range(2)]
        self.words = [w / np.linalg.norm(w, axis=1)[:, None] / np.sqrt(2) for w in words]
        self.code_words, self.rotation, self.least = code_words, rotation, min(least, code_words)
        share = min(0.4, expected / code_words**2)
        self.cap = NormalDist().inv_cdf(1 - share) / np.sqrt(2 * self.half)

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """Every filter whose direction is within the cap, and the ``least`` nearest ones at any rate."""
        turned = unit @ self.rotate
        sides = [turned[:, : self.half] @ self.words[0].T, turned[:, self.half :] @ self.words[1].T]
        orders = [np.argsort(-s, axis=1, kind="stable") for s in sides]
        tops = [np.take_along_axis(s, o, 1) for s, o in zip(sides, orders, strict=True)]
        found = []
        for a, b, i, j in zip(*tops, *orders, strict=True):
            near = np.add.outer(a[: self.least], b[: self.least]).ravel()
            cap = min(self.cap, np.partition(near, -self.least)[-self.least])
            n = int(np.searchsorted(-a, b[0] - cap, "right"))
            counts = np.searchsorted(-b, a[:n] - cap, "right")
            second = j[np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
            found.append((self.rotation * self.code_words + np.repeat(i[:n], counts)) * self.code_words + second)
        return found


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal length as a matrix of doubles, and their places in the column."""
    sizes = np.diff(np.asarray(column.offsets))
    values = np.asarray(column.values.slice(column.offsets[0].as_py()).to_numpy(zero_copy_only=False), float)
    return values, sizes


def _usable(column: str):
    """A vector that can link: not null or empty, all components finite, not zero."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(column, lambda x: x == 0)
    return F.coalesce(~bad & ~zero & (F.size(column) > 0), F.lit(False))


def near_vectors(
    spark: SparkSession,
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    expected: float = 8.0,
    least: int = 8,
    rotations: int = 4,
    seed: int = 11,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row for each row of ``vectors`` (vec_id, embedding).

    A link joins two rows whose cosine in double precision is at least ``threshold``.  ``component_id`` is the smallest
    vec_id reachable by links; ``kept`` marks it.  Null, empty and zero vectors and such with null or non-finite
    components have no link; vectors of different lengths never link.  Equal vectors are compared once and counted by
    their number.  Rows with a null vec_id count as links of others but never name a component (theirs is null if
    no linked row has an id; kept is false).  Other columns are ignored.  An empty table gives an empty result.
    """
    scratch = Scratch(spark)
    usable = vectors.filter(_usable("embedding"))
    classes = usable.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"))
    hashes = {"node": F.xxhash64("embedding"), "check": F.xxhash64(F.lit(1), "embedding")}
    classes = scratch.save(classes.select(*[h.alias(k) for k, h in hashes.items()], "vec_id", "n", "embedding"))
    name = exact_name(classes.groupBy("node").agg(*checked()), "node")
    classes = classes.withColumn("node", name).drop("check")
    total = classes.count()
    code_words = 1 << max(4, int(np.ceil(np.log2(max(1, 4 * total)) / 2)))

    # The products of a slice with all code words take about as much memory whatever their number.
    slice_rows = max(16, min(1024, (1 << 20) // code_words))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, list[CapCodes]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                nodes, n, column = (part.column(k) for k in range(3))
                values, sizes = _matrix(column)
                ends = np.cumsum(sizes)
                for dim in np.unique(sizes):
                    rows = np.flatnonzero(sizes == dim)
                    x = values[(ends[rows] - dim)[:, None] + np.arange(dim)]
                    unit = x / np.abs(x).max(1)[:, None]
                    unit /= np.linalg.norm(unit, axis=1)[:, None]
                    if dim not in codes:
                        codes[dim] = [CapCodes(int(dim), code_words, r, expected, least, seed) for r in range(rotations)]
                    decoded = [c.decode(unit) for c in codes[dim]]
                    lists = [np.sort(np.concatenate(found)) for found in zip(*decoded, strict=True)]
                    of = np.repeat(rows, [len(f) for f in lists])
                    raw = [unit[k].tobytes() for k in range(len(rows))]
                    own = [f.astype(np.int64).tobytes() for f in lists]
                    k = np.repeat(np.arange(len(rows)), [len(f) for f in lists])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate(lists) * 4096 + dim % 4096),
                            nodes.take(pa.array(of)),
                            n.take(pa.array(of)),
                            pa.array(raw, pa.binary()).take(pa.array(k)),
                            pa.array(own, pa.binary()).take(pa.array(k)),
                        ],
                        ["filter", "node", "n", "unit", "filters"],
                    )

    members = classes.select("node", "n", "embedding").mapInArrow(listed, "filter long, node long, n long, unit binary, filters binary")
    members = scratch.save(members)
    sizes = members.groupBy("filter").agg(F.count("*").alias("size")).filter("size > 1")
    large = scratch.save(sizes.filter(F.col("size") > BLOCK))
    members = members.join(broadcast_if_small(large, MAX_BROADCAST_FILTERS), "filter", "left")
    blocks = F.ceil(F.coalesce("size", F.lit(1)) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    members = members.withColumn("blocks", blocks).withColumn("own", own)
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select(
        "filter", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "unit", "filters"
    )
    keys = ["filter", "i", "j"]
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    grouped = members.repartition(partitions, *keys).sortWithinPartitions(*keys, "node")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "n"]
        kept: pa.Table | None = None  # the block that the last batch may not have ended; at most some BLOCKs of rows

        def of(table: pa.Table) -> Iterator[pa.RecordBatch]:
            cols = {c: table[c].to_numpy() for c in ("filter", "i", "j", "own", "node", "n")}
            new = np.ones(len(table), bool)
            new[1:] = np.any([cols[c][1:] != cols[c][:-1] for c in keys], axis=0)
            starts = np.append(np.flatnonzero(new), len(table))
            out = [[], [], []]
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                if hi - lo < 2:
                    continue
                x = np.frombuffer(b"".join(table["unit"].slice(lo, hi - lo).to_pylist())).reshape(hi - lo, -1)
                close = np.triu(x @ x.T >= threshold, 1)
                if cols["i"][lo] != cols["j"][lo]:
                    close &= cols["own"][lo:hi, None] != cols["own"][None, lo:hi]
                p, q = np.nonzero(close)
                if not len(p):
                    continue
                lists = [np.frombuffer(f, np.int64) for f in table["filters"].slice(lo, hi - lo).to_pylist()]
                here = cols["filter"][lo] // 4096
                first = np.fromiter((_first_shared(lists[s], lists[t]) == here for s, t in zip(p, q, strict=True)), bool, len(p))
                p, q = p[first], q[first]
                node, n = cols["node"][lo:hi], cols["n"][lo:hi]
                links = np.bincount(np.append(p, q), weights=np.append(n[q], n[p]), minlength=hi - lo)
                has = np.flatnonzero(links)
                out[0].append(node[has]), out[1].append(node[has]), out[2].append(links[has].astype(np.int64))
                s, t = _spanning(p, q, hi - lo)
                out[0].append(node[s]), out[1].append(node[t]), out[2].append(np.zeros(len(s), np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([kept, table]) if kept is not None else table
            last = [table[c][-1].as_py() for c in keys]
            same = np.all([table[c].to_numpy() == v for c, v in zip(keys, last, strict=True)], axis=0)
            cut = int(np.argmax(same))
            kept = table.slice(cut).combine_chunks()
            if cut:
                yield from of(table.slice(0, cut).combine_chunks())
        if kept is not None:
            yield from of(kept)

    found = scratch.save(grouped.mapInArrow(compared, "a long, b long, n long"))
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    roots = connected_components(scratch, found.filter("a <> b").select("a", "b"))
    named = classes.select("node", "vec_id", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = scratch.save(named.join(links, "node", "left"))
    names = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    named = scratch.save(spread_join(named, names, "root").select("node", "n", "links", "component_id"))
    rows = vectors.select("vec_id", *[F.when(_usable("embedding"), h).alias(k) for k, h in hashes.items()])
    rows = spread_join(rows.select("vec_id", name.alias("node")), named, "node", "left", by=("vec_id",))
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.select(
        "vec_id",
        F.coalesce(F.col("n") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _first_shared(a: np.ndarray, b: np.ndarray) -> int:
    both = np.intersect1d(a, b, assume_unique=True)
    return int(both[0]) if len(both) else -1


def _spanning(p: np.ndarray, q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every linked member to its component's first member, within one block."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[p], label[q])
        before = label.copy()
        np.minimum.at(label, p, low)
        np.minimum.at(label, q, low)
        label = label[label]
        if (label == before).all():
            break
    s = np.flatnonzero(label != np.arange(n))
    return s, label[s]


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, links from cosine 0.95 on."""
    return near_vectors(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op4_sql() -> str:
    return f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
  ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= {THRESHOLD}),
reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
named AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, n.component_id, e.vec_id = n.component_id AS kept
FROM embeddings e JOIN named n USING (vec_id) LEFT JOIN counted c USING (vec_id)
"""
