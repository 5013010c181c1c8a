"""Exact n-gram Jaccard join by rare-first prefix filtering.

Documents with equal shingle sets form one class.  A class's shingles are ordered rare first, by one global order, and
only its prefix (the ``n - ceil(t * n) + 1`` rarest) is joined: two sets at similarity ``t`` share a prefix shingle.
Candidates then pass

* the length filter (``t * larger <= smaller``),
* the positional filter (what can follow two positions bounds the overlap),
* the suffix filter (shared prefix shingles plus the longer suffix must reach the overlap that ``t`` needs),

and are verified once, on whole shingle sets.  As links only have to connect documents, each class is first verified
against its most promising partners, among them one hub of the large groups that it is in; other candidates are verified
only while they lie in different components.  Groups of many classes under one shingle are cut into blocks, those of the
group's largest component apart from the others, which meet each other but not themselves; a task that compares two
blocks passes on only pairs of different components that the filters leave.  Joins on a shingle, class or component
deal out keys that hold many rows (``spread_join``).  A class goes by 64 bits of a 128-bit digest of its set, and by the
other 64 where two sets share the first.

The order needs frequencies of frequent shingles only: blocks of the corpus count their repeated shingles exactly, the
sums are ranked, and a table of at most ``MAX_FREQUENT`` is sent to the tasks.  Any order gives the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import _bytes
from lodestone.llm._graph import connected_components
from lodestone.llm._scratch import Scratch, broadcast_if_small, checked, exact_name, spread_join

WORDS = 5
#: The similarity from which two documents link, as a fraction.
SIMILARITY = (3, 4)
#: Entries of the frequency table at most (16 bytes each).
MAX_FREQUENT = 1_000_000
#: Shingles that a task counts at once.
BLOCK_SHINGLES = 4_000_000
#: Texts of so many bytes are shingled at a time: a quarter of the other operators', as two workers share an executor with a full heap.
CHUNK_BYTES = 1 << 19
#: Groups up to this size are listed pair by pair; larger ones are compared with hubs.
SMALL_GROUP = 16
#: Classes of a large group that are compared in one block.
BLOCK = 512
#: Text hashes of documents to verify are broadcast up to so many (8 bytes each).
MAX_BROADCAST_TEXTS = 500_000
_FACTORS = _bytes.mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text of a chunk.

    Two different shingles of one pair of documents collide with a probability of about (n * m) / 2**64.
    """
    low = _bytes.lower(data)
    starts, ends, bounds = _bytes.words(low, offsets)
    h = _bytes.Hasher(low).spans(starts, ends)
    n = max(0, len(h) - words + 1)
    rolling = np.zeros(n, np.uint64)
    for k in range(words):
        rolling += h[k : k + n] * _FACTORS[k]
    rolling = _bytes.mix64(rolling)
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= words:
            out.append(np.unique(rolling[lo : hi - words + 1]))
        elif hi > lo:
            short = (h[lo:hi] * _FACTORS[: hi - lo]).sum(keepdims=True, dtype=np.uint64) + _FACTORS[32 + hi - lo : 33 + hi - lo]
            out.append(_bytes.mix64(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a shingle set."""
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return tuple(int.from_bytes(digest[k : k + 8], "little", signed=True) for k in (0, 8))


def _prefix_length(n):
    num, den = SIMILARITY
    return n + (-num * n) // den + 1


def _lean_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Chunks of CHUNK_BYTES; Arrow's memory of a batch is given back once it is done with."""
    for batch in batches:
        yield from _bytes.chunks(iter([batch]), size=CHUNK_BYTES)
        del batch
        pa.default_memory_pool().release_unused()


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that several different sets of a block hold, with their number."""
    seen: set[tuple[int, int]] = set()
    block: list[np.ndarray] = []

    def counted() -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(block), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], ["shingle", "n"])

    for _, data, offsets in _lean_chunks(batches):
        for s in shingle_sets(data, offsets):
            if len(s) and (name := _digest(s)) not in seen:
                seen.add(name)
                block.append(s)
        if sum(map(len, block)) >= BLOCK_SHINGLES:
            yield counted()
            block = []
    if block:
        yield counted()


def frequent_shingles(scratch: Scratch, docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and frequency ranks of the most frequent shingles, MAX_FREQUENT at most.

    The table is cut at a power of two of the count, so that it is the same on every run.
    """
    counts = docs.select("text").mapInArrow(_repeated, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    counts = scratch.save(counts.withColumn("octave", F.floor(F.log2("n")).cast("int")))
    octaves = sorted(counts.groupBy("octave").count().collect(), reverse=True)  # at most 64 rows
    least, total = 64, 0
    for octave, n in octaves:
        if total + n > MAX_FREQUENT:
            break
        least, total = octave, total + n
    table = counts.filter(F.col("octave") >= least).select("shingle", "n").toArrow()
    scratch.drop(counts)
    values = table["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(values)
    return values[order], table["n"].to_numpy()[order]


class RareFirst:
    """The global order: frequency (0 where unknown), then hash."""

    def __init__(self, values: np.ndarray, counts: np.ndarray):
        self.values, self.counts = values, counts
        self.maybe: np.ndarray | None = None

    def prefix(self, shingles: np.ndarray) -> np.ndarray:
        p = _prefix_length(len(shingles))
        if not len(self.values):
            return shingles[:p]
        if self.maybe is None:
            self.maybe = np.zeros(1 << 22, bool)
            self.maybe[(self.values >> np.uint64(42)).astype(np.int64)] = True
        near = np.flatnonzero(self.maybe[(shingles >> np.uint64(42)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.values, shingles[near]), len(self.values) - 1)
        known = self.values[at] == shingles[near]
        if not known.any():
            return shingles[:p]
        rank = np.zeros(len(shingles), np.int64)
        rank[near[known]] = self.counts[at[known]]
        return shingles[np.argsort(rank, kind="stable")[:p]]


def _overlap_needed(n: Column, m: Column) -> Column:
    num, den = SIMILARITY
    return F.ceil(num * (n + m) / F.lit(num + den))


def _length_filter(n: Column, m: Column) -> Column:
    num, den = SIMILARITY
    return den * F.least(n, m) >= num * F.greatest(n, m)


def _positional_filter(n: Column, i: Column, m: Column, j: Column) -> Column:
    """At a shared shingle at places i and j: before it at most min(i, j) are shared, after it the shorter rest."""
    return F.least(i, j) + 1 + F.least(n - i - 1, m - j - 1) >= _overlap_needed(n, m)


def _pairs(members: DataFrame) -> DataFrame:
    """Pairs of different classes under one shingle that pass the length and positional filters."""
    a, b = members.alias("a"), members.alias("b")
    on = (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.node") < F.col("b.node"))
    on &= _length_filter(F.col("a.n"), F.col("b.n")) & _positional_filter(F.col("a.n"), F.col("a.place"), F.col("b.n"), F.col("b.place"))
    return a.join(b, on).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("a.n").alias("n"), F.col("b.n").alias("m"))


def _stars(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each class with the hub that it meets under most large groups; a group's hub shares most of its own prefix."""
    hubs = members.groupBy("shingle").agg(F.max(F.struct("weight", "node", "n")).alias("hub"))
    met = spread_join(members, hubs, "shingle", sizes=sizes, by=("node",)).filter((F.col("node") != F.col("hub.node")) & _length_filter(F.col("n"), F.col("hub.n")))
    met = met.groupBy("node", F.col("hub.node").alias("hub")).agg(F.count("*").alias("k"))
    best = met.groupBy("node").agg(F.max(F.struct("k", "hub")).alias("best"))
    return best.select(F.least("node", "best.hub").alias("a"), F.greatest("node", "best.hub").alias("b"))


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of different components from pairs of blocks; rows come sorted by shingle and block.

    A pair is passed on under the first large group that it shares.  ``large`` holds a class's shingles of large groups
    and ``small`` the number of its prefix shingles in small ones, which bound what a pair shares in its prefixes.
    """
    num, den = SIMILARITY
    keys = ["shingle", "i", "j"]
    kept: pa.Table | None = None  # the pair of blocks that the last batch may not have ended

    def of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = {c: table[c].to_numpy() for c in (*keys, "own", "node", "root", "n", "small")}
        new = np.ones(len(table), bool)
        new[1:] = np.any([cols[c][1:] != cols[c][:-1] for c in keys], axis=0)
        starts = np.append(np.flatnonzero(new), len(table))
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            root, n, small, own = (cols[c][lo:hi] for c in ("root", "n", "small", "own"))
            if hi - lo < 2 or (root == root[0]).all():
                continue
            lists = table["large"].slice(lo, hi - lo).combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            values, at = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            held = np.zeros((hi - lo, len(values)), np.float32)
            held[np.repeat(np.arange(hi - lo), sizes), at] = 1
            shared = held @ held.T + np.minimum(small[:, None], small[None, :])
            total = n[:, None] + n[None, :]
            need = -(-num * total // (num + den))
            suffix = -(-num * n // den) - 1
            fits = (den * np.minimum(n[:, None], n[None, :]) >= num * np.maximum(n[:, None], n[None, :])) & (root[:, None] != root[None, :])
            fits &= shared + np.maximum(suffix[:, None], suffix[None, :]) >= need
            if cols["i"][lo] != cols["j"][lo]:
                fits &= own[:, None] != own[None, :]
            a, b = np.nonzero(np.triu(fits, 1))
            first = (held[a] * held[b]).argmax(1)
            here = values[first] == cols["shingle"][lo]
            node = cols["node"][lo:hi]
            a, b = node[a[here]], node[b[here]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([kept, table]) if kept is not None else table
        same = np.all([table[c].to_numpy() == table[c][-1].as_py() for c in keys], axis=0)
        cut = int(np.argmax(same))
        kept = table.slice(cut).combine_chunks()
        if cut:
            yield from of(table.slice(0, cut).combine_chunks())
    if kept is not None and kept.num_rows:
        yield from of(kept)


class _Verifier:
    """Verifies candidate pairs once each on whole shingle sets, and keeps what is linked.

    A class's set is read from one row that has it, of the text and id that ``classes`` names.
    """

    def __init__(self, scratch: Scratch, docs: DataFrame, classes: DataFrame, name: Column):
        self.scratch, self.docs, self.classes, self.name = scratch, docs, classes, name
        self.tested: list[DataFrame] = []
        self.links: list[DataFrame] = []

    def verify(self, pairs: DataFrame) -> None:
        for done in self.tested:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = self.scratch.save(pairs.select("a", "b").distinct())
        self.tested.append(pairs)
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = self.scratch.save(nodes.join(self.classes, "node").select("at.text_hash", F.col("at.doc_id").alias("only")))
        texts = self.docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
        if wanted.count() <= MAX_BROADCAST_TEXTS:
            texts = texts.join(F.broadcast(wanted), "text_hash")
        else:
            texts = spread_join(texts, wanted, "text_hash")
        texts = texts.filter(F.col("doc_id").eqNullSafe(F.col("only")))

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[tuple[int, int]] = set()
            for _, data, offsets in _lean_chunks(batches):
                found = {}
                for s in shingle_sets(data, offsets):
                    if len(s) and (name := _digest(s)) not in seen:
                        seen.add(name)
                        # The upper 48 bits: within a pair, n * m / 2**48 is the chance of one false match.
                        found[name] = (s >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                names = [pa.array([name[k] for name in found], pa.int64()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*names, pa.array(list(found.values()), pa.binary())], ["node", "check", "s"])

        held = texts.select("text").mapInArrow(sets, "node long, check long, s binary").withColumn("node", self.name)
        held = held.groupBy("node").agg(F.first("s").alias("s"))

        def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            num, den = SIMILARITY
            for batch in batches:
                keep = []
                for x, y in zip(batch.column(2), batch.column(3), strict=True):
                    s, t = (np.frombuffer(v.as_buffer(), np.uint8).reshape(-1, 6) for v in (x, y))
                    both = np.zeros((len(s) + len(t), 8), np.uint8)
                    both[: len(s), :6], both[len(s) :, :6] = s, t
                    values = np.sort(both.view(np.uint64).ravel())
                    shared = int((values[1:] == values[:-1]).sum())
                    keep.append(den * shared >= num * (len(s) + len(t) - shared))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        held = self.scratch.save(held)
        with_sets = pairs
        for side in "ab":
            sizes = pairs.groupBy(side).agg(F.count("*").alias("n_"))
            with_sets = spread_join(with_sets, held.select(F.col("node").alias(side), F.col("s").alias(f"s{side}")), side, sizes=sizes, by=("a", "b"))
        with_sets = with_sets.select("a", "b", "sa", "sb")
        self.links.append(self.scratch.save(with_sets.mapInArrow(linked, "a long, b long")))
        self.scratch.drop(held, wanted)

    def roots(self) -> DataFrame:
        edges = self.links[0]
        for more in self.links[1:]:
            edges = edges.unionByName(more)
        return connected_components(self.scratch, edges)


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


#: Kept documents that are broadcast at most when duplicates are dropped; more are joined by shuffle.
MAX_BROADCAST_KEPT = 1_000_000


def drop_near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id; all columns as they are.

    Of rows with that id the one with the smallest text hash stays; of a component without ids, likewise.  Rows
    without words have no duplicates, but equal rows of them are one.
    """
    keys = ["doc_id", "text_hash"]
    found = jaccard_components(spark, docs.select("doc_id", "text"), ("text_hash", "node", "root"))
    named = found.filter("root IS NOT NULL AND doc_id <=> component_id")
    kept = named.groupBy("root").agg(F.min(F.struct(*keys)).alias("k")).select("k.*")
    kept = kept.unionByName(found.filter("root IS NULL").select(*keys).distinct())
    kept = Scratch(spark).save(kept)
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.struct(*docs.columns).alias("row"))
    repeated = found.groupBy(*keys).count().filter("count > 1")
    small = broadcast_if_small(kept, MAX_BROADCAST_KEPT).alias("k")
    on = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.text_hash") == F.col("k.text_hash"))
    rows = hashed.alias("d").join(small, on, "left_semi")
    if not repeated.isEmpty():
        rows = rows.dropDuplicates(keys)
    return rows.select("row.*")


def jaccard_components(spark: SparkSession, docs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (doc_id, text).

    A-Z is lower-cased and words are runs of non-space bytes; the set holds the distinct 5-word shingles, or the whole
    sequence where there are fewer words.  Rows link at Jaccard similarity 0.75 or more; ``component_id`` is the
    smallest doc_id reachable, the row's own included.  Null, empty and wordless texts have an empty set and no link.
    Repeated rows and ids stay as they are; null ids never name a component (a component of null ids has none).  Other
    columns are ignored, whatever their names.  An empty table gives an empty result.  ``more`` adds columns:
    ``text_hash``, ``node`` (the shingle set's name) and ``root`` (the component's).
    """
    scratch = Scratch(spark)
    order = spark.sparkContext.broadcast(RareFirst(*frequent_shingles(scratch, docs)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for part, data, offsets in _lean_chunks(batches):
            names, sizes, prefixes = [], [], []
            for s in shingle_sets(data, offsets):
                name = _digest(s) if len(s) else None
                new = name is not None and name not in seen
                names.append(name), sizes.append(len(s))
                prefixes.append(order.value.prefix(s).view(np.int64) if new else None)
                if new:
                    seen.add(name)
            at = np.cumsum([0] + [0 if p is None else len(p) for p in prefixes], dtype=np.int32)
            values = np.concatenate([p for p in prefixes if p is not None] or [np.zeros(0, np.int64)])
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(values))
            halves = [pa.array([name and name[k] for name in names], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), *halves, pa.array(sizes, pa.int64()), lists],
                ["doc_id", "text_hash", "node", "check", "n", "prefix"],
            )

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    rows = rows.mapInArrow(described, f"doc_id {kind}, text_hash long, node long, check long, n long, prefix array<long>")
    saved = scratch.save(rows)

    def classes_of(name: Column) -> DataFrame:
        named = saved.withColumn("node", name).filter("node IS NOT NULL").groupBy("node")
        return scratch.save(named.agg(F.min(F.struct("text_hash", "doc_id")).alias("at"), F.min("doc_id").alias("doc_id"), *checked()))

    name = F.col("node")
    classes = classes_of(name)
    if not classes.filter("check_x <> check_y").isEmpty():
        name = exact_name(classes, "node")
        classes = classes_of(name)
    rows = saved.withColumn("node", name)
    known = rows.filter("node IS NOT NULL")

    prefixes = known.filter(F.size("prefix") > 0).select("node", "n", F.posexplode("prefix").alias("place", "shingle"))
    # Shingles met once join nothing; what repeats only as copies of one class goes after the second count.
    repeated = scratch.save(prefixes.groupBy("shingle").agg(F.count("*").alias("n_")).filter("n_ > 1"))
    met = spread_join(prefixes, repeated.select("shingle"), "shingle", sizes=repeated, by=("node",))
    met = scratch.save(met.select("shingle", "node", "n", "place").distinct())
    groups = scratch.save(met.groupBy("shingle").agg(F.count("*").alias("n_")).filter("n_ > 1"))
    members = spread_join(met, groups.withColumnRenamed("n_", "size"), "shingle", sizes=groups, by=("node",))
    members = scratch.save(members.select("shingle", "size", "node", "n", "place"))
    scratch.drop(met)

    # Small groups: all pairs under a shingle, a number linear in the rows.
    large = F.col("size") > SMALL_GROUP
    in_large = members.filter(large).groupBy("node").agg(F.count("*").alias("k"))
    found = _pairs(members.filter(~large)).groupBy("a", "b", "n", "m").agg(F.count("*").alias("shared"))
    for side in "ab":
        found = found.join(in_large.select(F.col("node").alias(side), F.col("k").alias(f"k_{side}")), side, "left")
    num, den = SIMILARITY
    suffix = F.greatest(*[F.ceil(num * F.col(c) / den) - 1 for c in ("n", "m")])
    unlisted = F.least(F.coalesce("k_a", F.lit(0)), F.coalesce("k_b", F.lit(0)))
    found = found.filter(F.col("shared") + unlisted + suffix >= _overlap_needed(F.col("n"), F.col("m")))
    found = scratch.save(found.select("a", "b", "shared"))
    either = found.select(F.col("a").alias("node"), F.col("b").alias("partner"), "shared").unionByName(
        found.select(F.col("b").alias("node"), F.col("a").alias("partner"), "shared")
    )
    best = either.groupBy("node").agg(F.max(F.struct("shared", "partner")).alias("best"))
    best = best.select(F.least("node", "best.partner").alias("a"), F.greatest("node", "best.partner").alias("b"))

    # Large groups: hubs are the classes whose prefixes are shared most.
    of_node = members.groupBy("node").agg(
        (F.sum(F.log2("size")) / (F.max("n") + 4)).alias("weight"),
        F.count_if(~large).alias("small"),
        F.sort_array(F.collect_list(F.when(large, F.col("shingle")))).alias("large"),
    )
    of_node = scratch.save(of_node.filter(F.size("large") > 0))
    crowd = scratch.save(members.filter(large).join(of_node.select("node", "weight"), "node").select("shingle", "size", "node", "n", "weight"))
    crowds = groups.filter(F.col("n_") > SMALL_GROUP)
    check = _Verifier(scratch, docs, classes, name)
    check.verify(best.unionByName(_stars(crowd, crowds)))
    roots = scratch.save(check.roots())

    pending = found.select("a", "b")
    for side in "ab":
        side_roots = roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
        pending = pending.join(side_roots, side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    pending = pending.filter("root_a <> root_b").select("a", "b")

    rooted = scratch.save(_rooted(crowd.drop("weight"), roots))
    # Members of a group's largest component don't meet each other, so their blocks are paired with the others' alone.
    mixed = rooted.groupBy("shingle", "root").agg(F.count("*").alias("k")).groupBy("shingle")
    mixed = mixed.agg(F.max_by("root", "k").alias("first"), F.max("k").alias("k"), F.count("*").alias("roots")).filter("roots > 1")
    blocks = spread_join(rooted, mixed.select("shingle", "first", "k"), "shingle", sizes=crowds, by=("node",))
    first = F.col("root") == F.col("first")
    blocks = blocks.withColumns({"p": F.ceil(F.col("k") / BLOCK).cast("int"), "q": F.ceil((F.col("size") - F.col("k")) / BLOCK).cast("int")})
    own = F.when(first, F.pmod(F.xxhash64("node"), F.col("p"))).otherwise(F.col("p") + F.pmod(F.xxhash64("node"), F.col("q")))
    other = F.sequence(F.when(first, F.col("p")).otherwise(0), F.col("p") + F.col("q") - 1)
    blocks = blocks.withColumn("own", own.cast("int")).withColumn("other", F.explode(other))
    blocks = blocks.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    blocks = blocks.join(of_node.drop("weight"), "node").select("shingle", "i", "j", "own", "node", "root", "n", "small", "large")
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = blocks.repartition(partitions, "shingle", "i", "j").sortWithinPartitions("shingle", "i", "j")
    check.verify(pending.unionByName(blocks.mapInArrow(_block_pairs, "a long, b long")))
    roots = check.roots()

    named = scratch.save(_rooted(classes.select("node", "doc_id"), roots))
    names = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = scratch.save(spread_join(named.select("node", "root"), names, "root").select("node", "root", "component_id"))
    scratch.drop(members, crowd, repeated, groups, of_node)
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    rows = rows.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "node")
    rows = spread_join(rows, named, "node", "left", by=("doc_id", "text_hash"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), *more)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by 5-word shingles at similarity 0.75."""
    return jaccard_components(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
