"""A prefix trie of conversations from polynomial rolling fingerprints.

A numpy scan over sorted turns gives every prefix of a conversation a fingerprint, the sum of each turn's hash times the
base to the power of its place, modulo 2**64.  Prefixes with one fingerprint are candidates for one node: each is
verified turn by turn against the group's representative, and what differs is split off.  Equal fingerprints with equal
last turns have equal fingerprints one turn earlier, so that comparing every last turn proves whole prefixes.

The rollup to parents needs no step per level.  A conversation is *first* at a node if it is the node's smallest member;
from some depth on it is first at all its nodes.  Children, leaves and saved words below a node are then sums over the
node's members of numbers that each member has for itself.

No conversation, node or parent is held by one task: turns are dealt out by range with the last sums of a range carried
over, and joins on hot keys are spread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from lodestone.llm._scratch import Scratch, spread_join

WORD = r"[^\x20\x09-\x0D]+"
#: Turns that a fork can take over from another conversation.
MAX_HEAD = 3
#: Ids in one piece of a node's list of ends.
PIECE = 1_000
_ALL = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_EMPTY = hashlib.sha256(b"").hexdigest()


def _power(exponent: int) -> int:
    return pow(_BASE if exponent >= 0 else _INVERSE, abs(exponent), 1 << 64)


def _powers(n: int) -> np.ndarray:
    """The base to the powers 0 to n - 1."""
    found = np.full(n, np.uint64(_BASE))
    found[:1] = 1
    return np.multiply.accumulate(found)


@pandas_udf(T.StructType([T.StructField(name, T.LongType()) for name in ("pos", "print", "before")]))
def _scan(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Place, fingerprint and words before it of each turn, of those of its conversation that this range holds."""
    conv, n, total, said = None, 0, np.zeros(1, np.uint64), 0
    table = _powers(1 << 14)
    for ids, values, words in batches:
        ids, words = ids.to_numpy(np.int64), words.to_numpy(np.int64)
        size = len(ids)
        if not size:
            yield pd.DataFrame({"pos": [], "print": [], "before": []}, dtype="int64")
            continue
        if len(table) <= size:
            table = _powers(size + 1)
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        run = np.repeat(np.arange(len(first)), np.diff(np.append(first, size)))
        place = np.arange(size) - first[run] + 1
        sums = np.cumsum(values.to_numpy(np.int64).view(np.uint64) * table[place])
        spoken = np.cumsum(words)
        before = np.concatenate(([0], spoken[:-1]))
        found = sums - np.concatenate((np.zeros(1, np.uint64), sums))[first][run]
        before = before - before[first][run]
        if ids[0] == conv:
            to = first[1] if len(first) > 1 else size
            found[:to] = found[:to] * np.full(1, _power(n), np.uint64) + total
            place[:to] += n
            before[:to] += said
        conv, n, total, said = ids[-1], int(place[-1]), found[-1:].copy(), int(before[-1] + words[-1])
        yield pd.DataFrame({"pos": place, "print": found.view(np.int64), "before": before})


@pandas_udf(T.LongType())
def _moved(prints: pd.Series, places: pd.Series, less: pd.Series, more: pd.Series) -> pd.Series:
    """Fingerprints of turns that stand so many places later, without what stood before them and with what does now."""
    bits = lambda x: x.to_numpy(np.int64).view(np.uint64)
    kinds, which = np.unique(places.to_numpy(np.int64), return_inverse=True)
    factors = np.array([_power(int(k)) for k in kinds], np.uint64)
    return pd.Series((bits(more) + factors[which] * (bits(prints) - bits(less))).view(np.int64))


def numbered_turns(scratch: Scratch, turns: DataFrame) -> DataFrame:
    """``conv_id, pos, print, before, n_words, role, text`` of every turn, written: its place in its conversation, the
    fingerprint of the turns up to it, and the words before it."""
    spark = scratch.spark
    rows = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    )
    order = F.col("turn").asc_nulls_first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "conv_id", order).sortWithinPartitions("conv_id", order, "role", "text")
    rows = rows.select(
        "conv_id", "role", "text", F.xxhash64("role", "text").alias("value"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), F.spark_partition_id().alias("part"),
    )
    rows = rows.withColumn("at", _scan("conv_id", "value", "n_words"))
    rows = scratch.save(rows.select("conv_id", "part", "at.pos", "at.print", "at.before", "n_words", "role", "text"))
    # A conversation in several ranges: at most two of each range are, so the list is bounded by the number of ranges.
    last = rows.groupBy("conv_id", "part").agg(F.max(F.struct("pos", "print", (F.col("before") + F.col("n_words")).alias("words"))).alias("last"))
    several = rows.groupBy("conv_id").agg(F.min("part").alias("x"), F.max("part").alias("y")).filter("x < y").select("conv_id")
    carried, now = [], (None, 0, 0, 0)
    for r in sorted(last.join(several, "conv_id").collect(), key=lambda r: (r.conv_id, r.part)):
        conv, n, total, words = now if now[0] == r.conv_id else (r.conv_id, 0, 0, 0)
        if n:
            carried.append((r.conv_id, r.part, n, total - (total >> 63 << 64), words))
        now = (conv, n + r.last.pos, (total + _power(n) * r.last.print) & _ALL, words + r.last.words)
    if not carried:
        return rows.drop("part")
    carry = spark.createDataFrame(carried, "conv_id long, part int, c_n long, c_print long, c_words long")
    rows = rows.join(F.broadcast(carry), ["conv_id", "part"], "left")
    n, more = F.coalesce("c_n", F.lit(0)), F.coalesce("c_print", F.lit(0))
    return scratch.save(
        rows.select(
            "conv_id", (F.col("pos") + n).alias("pos"), _moved("print", n, F.lit(0).cast("long"), more).alias("print"),
            (F.col("before") + F.coalesce("c_words", F.lit(0))).alias("before"), "n_words", "role", "text",
        )
    )


def _forked(turns: DataFrame, fork: Callable[[Column], tuple[Column, Column]] | None) -> DataFrame:
    """A row a conversation: how many turns it takes from its base and leaves out of its own, with the sums up to there."""
    heads = [F.max(F.when(F.col("pos") == k, F.struct("print", (F.col("before") + F.col("n_words")).alias("words")))).alias(f"h{k}") for k in range(1, MAX_HEAD + 1)]
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n"), *heads)
    base, h = fork(F.col("conv_id")) if fork else (F.col("conv_id"), F.lit(0))
    nothing = F.struct(F.lit(0).cast("long").alias("print"), F.lit(0).cast("long").alias("words"))
    convs = convs.withColumn("heads", F.array(nothing, *[F.coalesce(f"h{k}", nothing) for k in range(1, MAX_HEAD + 1)]))
    convs = convs.select("conv_id", "n", "heads", base.cast("long").alias("base"), F.least(h, F.lit(MAX_HEAD)).cast("long").alias("h"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("heads").alias("base_heads"))
    rows = convs.join(bases, "base", "left")
    rows = rows.withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))).withColumn("left_out", F.least("h", "n"))
    at = lambda heads, k: F.coalesce(F.element_at(heads, (F.col(k) + 1).cast("int")), nothing)
    return rows.select(
        "conv_id", "base", "taken", "left_out", "base_heads", (F.col("taken") + F.col("n") - F.col("left_out")).alias("len"),
        at("base_heads", "taken").alias("more"), at("heads", "left_out").alias("less"),
    )


def _prefixes(turns: DataFrame, convs: DataFrame, sizes: DataFrame, bits: int) -> DataFrame:
    """``conv_id, depth, print, before, n_words, len, src_conv, src_pos``: every prefix but the empty one."""
    k = F.col("depth").cast("int")
    head = convs.filter("taken > 0").select("conv_id", "len", "base", "base_heads", F.explode(F.sequence(F.lit(1).cast("long"), F.col("taken"))).alias("depth"))
    until, upto = F.element_at("base_heads", k), F.element_at("base_heads", k + 1)
    head = head.select(
        "conv_id", "depth", upto["print"].alias("print"), until["words"].alias("before"), (upto["words"] - until["words"]).alias("n_words"), "len",
        F.col("base").alias("src_conv"), F.col("depth").alias("src_pos"),
    )
    own = spread_join(turns.select("conv_id", "pos", "print", "before", "n_words"), convs.drop("base", "base_heads"), "conv_id", sizes=sizes)
    own = own.filter("pos > left_out").withColumn("shift", F.col("taken") - F.col("left_out"))
    own = own.select(
        "conv_id", (F.col("pos") + F.col("shift")).alias("depth"), _moved("print", "shift", F.col("less.print"), F.col("more.print")).alias("print"),
        (F.col("before") - F.col("less.words") + F.col("more.words")).alias("before"), "n_words", "len",
        F.col("conv_id").alias("src_conv"), F.col("pos").alias("src_pos"),
    )
    rows = head.unionByName(own)
    return rows.withColumn("print", F.col("print").bitwiseAND((1 << bits) - 1)) if bits < 64 else rows


def _named(scratch: Scratch, rows: DataFrame, turns: DataFrame) -> DataFrame:
    """``rows`` with ``node``, equal for equal prefixes only: the fingerprint where every turn of its group is verified."""
    src = F.struct("depth", "src_conv", "src_pos")
    groups = scratch.save(rows.groupBy("print").agg(F.count("*").alias("n_"), F.min(src).alias("rep"), F.max(src).alias("last")))
    mixed = groups.filter("rep <> last")
    sources = spread_join(rows.select("print", "depth", "src_conv", "src_pos"), mixed.select("print", "rep"), "print", sizes=mixed.select("print", "n_"))
    sources = sources.distinct().withColumn("is_rep", src == F.col("rep"))
    said = turns.select(F.col("conv_id").alias("src_conv"), F.col("pos").alias("src_pos"), "role", "text")
    said = scratch.save(sources.drop("rep").join(said, ["src_conv", "src_pos"]))
    reps = said.filter("is_rep").select("print", F.struct("depth", "role", "text").alias("rep"))
    told = spread_join(said.filter("NOT is_rep"), reps, "print")
    digest = F.sha2(F.concat_ws("\x00", F.col("depth").cast("string"), F.length("role").cast("string"), "role", "text"), 256)
    other = scratch.save(told.filter(F.struct("depth", "role", "text") != F.col("rep")).select("print", "depth", "src_conv", "src_pos", digest.alias("digest")))
    if other.isEmpty():
        return rows.withColumn("node", F.col("print"))
    # What differs from its representative is split off, and so is all that goes on from there.
    split = rows.join(other, ["print", "depth", "src_conv", "src_pos"]).groupBy("conv_id")
    split = split.agg(F.sort_array(F.collect_list(F.struct("depth", "digest"))).alias("split"))
    tagged = spread_join(rows, scratch.save(split), "conv_id", "left")
    tags = F.transform(F.filter("split", lambda x: x["depth"] <= F.col("depth")), lambda x: F.concat_ws(":", x["depth"].cast("string"), x["digest"]))
    tag = F.sha2(F.array_join(F.coalesce(tags, F.array().cast("array<string>")), ","), 256)
    return scratch.save(tagged.withColumn("node", F.concat_ws(":", F.col("print").cast("string"), tag)).drop("split"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one node's sorted ids, each as text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes, ids = batch.column(0), batch.column(1).to_numpy()
        names = nodes.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
        starts = np.concatenate([np.arange(a, b, PIECE) for a, b in zip(new, np.append(new[1:], len(ids)))])
        texts = [",".join(map(str, ids[a:b])) for a, b in zip(starts, np.append(starts[1:], len(ids)))]
        yield pa.RecordBatch.from_arrays([nodes.take(pa.array(starts)), pa.array(ids[starts]), pa.array(texts)], names=["node", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's list; pieces come sorted, only the digest's state is held."""
    node, state, schema = None, None, None
    for batch in batches:
        schema = batch.schema
        for name, ids in zip(batch.column(0), batch.column(2)):
            if state is None or name != node:
                if state is not None:
                    yield _digest(node, state, schema)
                node, state = name, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_py().encode())
    if state is not None:
        yield _digest(node, state, schema)


def _digest(node: pa.Scalar, state, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([node.as_py()], schema.field(0).type), pa.array([state.hexdigest()])], names=["node", "digest"])


def list_digests(ends: DataFrame) -> DataFrame:
    """``node, digest``: SHA-256 of each node's ``conv_id``, rising, joined by commas; a null node is one of its own.

    Ids are sorted by range and joined to pieces there; a node's pieces go through one task as a stream.
    """
    kind = ends.schema["node"].dataType.simpleString()
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = ends.select("node", "conv_id").repartitionByRange(parts, "node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = rows.mapInArrow(_pieces, f"node {kind}, first long, ids string")
    return pieces.repartition(parts, "node").sortWithinPartitions("node", "first").mapInArrow(_digests, f"node {kind}, digest string")


def prefix_trie(spark: SparkSession, turns: DataFrame, fork: Callable[[Column], tuple[Column, Column]] | None = None, bits: int = 64) -> DataFrame:
    """One row per node of the trie of all conversations of ``turns`` (conv_id, turn, role, text), the textless root included.

    ``conv_id`` smallest member, ``depth``, ``parent_conv_id`` (null for the root), ``n_convs`` members, ``n_children``,
    ``n_leaves`` childless nodes in the subtree, ``saved_tokens`` (words of all turns in the subtree that need not be held
    again), ``ends_sha256`` of the ids of those who end here.  The subtree includes its top.

    ``fork`` gives for a conversation's id another's and a number h up to MAX_HEAD: it begins with the first h turns of
    that one (all, if fewer; none, if absent) in place of its own first h.  ``bits`` of the fingerprint are used.

    Turns are in order of ``turn`` (null first), ties by role, then text; repeated rows are turns of their own; null role
    or text is empty.  Rows without conv_id belong to no conversation and are left out.  Very long texts are hashed and
    compared whole.  Other columns are ignored, whatever their names.  An empty table has no node.
    """
    scratch = Scratch(spark)
    turns = numbered_turns(scratch, turns)
    convs = scratch.save(_forked(turns, fork))
    lengths = scratch.save(turns.groupBy("conv_id").agg(F.max("pos").alias("n_")))
    rows = scratch.save(_prefixes(turns, convs, lengths, bits))
    rows = _named(scratch, rows, turns)
    rows = rows.select("node", "conv_id", "depth", "before", "n_words", (F.col("depth") == F.col("len")).alias("is_end"))
    counts = rows.groupBy("node").agg(F.count("*").alias("n_convs"), F.sum(F.col("is_end").cast("long")).alias("n_ends"), F.min("conv_id").alias("least"))
    shared = scratch.save(counts.filter("n_convs > 1"))
    met = scratch.save(spread_join(rows, shared, "node", sizes=shared.select("node", F.col("n_convs").alias("n_"))))
    # What each conversation has for itself: how deep it isn't first, the words up to there, and whether it ends a leaf as its first.
    later = F.col("least") != F.col("conv_id")
    own = met.groupBy("conv_id").agg(
        F.max(F.when(later, F.struct("depth", "least", (F.col("before") + F.col("n_words")).alias("words")))).alias("last"),
        F.max(F.col("is_end") & (later | (F.col("n_convs") != F.col("n_ends")))).alias("no_leaf"),
    )
    root, total, turnless = convs.agg(F.min("conv_id"), F.count("*"), F.count_if(F.col("len") == 0)).first()
    own = convs.select("conv_id", "len").join(own, "conv_id", "left")
    bare = F.lit(turnless == total) & (F.col("conv_id") == F.lit(root))
    own = scratch.save(
        own.select(
            "conv_id", "len", (F.coalesce("last.depth", F.lit(0)) + 1).alias("first_at"), F.coalesce("last.words", F.lit(0)).alias("held"),
            F.coalesce("last.least", F.lit(root).cast("long")).alias("above"), F.when(F.col("len") == 0, bare).otherwise(~F.coalesce("no_leaf", F.lit(False))).alias("leaf"),
        )
    )
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    deep = spread_join(rows, own, "conv_id", sizes=own.select("conv_id", F.col("len").alias("n_")))
    nodes = deep.groupBy("node").agg(
        F.max("depth").alias("depth"),
        F.min(F.struct("conv_id", F.when(F.col("depth") == F.col("first_at"), F.col("above")).otherwise(F.col("conv_id")).alias("parent"))).alias("least"),
        F.count("*").alias("n_convs"),
        one((F.col("depth") < F.col("len")) & (F.col("first_at") <= F.col("depth") + 1)).alias("n_children"),
        one(F.col("leaf")).alias("n_leaves"),
        one(F.when(F.col("depth") < F.col("first_at"), F.col("held") - F.col("before")).otherwise(0)).alias("saved_tokens"),
        one(F.col("is_end")).alias("n_ends"),
        F.min(F.when(F.col("is_end"), F.col("conv_id"))).alias("end"),
    )
    kind = rows.schema["node"].dataType
    top = own.agg(
        F.lit(0).cast("long").alias("depth"), F.struct(F.min("conv_id").alias("conv_id"), F.lit(None).cast("long").alias("parent")).alias("least"),
        F.count("*").alias("n_convs"), one((F.col("len") > 0) & (F.col("first_at") == 1)).alias("n_children"), one(F.col("leaf")).alias("n_leaves"),
        F.coalesce(F.sum("held"), F.lit(0).cast("long")).alias("saved_tokens"), one(F.col("len") == 0).alias("n_ends"),
        F.min(F.when(F.col("len") == 0, F.col("conv_id"))).alias("end"),
    ).filter("n_convs > 0").withColumn("node", F.lit(None).cast(kind))
    ends = met.filter("is_end AND n_ends > 1").select("node", "conv_id")
    ends = ends.unionByName(convs.filter("len = 0").select(F.lit(None).cast(kind).alias("node"), "conv_id"))
    digests = list_digests(ends).withColumnRenamed("node", "of")
    nodes = nodes.unionByName(top)
    nodes = nodes.join(digests, F.col("node").eqNullSafe(F.col("of")), "left")
    digest = F.when(F.col("n_ends") == 0, F.lit(_EMPTY)).when(F.col("n_ends") == 1, F.sha2(F.col("end").cast("string"), 256)).otherwise(F.col("digest"))
    return nodes.select(
        F.col("least.conv_id").alias("conv_id"), "depth", F.col("least.parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        digest.alias("ends_sha256"),
    )


def twentieth(conv_id: Column) -> tuple[Column, Column]:
    """The forks of ``op13_prefix_trie``: from the conversation whose id is the next lower multiple of 20, crc32 modulo 4 turns."""
    return conv_id - conv_id % 20, F.crc32(conv_id.cast("string").cast("binary")) % 4


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt as ``twentieth`` says."""
    return prefix_trie(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"), twentieth)


def crc32_sql(text: str) -> str:
    """DuckDB's text of the unsigned CRC-32 of a string's UTF-8 bytes, bit by bit."""
    value = "acc"
    for _ in range(8):
        value = f"list_transform([{value}], lambda v: xor(v >> 1, 3988292384 * (v & 1)))[1]"
    digits = f"hex(encode({text}))"
    steps = f"list_transform(range(0, CAST(length({digits}) // 2 AS BIGINT)), lambda i: CAST(('0x' || substr({digits}, CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT))"
    start = "list_concat([4294967295::BIGINT], " + steps + ")"
    return f"xor(list_reduce({start}, lambda crc, b: {value.replace('acc', 'xor(crc, b)')}), 4294967295)"


def op13_sql() -> str:
    return rf"""
WITH numbered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM numbered)),
rebuilt AS (
  SELECT c.conv_id, 0 AS half, n.pos, n.role, n.text FROM convs c JOIN numbered n ON n.conv_id = c.base AND n.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, n.pos, n.role, n.text FROM convs c JOIN numbered n ON n.conv_id = c.conv_id AND n.pos > c.h),
placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY half, pos) AS depth,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, sha256(sha256(role) || sha256(text)) AS said
  FROM rebuilt),
chained AS (
  SELECT *, string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS path FROM placed),
members AS (
  SELECT conv_id, depth, words, sha256(path) AS node, lag(sha256(path), 1, 'root') OVER (PARTITION BY conv_id ORDER BY depth) AS parent,
         depth = max(depth) OVER (PARTITION BY conv_id) AS is_end
  FROM chained
  UNION ALL
  SELECT conv_id, 0, 0, 'root', NULL, conv_id NOT IN (SELECT conv_id FROM placed) FROM convs),
nodes AS (
  SELECT node, min(parent) AS parent, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
         sha256(coalesce(string_agg(CASE WHEN is_end THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM members GROUP BY node),
families AS (
  SELECT n.*, (SELECT count(*) FROM nodes k WHERE k.parent = n.node) AS n_children FROM nodes n),
above AS (
  SELECT DISTINCT m.node, a.node AS top FROM members m JOIN members a ON a.conv_id = m.conv_id AND a.depth <= m.depth),
below AS (
  SELECT a.top, sum((f.n_children = 0)::INT) AS n_leaves, sum((f.n_convs - 1) * f.words) AS saved_tokens
  FROM above a JOIN families f ON f.node = a.node GROUP BY a.top)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children,
       CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM families f JOIN below b ON b.top = f.node LEFT JOIN nodes p ON p.node = f.parent
"""
