"""Groups of spelling variants from deletions with rolling hashes.

Two words differ by one replaced code point if both without the code point at one place are equal, and by one inserted
code point if one of them without some code point is the other.  The hash of a word without its i-th code point comes
from the polynomial hashes of what stands before and after it, for all places of many words at once in numpy.  These
integer keys are partitioned by their top bits and sorted; words that meet under a key are candidates, and the strings
decide.  A key's group has at most a word a letter of the alphabet and place, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._bytes import mix64
from lodestone.llm._scratch import Scratch, spread_join
from lodestone.llm.url_filter import LOWER, UPPER

RUN = r"[A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT = 5, 3
#: One run of so many, chosen by checksum, loses a code point.
THINNED = 97
#: Code points whose keys are made at a time; a longer word is a piece of its own.
PIECE = 1 << 18
#: Kinds of keys: a place left out (for replacements), a code point left out, a whole word (for insertions).
PLACE, SHORTER, WHOLE = 0, 1, 2
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_OF_PLACE, _OF_LENGTH = np.uint64(0xA24BAED4963EE407), np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    found = np.full(n, np.uint64(base))
    found[:1] = 1
    return np.multiply.accumulate(found)


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, thinned: int = THINNED) -> DataFrame:
    """``word, n``: the runs of letters of all texts with A-Z lower-cased, of ``min_length`` code points and ``min_count``
    occurrences at least.

    A run whose checksum with its doc_id divides by ``thinned`` loses one code point first, as slips of the pen do.  Null
    texts have no words; a null doc_id counts as empty.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), F.lit(0))).alias("run"))
    # lower() is the faster way where there is nothing but ASCII.
    low = F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(F.translate("run", UPPER, LOWER))
    runs = runs.select("doc_id", low.alias("run"))
    sum32 = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    runs = runs.select("run", sum32.alias("sum32"))
    at = (F.col("sum32") % F.length("run")).cast("int")
    cut = F.concat(F.left("run", at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("sum32") % thinned == 0, cut).otherwise(F.col("run")).alias("word"))
    counts = words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= min_count)


def _keys(bits: int):
    mask = np.uint64((1 << bits) - 1)

    def keyed(ids: np.ndarray, words: list[str]) -> pa.RecordBatch:
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        starts, n = ends - sizes, len(points)
        down = _powers(_INVERSE, n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix64(points.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n + 1)[:n], out=sums[1:])
        of = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(n)
        before = sums[place] - sums[starts[of]]
        after = (sums[ends[of]] - sums[place + 1]) * np.uint64(_INVERSE)
        without = (before + after) * down[starts[of]]
        whole = (sums[ends] - sums[starts]) * down[starts]
        # Leaving out any of several equal code points in a row gives one string: the first stands for them.
        new = np.concatenate(([True], points[1:] != points[:-1])) | (place == starts[of])
        sized = lambda h, size: mix64(h + size.astype(np.uint64) * _OF_LENGTH)
        keys = np.concatenate([
            mix64(sized(without, sizes[of]) + (place - starts[of] + 1).astype(np.uint64) * _OF_PLACE),
            sized(without[new], sizes[of][new] - 1),
            sized(whole, sizes),
        ])
        kinds = np.repeat(np.array([PLACE, SHORTER, WHOLE], np.int8), [n, int(new.sum()), len(words)])
        held = np.concatenate([ids[of], ids[of][new], ids])
        return pa.RecordBatch.from_arrays([pa.array((keys & mask).view(np.int64)), pa.array(kinds), pa.array(held)], names=["key", "kind", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            total = np.cumsum([len(w) for w in words])
            at = 0
            while at < len(words):
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PIECE, "right")))
                yield keyed(ids[at:to], words[at:to])
                at = to

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of ids under one key, of rows that come sorted by key and kind: places with places, whole words with shorter ones."""
    rest = None
    for batch in batches:
        now = [batch.column(k).to_numpy() for k in range(3)]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now)]
        if not len(now[0]):
            continue
        # The last key may go on in the next batch.
        cut = int(np.searchsorted(now[0], now[0][-1], "left"))
        rest = [x[cut:] for x in now]
        yield from _pairs(*[x[:cut] for x in now])
    if rest is not None:
        yield from _pairs(*rest)


def _pairs(key: np.ndarray, kind: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(key) < 2:
        return
    part = np.concatenate(([True], (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])))
    starts = np.flatnonzero(part)
    ends = np.append(starts[1:], len(key))
    a, b = [], []
    # Places: all pairs of a run, by their distance in it; a run is no longer than the alphabet.
    end = np.repeat(ends, ends - starts)
    at = np.flatnonzero((kind == PLACE) & (np.arange(len(key)) + 1 < end))
    step = 1
    while len(at):
        a.append(ids[at])
        b.append(ids[at + step])
        step += 1
        at = at[at + step < end[at]]
    # A run of shorter ones right before whole ones of the same key.
    left = np.flatnonzero((kind[starts[:-1]] == SHORTER) & (kind[starts[1:]] == WHOLE) & (key[starts[:-1]] == key[starts[1:]]))
    for k in left:
        short, whole = ids[starts[k] : ends[k]], ids[starts[k + 1] : ends[k + 1]]
        a.append(np.repeat(short, len(whole)))
        b.append(np.tile(whole, len(short)))
    if a:
        a, b = np.concatenate(a), np.concatenate(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def near_words(spark: SparkSession, words: DataFrame, bits: int = 64) -> DataFrame:
    """``a, b, a_word, b_word, a_n, b_n`` once for each two words (id, word, n) that differ by one code point; ``bits`` of the keys are used.

    Words are distinct and not null.  Their keys are as many as their code points, so very long words cost their length.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = words.select("id", "word").mapInArrow(_keys(bits), "key long, kind byte, id long")
    radix = F.shiftright("key", max(0, bits - 16))
    met = keys.repartition(parts, radix).sortWithinPartitions("key", "kind").mapInArrow(_met, "a long, b long")
    side = lambda x: words.select(F.col("id").alias(x), F.col("word").alias(f"{x}_word"), F.col("n").alias(f"{x}_n"))
    pairs = met.repartition(parts, "a").dropDuplicates(["a", "b"]).join(side("a"), "a").join(side("b"), "b")
    return pairs.filter(F.levenshtein("a_word", "b_word", 1) == 1)


def spelling_variants(spark: SparkSession, counts: DataFrame, ratio: int = 2, bits: int = 64) -> DataFrame:
    """Every word of ``counts`` (word, n; words distinct) with ``form, root, n, n_near, form_n``.

    Near words differ by exactly one inserted, deleted or replaced code point.  A word's form is its near word of largest
    n (ties: smallest in code point order) if that n is ``ratio`` times the word's or more, else null; its root is the
    last form on the way from form to form, itself without one.  Counts rise on that way, so it ends.  Null words are
    left out.  An empty table gives an empty result.
    """
    scratch = Scratch(spark)
    words = scratch.save(counts.filter("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    pairs = scratch.save(near_words(spark, words, bits))
    seen = pairs.select(F.col("a").alias("id"), F.struct((-F.col("b_n")).alias("rank"), F.col("b_word").alias("word"), F.col("b").alias("id")).alias("other"))
    seen = seen.unionByName(pairs.select(F.col("b").alias("id"), F.struct((-F.col("a_n")).alias("rank"), F.col("a_word").alias("word"), F.col("a").alias("id")).alias("other")))
    best = seen.groupBy("id").agg(F.count("*").alias("n_near"), F.min("other").alias("best"))
    rows = words.join(best, "id", "left")
    is_form = -F.col("best.rank") >= ratio * F.col("n")
    rows = scratch.save(
        rows.select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"),
            F.when(is_form, -F.col("best.rank")).alias("form_n"), F.when(is_form, F.col("best.id")).alias("form_id"),
        )
    )
    # Each round doubles the way that is known; counts at least double on each step, so ways have fewer than 64.
    way = scratch.save(rows.filter("form IS NOT NULL").select("id", F.col("form_id").alias("to"), F.col("form").alias("root")))
    while True:
        further = way.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("root").alias("next_root"))
        more = scratch.save(spread_join(way, further, "to", "left"))
        if more.filter("next IS NOT NULL").isEmpty():
            break
        way = more.select("id", F.coalesce("next", "to").alias("to"), F.coalesce("next_root", "root").alias("root"))
    found = rows.join(way.select("id", "root"), "id", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spelling_variants(spark, word_counts(docs))


def op12_sql() -> str:
    return rf"""
WITH RECURSIVE steps AS (
  SELECT list(CAST(v AS BIGINT) ORDER BY b) AS steps FROM (
    SELECT b, list_reduce(list_concat([b], range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) AS v FROM range(256) t(b))),
runs AS (
  SELECT doc_id, translate(run, '{UPPER}', '{LOWER}') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents)),
grouped AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
spelt AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS digits FROM grouped),
summed AS (
  SELECT run, n, xor(4294967295, list_reduce(
           list_concat([4294967295], list_transform(range(CAST(length(digits) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(digits, 2 * i + 1, 2) AS BIGINT))),
           lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))) AS h
  FROM spelt, steps),
thinned AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM summed),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM thinned WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
shorter AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
met AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM shorter a JOIN shorter b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.less = b.word
  UNION
  SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.less = b.word),
near AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS best, max(other_n) AS best_n FROM met GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * w.n THEN best END AS form, CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n
  FROM words w LEFT JOIN near USING (word)),
ways AS (
  SELECT word, word AS here FROM formed UNION ALL SELECT w.word, f.form FROM ways w JOIN formed f ON f.word = w.here WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.here AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM formed f JOIN ways w ON w.word = f.word JOIN formed l ON l.word = w.here AND l.form IS NULL
"""
