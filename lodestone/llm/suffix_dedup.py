"""Suffix-array de-duplication of repeated byte strings.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts anywhere else.  Instead of one suffix array of
the corpus, suffixes are sorted in groups that provably hold all equal strings:

1. Every window of LENGTH bytes names an anchor, the gram of ``GRAM`` bytes with the smallest hash in it (as winnowing
   does); equal windows name equal anchors at equal offsets.  Only anchors that start in several places matter.
2. The contexts of such anchors (everything a window around them can reach) are grouped by the anchor's hash.  In a group,
   suffixes from the anchor on are sorted by mergesort, and so are the prefixes before it, read backwards.  Comparing
   two suffixes finds their common extension by binary search over prefix polynomial hashes, in logarithmic time, and
   looks at one byte more.  Common extensions of sorted neighbours are verified byte by byte.
3. Windows at one offset are equal where both sorted orders agree over enough bytes, so one sweep over the offsets
   with the two arrays of common extensions finds every repeated window, and no others.

Windows whose smallest gram is not unique (periodic text) are grouped by their own hash, one row for each different window
of a text, and sorted like the others.  A group beyond ``HOT_GROUP`` contexts is never sorted in one task: contexts that are
equal, byte by byte, repeat each other whole and only one of them goes on; what is still too much is split in two by
halves of the windows' offsets, each half grouped by the longer string that its windows have in common, and so on.

Each different text is handled once.  It goes by a 64-bit hash, and by another one where two texts share the first.  A text
with very many copies is read from one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import _bytes
from lodestone.llm._scratch import Scratch, broadcast_if_small, checked, exact_name, spread_join

LENGTH = 200
GRAM = 64
REACH = LENGTH - GRAM  # an anchor is at most so far from a window's start
#: Contexts of a group that one task sorts.
HOT_GROUP = 2_048
#: Texts with more than one part in so many of all rows as copies are read from one row each; fewer than this can be.
MANY_COPIES = 1_000_000
#: Places or spans (12 and 32 bytes) that are broadcast at most; beyond, texts are joined with them by shuffle.
MAX_BROADCAST_PLACES = 3_000_000
#: Hot groups that are broadcast at most.
MAX_HOT_GROUPS = 100_000
#: Long texts are cut into overlapping segments of so many bytes; windows don't care.
SEGMENT = 8 << 20
_PLACE_BITS = np.uint64(24)


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of every run of ``width`` keys, in linear time."""
    n = len(keys) - width + 1
    blocks = np.append(keys, np.full(-len(keys) % width, np.uint64(2**64 - 1))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _windows(data: np.ndarray, offsets: np.ndarray):
    """Anchors (place, hash) and the starts and hashes of windows without a unique anchor, of one segment."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(data) < LENGTH:
        return none, none
    hasher = _bytes.Hasher(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = _bytes.mix64(hasher.raw(at, at + GRAM))
    place = np.arange(len(gram), dtype=np.uint64)
    low = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    first = (_sliding_min((gram & ~low) | place, REACH + 1) & low).astype(np.int64)
    last = (low - (_sliding_min((gram & ~low) | (low - place), REACH + 1) & low)).astype(np.int64)
    starts = np.arange(len(first))
    whole = starts + LENGTH <= np.repeat(offsets[1:], np.diff(offsets))[: len(starts)]
    anchors = np.unique(first[whole & (first == last)])
    tied = starts[whole & (first != last)]
    return (anchors, gram[anchors]), (tied, hasher.spans(tied, tied + LENGTH))


def _segments(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for at in range(0, max(1, len(data)), SEGMENT):
        to = min(len(data), at + SEGMENT + LENGTH - 1)
        yield at, data[at:to], np.clip(offsets, at, to) - at


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Sorted window starts as the spans that they cover together."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > LENGTH) + 1
    return [(int(s[0]), int(s[-1]) + LENGTH) for s in np.split(starts, cut)]


_FOUND = "kind int, hash long, text_hash long, start long, stop long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: an anchor.  1: a tied window found once in its text.  2: one found more often.  3: a repeated span."""
    seen: set[int] = set()
    for part, data, offsets in _bytes.chunks(batches):
        hashes = part.column(1).to_numpy(zero_copy_only=False)
        new = np.array([h not in seen and not seen.add(h) for h in hashes.tolist()])
        out: list[list[np.ndarray]] = [[], [], [], [], []]

        def put(kind: int, hash_, doc, start, stop) -> None:
            for column, x in zip(out, (np.full(len(doc), kind, np.int32), hash_, hashes[doc], start - offsets[doc], stop - offsets[doc]), strict=True):
                column.append(np.asarray(x).astype(column[0].dtype if column else np.asarray(x).dtype))

        for at, piece, ends in _segments(data, offsets):
            (anchors, gram), (tied, window) = _windows(piece, ends)
            doc = np.searchsorted(offsets, anchors + at, "right") - 1
            own = new[doc]
            put(0, gram[own].view(np.int64), doc[own], anchors[own] + at, anchors[own] + at)
            doc = np.searchsorted(offsets, tied + at, "right") - 1
            own = new[doc]
            doc, tied, window = doc[own], tied[own] + at, window[own]
            order = np.lexsort((tied, window, doc))
            doc, tied, window = doc[order], tied[order], window[order]
            fresh = np.ones(len(doc), bool)
            fresh[1:] = (doc[1:] != doc[:-1]) | (window[1:] != window[:-1])
            group = np.cumsum(fresh) - 1
            n = np.bincount(group, minlength=int(fresh.sum()))
            once = n[group] == 1
            for kind, pick in ((1, fresh & once), (2, fresh & ~once)):
                put(kind, window[pick].view(np.int64), doc[pick], tied[pick], tied[pick] + LENGTH)
            for d in np.unique(doc[~once]):
                spans = np.array(_runs(np.sort(tied[~once & (doc == d)])), np.int64).reshape(-1, 2)
                put(3, np.zeros(len(spans), np.int64), np.full(len(spans), d), spans[:, 0], spans[:, 1])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["kind", "hash", "text_hash", "start", "stop"])


class SuffixSorter:
    """Hash-compared mergesort of many strings at once, within groups.

    ``rows`` holds one string a row, ``sizes`` their lengths, and ``bounds`` the rows where groups begin and end.
    """

    def __init__(self, rows: np.ndarray, sizes: np.ndarray, bounds: np.ndarray):
        self.rows, self.sizes, self.bounds = rows, sizes, bounds
        powers = np.full(rows.shape[1], np.uint64(_bytes._BASE))
        powers[:1] = 1
        powers = np.multiply.accumulate(powers)
        self.hashes = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
        np.cumsum(_bytes._SYMBOL[rows] * powers, axis=1, out=self.hashes[:, 1:])

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The length of the common prefix of rows a and b, by binary search over prefix hashes."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.sizes[a], self.sizes[b])
        while (open_ := low < high).any():
            middle = (low + high + 1) >> 1
            same = self.hashes[a, middle] == self.hashes[b, middle]
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether row a sorts before row b; ``ties`` decides for equal strings."""
        at = self.extension(a, b)
        end_a, end_b = at == self.sizes[a], at == self.sizes[b]
        last = self.rows.shape[1] - 1
        byte_a, byte_b = self.rows[a, np.minimum(at, last)], self.rows[b, np.minimum(at, last)]
        return np.where(end_a & end_b, ties, np.where(end_a | end_b, end_a, byte_a < byte_b))

    def order(self) -> np.ndarray:
        """Row numbers, sorted within each group."""
        size = np.diff(self.bounds)
        start = np.repeat(self.bounds[:-1], size)
        members = np.repeat(size, size)
        place = np.arange(len(self.rows)) - start
        order = np.arange(len(self.rows))
        width = 1
        while width < size.max(initial=0):
            # Each row's rank in the neighbouring run, by binary search; all groups and runs at once.
            act = np.flatnonzero(members > width)
            mine = place[act] // width
            other = mine ^ 1
            begin = np.minimum(other * width, members[act])
            end = np.minimum(begin + width, members[act])
            low, high = begin.copy(), end
            row, left = order[start[act] + place[act]], mine % 2 == 1
            while (open_ := low < high).any():
                middle = (low + high) >> 1
                k = np.flatnonzero(open_)
                rival = order[start[act[k]] + middle[k]]
                smaller = self.before(rival, row[k], left[k])  # of equal rows, the left run's comes first
                low[k] = np.where(smaller, middle[k] + 1, low[k])
                high = high.copy()
                high[k] = np.where(smaller, high[k], middle[k])
            to = np.minimum(mine, other) * width + (place[act] - mine * width) + (low - begin)
            after = order.copy()
            after[start[act] + to] = row
            order = after
            width *= 2
        return order

    def sorted_extensions(self) -> tuple[np.ndarray, np.ndarray]:
        """The order, and each sorted row's common prefix with the row before it (-1 at a group's start), verified."""
        order = self.order()
        common = np.full(len(order), -1, np.int64)
        inner = np.ones(len(order), bool)
        inner[self.bounds[:-1][np.diff(self.bounds) > 0]] = False
        k = np.flatnonzero(inner)
        common[k] = self.extension(order[k - 1], order[k])
        a, b = self.rows[order[k - 1]], self.rows[order[k]]
        differs = a != b
        true = np.where(differs.any(1), differs.argmax(1), self.rows.shape[1])
        true = np.minimum(true, np.minimum(self.sizes[order[k - 1]], self.sizes[order[k]]))
        if (true != common[k]).any():  # a hash collision: sort these rows by their bytes
            key = [(g, self.rows[r, : self.sizes[r]].tobytes()) for g, r in zip(np.searchsorted(self.bounds, np.arange(len(order)), "right"), range(len(order)), strict=True)]
            order = np.array(sorted(range(len(order)), key=key.__getitem__))
            a, b = self.rows[order[k - 1]], self.rows[order[k]]
            differs = a != b
            true = np.where(differs.any(1), differs.argmax(1), self.rows.shape[1])
            common[k] = np.minimum(true, np.minimum(self.sizes[order[k - 1]], self.sizes[order[k]]))
        return order, common


def repeated_reach(
    contexts: np.ndarray, before: np.ndarray, after: np.ndarray, bounds: np.ndarray, lo: np.ndarray, hi: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """For each context the largest and least offset, ``lo`` to ``hi``, of a repeated window, -1 without one.

    A context row has REACH bytes before the anchor (``before`` of them valid) and LENGTH from it on (``after`` valid).
    """
    right = SuffixSorter(contexts[:, REACH:], after, bounds)
    left = SuffixSorter(np.ascontiguousarray(contexts[:, :REACH][:, ::-1]), before, bounds)
    (by_right, r_common), (by_left, l_common) = right.sorted_extensions(), left.sorted_extensions()
    most, least = np.full(len(contexts), -1, np.int64), np.full(len(contexts), -1, np.int64)
    r_run, l_run = np.empty(len(contexts), np.int64), np.empty(len(contexts), np.int64)
    for o in range(int(lo.min(initial=REACH)), int(hi.max(initial=0)) + 1):
        r_run[by_right] = np.cumsum(r_common < LENGTH - o)
        l_run[by_left] = np.cumsum(l_common < o)
        key = r_run * (len(contexts) + 1) + l_run
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        twice &= (before >= o) & (after >= LENGTH - o) & (lo <= o) & (o <= hi)
        most[twice] = o
        least[twice & (least < 0)] = o
    return most, least


_CONTEXT = "hash long, text_hash long, start long, lo int, hi int, before int, context binary"
_NAMES = ["hash", "text_hash", "start", "lo", "hi", "before", "context"]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each wanted place of a text: what its windows reach.  A tied window's place is its own start, with all bits turned."""
    seen: set[int] = set()
    for batch in batches:
        for row in range(batch.num_rows):
            name = batch.column(1)[row].as_py()
            if name in seen:
                continue
            seen.add(name)
            text = (batch.column(0)[row].as_py() or "").encode()
            place, hashes = (batch.column(k)[row].values.to_numpy() for k in (2, 3))
            start, hi = np.where(place < 0, ~place, place).astype(np.int64), np.where(place < 0, 0, REACH).astype(np.int32)
            before = np.minimum(start, hi).astype(np.int32)
            found = [text[s - b : s + LENGTH] for s, b in zip(start.tolist(), before.tolist(), strict=True)]
            columns = [hashes, np.full(len(start), name), start, np.zeros(len(start), np.int32), hi, before]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(found, pa.binary())], _NAMES)


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each context once for either half of its offsets, cut to what these windows reach, under what they all share."""
    for batch in batches:
        out: list[tuple] = []
        for _, text, start, lo, hi, before, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            middle = (lo + hi) // 2
            for low, high in ((lo, middle), (middle + 1, hi)):
                if before >= low and len(context) - before >= LENGTH - high:
                    shared = context[before - low : before + LENGTH - high]
                    name = hashlib.blake2b(shared, digest_size=8, salt=bytes((low, high))).digest()
                    left = min(before, high)
                    out.append((int.from_bytes(name, "little", signed=True), text, start, low, high, left, context[before - left : before + LENGTH - low]))
        columns = list(zip(*out, strict=True)) if out else [()] * len(_NAMES)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, batch.schema, strict=True)], _NAMES)


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    before = table["before"].to_numpy().astype(np.int64)
    column = table["context"].combine_chunks()
    data, offsets = _bytes.flat(column)
    sizes = np.diff(offsets)
    rows = np.zeros((len(sizes), REACH + LENGTH), np.uint8)
    of = np.repeat(np.arange(len(sizes)), sizes)
    rows[of, np.arange(len(data)) - offsets[of] + (REACH - before)[of]] = data
    return rows, before, sizes - before


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeated windows in anchor groups; rows come sorted by hash, text_hash and start."""

    def of(table: pa.Table) -> pa.RecordBatch:
        hashes, text, start = (table[c].to_numpy() for c in ("hash", "text_hash", "start"))
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1])
        if not new.all():  # the same place, read by several tasks
            table = table.filter(pa.array(new))
            hashes, text, start = hashes[new], text[new], start[new]
        bounds = np.append(np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])), len(hashes))
        lo, hi = (table[c].to_numpy().astype(np.int64) for c in ("lo", "hi"))
        most, least = repeated_reach(*_unpack(table), bounds, lo, hi)
        hit = most >= 0
        return pa.RecordBatch.from_arrays(
            [pa.array(text[hit]), pa.array(start[hit] - most[hit]), pa.array(start[hit] - least[hit] + LENGTH)], ["text_hash", "start", "stop"]
        )

    kept: pa.Table | None = None  # the group that the last batch may not have ended, of about HOT_GROUP rows
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([kept, table]) if kept is not None else table
        hashes = table["hash"].to_numpy()
        cut = int(np.searchsorted(hashes, hashes[-1]))
        kept = table.slice(cut)
        if cut:
            yield of(table.slice(0, cut).combine_chunks())
    if kept is not None and kept.num_rows:
        yield of(kept.combine_chunks())


def _twice(rows: DataFrame) -> DataFrame:
    """Hashes that start in several places, and ``n_``, the number of their rows; copies of one place don't count."""
    place = F.struct("text_hash", "start")
    places = rows.groupBy("hash").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.count("*").alias("n_"))
    return places.filter("x <> y").select("hash", "n_")


def _sorted_groups(contexts: DataFrame) -> DataFrame:
    """Spans of repeated windows within groups, each sorted in one task."""
    partitions = max(1, int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = contexts.select(*_NAMES).repartition(partitions, "hash").sortWithinPartitions("hash", "text_hash", "start")
    return rows.mapInArrow(_compared, "text_hash long, start long, stop long")


def _group_spans(scratch: Scratch, contexts: DataFrame, hot_group: int) -> list[DataFrame]:
    """Spans of repeated windows of all contexts, groups beyond ``hot_group`` of them split until none is left."""
    spans = []

    def parted(rows: DataFrame) -> DataFrame | None:
        """What is in hot groups; the others are sorted."""
        sizes = scratch.save(rows.groupBy("hash").agg(F.count("*").alias("n_")).filter(F.col("n_") > hot_group))
        if sizes.isEmpty():
            spans.append(_sorted_groups(rows))
            return None
        hot = sizes.select("hash")
        few = broadcast_if_small(hot, MAX_HOT_GROUPS)
        join = lambda how: rows.join(few, "hash", how) if few is not hot else spread_join(rows, hot, "hash", how)
        spans.append(_sorted_groups(join("left_anti")))
        return join("left_semi")

    pending = parted(contexts)
    while pending is not None:
        whole = F.struct("hash", "lo", "hi", "before", "context")
        pending = scratch.save(pending.withColumn("whole", whole))
        equal = pending.groupBy("whole").agg(F.count("*").alias("n_"), F.min(F.struct("text_hash", "start")).alias("place"))
        equal = scratch.save(equal)
        repeated = equal.filter("n_ > 1")
        rows = spread_join(pending, repeated.select("whole"), "whole", sizes=repeated.select("whole", "n_"), by=("text_hash", "start"))
        most = F.least("hi", "before")
        least = F.greatest(F.col("lo"), F.lit(LENGTH) - (F.octet_length("context") - F.col("before")))
        covered = rows.filter(most >= least)
        spans.append(covered.select("text_hash", (F.col("start") - most).alias("start"), (F.col("start") - least + LENGTH).alias("stop")))
        left = parted(scratch.save(equal.select("whole.*", "place.*").select(*_NAMES)))
        # Equal contexts being gone, a group of single windows has none that repeats.
        pending = None if left is None else parted(scratch.save(left.filter("lo < hi").mapInArrow(_halves, _CONTEXT)))
    return spans


def repeated_spans(spark: SparkSession, docs: DataFrame, scratch: Scratch, hot_group: int = HOT_GROUP) -> tuple[DataFrame, Column]:
    """``text_hash, spans``: what repeats in each different text, as an array of (start, stop) that may overlap; and the
    name ``text_hash`` as an expression of ``text_hash`` and ``check`` (see ``_hashed``).

    ``docs``: text, at (a hash of the row's other columns, which tells copies apart).
    """
    hashed = _hashed(docs).filter(F.octet_length("text") >= LENGTH)

    def copies_of(name: Column) -> DataFrame:
        rows = hashed.select(name.alias("text_hash"), "check", "at", F.octet_length("text").cast("long").alias("stop")).groupBy("text_hash")
        return scratch.save(rows.agg(F.count("*").alias("n"), F.max("stop").alias("stop"), F.min("at").alias("one"), *checked()).filter("n > 1"))

    name = F.col("text_hash")
    copies = copies_of(name)
    if not copies.filter("check_x <> check_y").isEmpty():
        name = exact_name(copies, "text_hash")
        copies = copies_of(name)
    many = copies.filter(F.col("n") > F.lit(max(1, docs.count() // MANY_COPIES))).select("text_hash", "one")
    texts = hashed.select("text", "at", name.alias("text_hash")).join(F.broadcast(many), "text_hash", "left")  # MANY_COPIES rows at most
    texts = texts.filter("one IS NULL OR at = one").select("text", "text_hash")
    found = scratch.save(texts.mapInArrow(_scan, _FOUND))

    starts = found.filter("kind <= 2").select("hash", "text_hash", "start", (F.col("kind") > 0).alias("tied"))
    wanted = scratch.save(_twice(starts))
    places = scratch.save(spread_join(starts, wanted.select("hash"), "hash", sizes=wanted, by=("text_hash", "start")).distinct())
    place = F.when(F.col("tied"), F.bitwise_not("start")).otherwise(F.col("start")).cast("int")
    lists = places.groupBy("text_hash").agg(F.collect_list(F.struct(place.alias("place"), "hash")).alias("found"))
    lists = scratch.save(lists.select("text_hash", F.col("found.place").alias("places"), F.col("found.hash").alias("hashes")))
    read = _join_lists(texts, lists, "places").select("text", "text_hash", "places", "hashes")
    contexts = scratch.save(read.mapInArrow(_contexts, _CONTEXT))
    spans = _group_spans(scratch, contexts, hot_group)
    spans.append(found.filter("kind = 3").select("text_hash", "start", "stop"))
    # Copies of a text repeat it whole.
    spans.append(copies.select("text_hash", F.lit(0).cast("long").alias("start"), "stop"))
    every = spans[0]
    for more in spans[1:]:
        every = every.unionByName(more)
    joined = every.groupBy("text_hash").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    joined = scratch.save(joined)
    scratch.drop(found, contexts, places)
    return joined, name


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"text_hash": F.xxhash64("text"), "check": F.xxhash64(F.lit(1), "text")})


def _join_lists(rows: DataFrame, lists: DataFrame, column: str, how: str = "inner") -> DataFrame:
    """``rows`` with the lists of their texts: by broadcast only where all lists together are within MAX_BROADCAST_PLACES entries."""
    total = lists.agg(F.coalesce(F.sum(F.size(column)), F.lit(0))).first()[0]
    return rows.join(F.broadcast(lists), "text_hash", how) if total <= MAX_BROADCAST_PLACES else spread_join(rows, lists, "text_hash", how)


def _other_columns(docs: DataFrame) -> Column:
    """A hash of a row's columns beside its text, as far as they are of plain types."""
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name != "text" and isinstance(f.dataType, T.AtomicType)]
    return F.xxhash64(*plain) if plain else F.lit(0).cast("long")


def remove_repeats(spark: SparkSession, docs: DataFrame, hot_group: int = HOT_GROUP) -> DataFrame:
    """``docs`` with ``n_bytes, n_removed, n_spans, kept`` (the remaining bytes) for each row.

    Texts are taken as UTF-8 bytes, null as empty; strings are judged on the input.  Texts shorter than LENGTH stay
    whole.  Repeated rows are copies of each other, and so go whole from LENGTH bytes on.  Other columns stay,
    whatever their names; columns named like a result are replaced.  An empty table gives an empty result.
    """
    scratch = Scratch(spark)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), _other_columns(docs).alias("at"))
    spans, name = repeated_spans(spark, texts, scratch, hot_group)

    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, found in zip(text, spans, strict=True):
            raw = (t.as_py() or "").encode()
            kept, at, removed, runs = [], 0, 0, 0
            for start, stop in sorted((s["start"], s["stop"]) for s in found.as_py() or ()):
                if start > at or not runs:
                    kept.append(raw[at:start])
                    runs += 1
                    removed += stop - start
                    at = stop
                elif stop > at:
                    removed += stop - at
                    at = stop
            kept.append(raw[at:])
            out.append({"n_bytes": len(raw), "n_removed": removed, "n_spans": runs, "kept": b"".join(kept)})
        kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
        return pa.array(out, kind)

    cut.__annotations__ = {"text": pa.Array, "spans": pa.Array, "return": pa.Array}
    cut_udf = F.arrow_udf(cut, "n_bytes long, n_removed long, n_spans long, kept binary")
    names = [c for c in docs.columns if c.lower() not in ("n_bytes", "n_removed", "n_spans", "kept")]
    rows = docs.select(F.struct(*names).alias("row"), F.coalesce("text", F.lit("")).alias("text"), _other_columns(docs).alias("at"))
    rows = _hashed(rows).withColumn("text_hash", name).drop("check")
    rows = _join_lists(rows, spans, "spans", "left")
    return rows.withColumn("cut", cut_udf("text", "spans")).select("row.*", "cut.*")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 200-byte strings that start elsewhere too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = remove_repeats(spark, docs)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
