"""Counterfactual-regularised toxicity classifier.

A logistic regression over words and word beginnings.  In every labelled sentence with an identity term the
term is swapped for another of its group, and the squared change of the sentence's score is a penalty of the
fit, so that naming a group does not by itself move a score.

The vocabulary is chosen by chi-square over all sampled texts in Spark; the fit uses a bounded sample of labelled
rows (``max_fit_rows``, lowest hashes of doc_id first), one text for each id.  The penalty of all sentences together is a
quadratic form over the features of identity terms, some hundreds; its matrix is summed in Spark, so that what the driver
gets does not grow with the number of sentences.  Scoring covers every whole text.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import _bytes
from lodestone.llm._scratch import Scratch
from lodestone.llm.quality import held_out, labelled_sample

MAX_FIT_ROWS = 20_000
VOCABULARY = 3_000
THRESHOLD = 0.5
#: Chi-square (one degree of freedom) and documents that a feature needs to be kept.
LEAST_CHI, LEAST_DOCS = 8.0, 4
#: Lengths in bytes of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Groups of interchangeable identity terms, lower case.
IDENTITY_GROUPS = [
    ["women", "men"], ["woman", "man"], ["girl", "boy"], ["girls", "boys"], ["female", "male"],
    ["gay", "straight", "lesbian", "bisexual", "heterosexual"], ["transgender", "cisgender"],
    ["black", "white", "asian", "latino", "hispanic", "arab"], ["african", "european", "american", "mexican", "chinese"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"],
    ["old", "young"], ["deaf", "blind", "disabled"], ["immigrant", "native"], ["immigrants", "natives"],
    ["frauen", "männer"], ["femmes", "hommes"], ["mujeres", "hombres"],
]
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of letters, digits and non-ASCII bytes in lower-cased bytes."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = _WORD[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    return np.flatnonzero(inside & (~before | first)), np.flatnonzero(before & (~inside | first))


def _feature_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and token number of every feature of a chunk; ``data`` is lower-cased."""
    starts, ends = _tokens(data, offsets)
    hasher = _bytes.Hasher(data)
    hashes, of = [hasher.spans(starts, ends)], [np.arange(len(starts))]
    for k in BEGINNINGS:
        long = np.flatnonzero(ends - starts > k)
        hashes.append(hasher.spans(starts[long], starts[long] + k) ^ np.uint64(0x5851F42D4C957F2D))
        of.append(long)
    return np.concatenate(hashes), np.concatenate(of)


def _word_features(word: str) -> list[int]:
    data = np.frombuffer(word.encode(), np.uint8)
    return [int(h) for h in _feature_hashes(data, np.array([0, len(data)]))[0]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feature, toxic texts and texts that have it, summed over each chunk."""
    for part, raw, offsets in _bytes.chunks(batches):
        data = _bytes.lower(raw)
        hashes, token = _feature_hashes(data, offsets)
        if not len(hashes):
            continue
        doc = np.searchsorted(offsets, _tokens(data, offsets)[0], "right") - 1
        y = part.column(part.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
        pairs = np.unique(np.rec.fromarrays([hashes, doc[token]], names="h,d"))
        kept, at = np.unique(pairs["h"], return_inverse=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kept.view(np.int64)), pa.array(np.bincount(at, weights=y[pairs["d"]]).astype(np.int64)), pa.array(np.bincount(at))],
            ["feature", "toxic", "docs"],
        )


@dataclass
class ToxicityModel:
    vocabulary: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    intercept: float

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << 16, bool)  # the top 16 bits of a hash rule out most features at once
        self.maybe[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, vocabulary entry and count of every vocabulary feature of a chunk; ``data`` is lower-cased."""
        hashes, token = _feature_hashes(data, offsets)
        near = np.flatnonzero(self.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[near]), max(0, len(self.vocabulary) - 1))
        hit = self.vocabulary[at] == hashes[near] if len(self.vocabulary) else np.zeros(0, bool)
        near, at = near[hit], at[hit]
        doc = np.searchsorted(offsets, _tokens(data, offsets)[0][token[near]], "right") - 1
        both, n = np.unique(doc * max(1, len(self.vocabulary)) + at, return_counts=True)
        return both // max(1, len(self.vocabulary)), both % max(1, len(self.vocabulary)), n

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, at, n = self.counts(data, offsets)
        z = self.intercept + np.bincount(doc, weights=np.log1p(n) * self.weights[at], minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _swaps() -> dict[bytes, bytes]:
    return {g[i].encode(): g[(i + 1) % len(g)].encode() for g in IDENTITY_GROUPS for i in range(len(g))}


def _changes(data: np.ndarray, offsets: np.ndarray, model: ToxicityModel) -> Iterator[dict[int, float]]:
    """For each sentence with identity terms: what swapping them changes in its vocabulary features."""
    swaps = _swaps()
    starts, ends = _tokens(data, offsets)
    hashes = _bytes.Hasher(data).spans(starts, ends)
    known = np.sort(np.array([_word_features(t.decode())[0] for t in swaps], np.uint64))
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    marks = np.unique(np.concatenate((offsets, np.flatnonzero(np.isin(data, np.frombuffer(b".!?\n", np.uint8))))))
    place = {int(h): k for k, h in enumerate(model.vocabulary)}
    for s in np.unique(np.searchsorted(marks, starts[known[at] == hashes], "right") - 1):
        end = marks[s + 1] if s + 1 < len(marks) else len(data)
        lo, hi = np.searchsorted(starts, (marks[s], end))
        plain: Counter = Counter()
        swapped: Counter = Counter()
        for word in (data[a:b].tobytes() for a, b in zip(starts[lo:hi], ends[lo:hi], strict=True)):
            plain.update(place[h] for h in _word_features(word.decode(errors="replace")) if h in place)
            swapped.update(place[h] for h in _word_features(swaps.get(word, word).decode(errors="replace")) if h in place)
        change = {k: float(np.log1p(plain[k]) - np.log1p(swapped[k])) for k in plain.keys() | swapped.keys() if plain[k] != swapped[k]}
        if change:
            yield change


#: Products of two features' changes are summed as integers of this fraction, so that no sum depends on its order.
_UNIT = float(1 << 30)


def _products(batches: Iterator[pa.RecordBatch], model: ToxicityModel) -> Iterator[pa.RecordBatch]:
    """``i, j, sum``: the changes' products of two features, i <= j, over all sentences of a task; the number of sentences as (-1, -1).

    Only features of identity terms change, so a task gives at most their number squared of rows.
    """
    sums: defaultdict[tuple[int, int], int] = defaultdict(int)
    for _, raw, offsets in _bytes.chunks(batches):
        for change in _changes(_bytes.lower(raw), offsets, model):
            sums[-1, -1] += 1
            for i, x in change.items():
                for j, z in change.items():
                    if i <= j:
                        sums[i, j] += round(x * z * _UNIT)
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()), pa.array(list(sums.values()), pa.int64())], ["i", "j", "sum"]
        )


def _fit_weights(rows, cols, values, y, changes, n_features: int, ridge: float, fairness: float, positive: float, steps: int):
    """Adam on weighted log loss, a ridge, and ``fairness`` times the mean squared score change of the swaps.

    ``changes``: features (i, j) and the mean product of their changes, each pair in both orders.
    """
    w = np.zeros(n_features + 1)
    w[-1] = -2.0
    cost = np.where(y == 1, positive, 1.0)
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    c_i, c_j, c_mean = changes
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=values * w[cols], minlength=len(y)) + w[-1]
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * cost
        g = np.append(np.bincount(cols, weights=values * r[rows], minlength=n_features) / len(y) + ridge * w[:-1], r.mean())
        if len(c_i):
            g[:-1] += 2 * fairness * np.bincount(c_i, weights=c_mean * w[c_j], minlength=n_features)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        w -= 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS, vocabulary: int = VOCABULARY, fairness: float = 1.0
) -> ToxicityModel:
    """Fit ``labels.toxic``; at most ``max_fit_rows`` labelled ids are read, never held-out ones.

    Of several texts of one id, the one with the smallest hash counts.  The sample is read once and written.
    """
    sample = F.broadcast(labelled_sample(labels, "toxic", max_fit_rows))  # at most max_fit_rows small rows
    scratch = Scratch(docs.sparkSession)
    texts = scratch.save(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(sample, "doc_id"))
    repeated = texts.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("h"), F.count("*").alias("k")).filter("k > 1")
    if not repeated.isEmpty():
        one = texts.join(repeated, "doc_id", "left").filter("h IS NULL OR xxhash64(text) = h").select("doc_id", "text", "y")
        texts = scratch.save(one.dropDuplicates(["doc_id"]))
    seen = texts.agg(F.count("*").alias("n"), F.sum("y").alias("t")).first()
    n, toxic = seen["n"], seen["t"] or 0
    base = (toxic + 1) / (n + 2)
    empty = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), float(np.log(base / (1 - base))))
    if not toxic or toxic == n:
        return empty
    counted = texts.mapInArrow(_counted, "feature long, toxic long, docs long").groupBy("feature")
    counted = counted.agg(F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs"))
    expected = F.col("docs") * (toxic / n)
    chi = (F.col("toxic") - expected) ** 2 / (expected * (1 - toxic / n))
    kept = counted.filter((F.col("toxic") > expected) & (F.col("docs") >= LEAST_DOCS) & (chi >= LEAST_CHI))
    best = kept.orderBy(chi.desc(), "feature").limit(vocabulary).toArrow()
    model = ToxicityModel(np.sort(best["feature"].to_numpy().view(np.uint64)), np.zeros(best.num_rows), empty.intercept)
    if not best.num_rows:
        return empty

    def design(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in _bytes.chunks(batches):
            doc, at, count = model.counts(_bytes.lower(raw), offsets)
            edge = np.cumsum(np.append(0, np.bincount(doc, minlength=part.num_rows))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(edge), pa.array(x)) for x in (at.astype(np.int32), count.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in ("doc_id", "y")), *lists], ["doc_id", "y", "at", "n"])

    # One row an id, of at most as many entries as the vocabulary has; in an order that doesn't depend on partitions.
    kind = texts.schema["doc_id"].dataType.simpleString()
    table = texts.mapInArrow(design, f"doc_id {kind}, y int, at array<int>, n array<int>").toArrow().sort_by("doc_id").combine_chunks()
    lists = table["at"].combine_chunks()
    rows = np.repeat(np.arange(table.num_rows), np.diff(lists.offsets.to_numpy()))
    values = np.log1p(table["n"].combine_chunks().flatten().to_numpy())
    sums = texts.mapInArrow(lambda batches: _products(batches, model), "i int, j int, sum long")
    sums = sums.groupBy("i", "j").agg(F.sum("sum").alias("sum")).orderBy("i", "j").toPandas()  # pairs of identity terms' features
    n_swaps = int(sums["sum"][sums["i"] == -1].sum())
    i, j, mean = (sums[c][sums["i"] >= 0].to_numpy() for c in ("i", "j", "sum"))
    mean, apart = mean / _UNIT / max(1, n_swaps), i != j
    changes = np.append(i, j[apart]), np.append(j, i[apart]), np.append(mean, mean[apart])
    weights, intercept = _fit_weights(
        rows, lists.flatten().to_numpy(), values, table["y"].to_numpy().astype(float), changes,
        len(model.vocabulary), ridge=1e-5, fairness=fairness, positive=2.0, steps=400,
    )
    return ToxicityModel(model.vocabulary, weights, intercept)


def toxicity_score(model: ToxicityModel, text: Column) -> Column:
    """The model's score of a text column, 0 to 1; null counts as empty."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column], ["text"])
        found = [model.score(_bytes.lower(data), offsets) for _, data, offsets in _bytes.chunks(iter([batch]))]
        return pa.array(np.concatenate(found) if found else np.zeros(0))

    return score(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Every row is scored, repeated rows alike; null and empty texts get the score of no evidence.  Without labels
    of both kinds the score is the labels' smoothed share.  Columns other than doc_id and text play no part.
    """
    model = fit_toxicity(docs, labels, max_fit_rows)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity_score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity as ``labels.toxic`` marks it."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return score_toxicity(read("documents"), read("labels"))
