"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees, one feature after another with a small step, learns a lookup table for each
feature; then the strongest pairs of features get tables of their own the same way.  A score is the sum of one
entry of each table, so scoring is binning and vectorised additions.

Features come from the bytes of the whole text alone.  The fit uses a bounded sample of labelled rows
(``max_fit_rows``, lowest hashes of doc_id first); everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import _bytes

#: Labelled rows that the fit reads at most (about 5 MB of features on the driver).
MAX_FIT_ROWS = 40_000
THRESHOLD = 0.3
#: Byte classes whose share of the text is a feature.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "symbol": b"#$%&*^~_=+<>@\\/{}[]",
    "bar": b"|",
    "shout": b"!?",
    "stop": b".,;:",
    "newline": b"\n",
}
FEATURES = ["log_bytes", *CLASSES, "word_bytes", "distinct_words", "echo_words", "distinct_lines"]


def _distinct_share(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per text: distinct values over values; 1 where there are none."""
    n = np.diff(bounds)
    of = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, of))
    h, o = hashes[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return np.where(n > 0, np.bincount(o[new], minlength=len(n)) / np.maximum(n, 1), 1.0)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of a chunk; an empty text has zeros and full distinctness."""
    n_bytes = np.diff(offsets)
    out = [np.log1p(n_bytes)]
    for chars in CLASSES.values():
        table = np.zeros(256, np.int64)
        table[np.frombuffer(chars, np.uint8)] = 1
        sums = np.concatenate(([0], np.cumsum(table[data])))
        out.append((sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(n_bytes, 1))
    starts, ends, bounds = _bytes.words(data, offsets)
    n_words = np.maximum(np.diff(bounds), 1)
    hasher = _bytes.Hasher(_bytes.lower(data))
    hashes = hasher.spans(starts, ends)
    of = np.repeat(np.arange(len(n_bytes)), np.diff(bounds))
    total = np.bincount(of, weights=ends - starts, minlength=len(n_bytes))
    echo = np.zeros(len(hashes), bool)
    echo[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    out += [total / n_words, _distinct_share(hashes, bounds), np.bincount(of, weights=echo, minlength=len(n_bytes)) / n_words]
    inner = np.flatnonzero(data == 10)
    cut = np.unique(np.concatenate((offsets[:-1][n_bytes > 0], inner + 1)))
    line_starts = cut[cut < len(data)]
    line_starts = line_starts[np.isin(line_starts, offsets[:-1]) | (data[line_starts - 1] == 10)]
    line_ends = np.concatenate((line_starts[1:], [len(data)])).astype(np.int64)[: len(line_starts)]
    out.append(_distinct_share(hasher.spans(line_starts, line_ends), np.searchsorted(line_starts, offsets)))
    return np.column_stack(out)


def _split(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram in two."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    gt, ht = g.sum(), h.sum()
    gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A step for each bin: the tree cuts the histogram greedily into at most ``leaves`` ranges."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        (gain, cut), (lo, hi) = max(((_split(g[lo:hi], h[lo:hi], ridge), (lo, hi)) for lo, hi in parts), key=lambda x: x[0][0])
        if gain <= 1e-9:
            break
        parts.remove((lo, hi))
        parts += [(lo, lo + cut), (lo + cut, hi)]
    step = np.zeros(len(g))
    for lo, hi in parts:
        step[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + ridge)
    return step


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and steps of the best pair of cuts, one on each axis of a two-way histogram."""
    gs, hs = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    best, step = 0.0, np.zeros_like(g)
    a, b = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]
    if not a.size or not b.size:
        return best, step

    def four(s: np.ndarray) -> list[np.ndarray]:
        ll, low, left, full = s[a, b], s[a, -1], s[-1, b], s[-1, -1]
        return [ll, low - ll, left - ll, full - low - left + ll]

    gain = sum(x**2 / (y + ridge) for x, y in zip(four(gs), four(hs), strict=True)) - gs[-1, -1] ** 2 / (hs[-1, -1] + ridge)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            step[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + ridge)
    return float(gain[i, j]), step


@dataclass
class AdditiveModel:
    """Cuts and lookup tables; ``pairs`` maps two features to a table over their bins."""

    intercept: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.cuts)]

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.intercept)
        for k, table in enumerate(self.tables):
            z += table[b[k]]
        for (i, j), table in self.pairs.items():
            z += table[b[i], b[j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_additive(
    x: np.ndarray, y: np.ndarray, n_bins: int = 32, rounds: int = 60, rate: float = 0.2, leaves: int = 3, n_pairs: int = 4, ridge: float = 2.0
) -> AdditiveModel:
    """Cyclic boosting for log loss.  Without both labels the model is their smoothed share."""
    base = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(base / (1 - base))))
    if not len(y) or y.min() == y.max():
        return model
    for column in x.T:
        values = np.unique(column)
        grid = np.linspace(0, 1, n_bins // 2 + 2)[1:-1]
        cuts = np.concatenate((np.quantile(column, grid), np.quantile(values, grid)))
        model.cuts.append(np.unique(cuts[(cuts > values[0]) & (cuts <= values[-1])]))
    bins = model.bins(x)
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    z = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            g, h = (np.bincount(bins[k], weights=w, minlength=len(table)) for w in slopes())
            step = rate * _shallow_tree(g, h, leaves, ridge)
            table += step
            z += step[bins[k]]

    def two_way(i: int, j: int) -> list[np.ndarray]:
        shape = (len(model.tables[i]), len(model.tables[j]))
        at = bins[i] * shape[1] + bins[j]
        return [np.bincount(at, weights=w, minlength=shape[0] * shape[1]).reshape(shape) for w in slopes()]

    ranked = sorted(
        ((_quadrants(*two_way(i, j), ridge)[0], i, j) for i in range(len(bins)) for j in range(i + 1, len(bins))), reverse=True
    )
    model.pairs = {(i, j): np.zeros((len(model.tables[i]), len(model.tables[j]))) for _, i, j in ranked[:n_pairs]}
    for _ in range(rounds // 2):
        for (i, j), table in model.pairs.items():
            step = rate * _quadrants(*two_way(i, j), ridge)[1]
            table += step
            z += step[bins[i], bins[j]]
    return model


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text mod 5 is 0; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """doc_id and label (0/1) of at most ``max_rows`` ids outside the held-out fold, lowest hashes first.

    Null ids and labels don't count; of several labels of an id the mean decides, 1 from 0.5 on.
    """
    known = labels.select("doc_id", F.col(label).cast("double").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    return known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(max_rows)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in _bytes.chunks(batches):
        x = features(data, offsets)
        yield pa.RecordBatch.from_arrays(
            [part.column(part.schema.get_field_index(c)) for c in ("doc_id", "y")] + [pa.array(x[:, k]) for k in range(x.shape[1])],
            ["doc_id", "y", *FEATURES],
        )


def fit_quality(docs: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> AdditiveModel:
    """Fit ``labels.quality`` on the features of ``docs.text``; see ``labelled_sample`` for the rows used.

    Of several texts of one id, the one with the smallest features counts.
    """
    sample = F.broadcast(labelled_sample(labels, "quality", max_fit_rows))  # at most max_fit_rows small rows
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").join(sample, "doc_id")
    rows = rows.mapInArrow(_feature_rows, f"doc_id {kind}, y int, " + ", ".join(f"{f} double" for f in FEATURES))
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.min(F.struct(*FEATURES)).alias("x"))
    table = rows.select("doc_id", "y", "x.*").toArrow().sort_by("doc_id")
    x = np.column_stack([table[f].to_numpy() for f in FEATURES]) if table.num_rows else np.zeros((0, len(FEATURES)))
    return fit_additive(x, table["y"].to_numpy().astype(float))


def quality_score(model: AdditiveModel, text: Column) -> Column:
    """The model's score of a text column, 0 to 1; null counts as empty."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column], ["text"])
        found = [model.score(features(data, offsets)) for _, data, offsets in _bytes.chunks(iter([batch]))]
        return pa.array(np.concatenate(found) if found else np.zeros(0))

    return score(text)


def score_quality(docs: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Every row is scored, repeated rows alike; null and empty texts get the empty text's score.  With no usable
    label the score is 0.5 throughout.  Columns other than doc_id and text play no part.
    """
    model = fit_quality(docs, labels, max_fit_rows)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality_score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality as ``labels.quality`` marks it."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return score_quality(read("documents"), read("labels"))
