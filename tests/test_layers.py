"""Nearest vectors against plain loops, and which layer answers what."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import grounding, layers, nearest

VECTOR = "vec_id long, kind string, embedding array<float>"


def cosine(a, b):
    return math.fsum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(math.fsum(x * x for x in a) * math.fsum(y * y for y in b))


@pytest.mark.parametrize("own", [False, True])
def test_nearest_against_plain_loops(spark, monkeypatch, own):
    for name, rows in (("SLICE_ROWS", 40), ("BLOCK_ROWS", 7), ("STEP_ROWS", 16)):
        monkeypatch.setattr(nearest, name, rows)
    rng = random.Random(3)
    rows = [(k, rng.choice(["a", "b"]), [float(rng.randrange(-3, 4)) for _ in range(4)]) for k in range(150)]
    rows += [(150 + k, "b", rows[0][2]) for k in range(40)]  # ties: copies of one vector
    rows += [(200, "a", [1.0, 2.0]), (201, "a", [2.0, 4.0]), (202, "a", None), (203, "b", [1.0, None, 1.0, 1.0]), (204, "b", [float("nan")] * 4), (205, "a", [float("inf")] * 4), (206, "a", []), (207, None, [1.0, 1.0, 1.0, 1.0])]
    good = [(i, kind or "", v) for i, kind, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    asked = [(i, v) for i, _, v in rows if i % 10 == 0 or i > 200]
    df = spark.createDataFrame(rows, VECTOR).repartition(3)
    got = nearest.nearest(df, spark.createDataFrame(asked, "query_id long, embedding array<float>"), 5, 0.1, by="kind", own=own)
    got = sorted((r.query_id, r.kind, r["rank"], r.vec_id, r.relevance) for r in got.collect())
    want = []
    for qid, qv in asked:
        if qid not in {i for i, _, _ in good}:
            continue
        for kind in ("", "a", "b"):
            near = [(-round(cosine(qv, v) + 1e-12, 6), i) for i, k, v in good if k == kind and len(v) == len(qv) and (own or i != qid)]
            want += [(qid, kind, n + 1, i, -s) for n, (s, i) in enumerate(sorted(x for x in near if -x[0] >= 0.1)[:5])]
    assert [g[:4] for g in got] == [w[:4] for w in sorted(want)]
    assert all(abs(g[4] - w[4]) < 2e-6 for g, w in zip(got, sorted(want), strict=True))


def test_nearest_of_extreme_and_no_vectors(spark):
    rows = [(1, "a", [1e30, 1e30]), (2, "a", [1e-30, 1e-30]), (3, "a", [-1e30, 1e-30])]
    df = spark.createDataFrame(rows, VECTOR)
    asks = df.select(F.col("vec_id").alias("query_id"), "embedding")
    assert {(r.query_id, r.vec_id, r.relevance) for r in nearest.nearest(df, asks, 3, 0.28).collect()} == {(1, 2, 1.0), (2, 1, 1.0)}
    assert nearest.nearest(df.filter("false"), asks, 3, 0.28).count() == nearest.nearest(df, asks.filter("false"), 3, 0.28).count() == 0


CORPUS = "kind string, id long, body string, embedding array<float>, status string, superseded_by string, source_org string, confidence double, source_url string, provenance string"
META = "kind string, model string, embedded_at long"


def row(kind, at, body, vector, status="active", org=None, provenance=None):
    return kind, at, body, vector, status, None, org, 0.5, None, provenance


ROWS = [
    row("rule", 1, "title words", [1.0, 0.0]), row("rule", 2, "title title", [0.0, 1.0]), row("rule", 3, "title", [1.0, 0.01], "retired"),
    row("ap", 1, "title", None), row("ap", 2, "nothing here", None), row("playbook", 1, "title play", [1.0, 0.0]), row("playbook", 2, None, None),
    row("other", 1, "title", [1.0, 0.0]),
]
ASKS = [(1, "the title", [1.0, 0.0]), (2, "title", None), (3, None, [0.0, 0.0]), (4, "title", [-1.0, -1.0])]


def hits(spark, meta, model="m", rows=ROWS):
    args = spark.createDataFrame(rows, CORPUS), spark.createDataFrame(ASKS, "query_id long, text string, embedding array<float>"), spark.createDataFrame(meta, META)
    return {(r.query_id, r.kind, r.id, r.layer, r.degraded) for r in layers.layered_hits(*args, model, 8).collect()}


BARE = {("rule", 1), ("rule", 2), ("ap", 1), ("playbook", 1)}


def test_layers_by_kind_and_query(spark):
    want = {(1, "rule", 1, "vector", None), (1, "ap", 1, "fts", None), (1, "playbook", 1, "fts", None), (4, "ap", 1, "fts", None), (4, "playbook", 1, "fts", None)}
    want |= {(2, kind, at, "fts", None) for kind, at in BARE}
    for meta in ([], [("rule", "m", 5), ("rule", "old", 4)], [("ap", "old", 9)], [("rule", None, 9)]):
        assert hits(spark, meta) == want


def test_other_space_is_refused(spark):
    want = {(q, kind, at, "fts", "model_mismatch") for q in (1, 2, 4) for kind, at in BARE}
    assert hits(spark, [("rule", "m", 4), ("rule", "other", 5)]) == want


def test_no_vectors_at_all(spark):
    assert hits(spark, [], rows=[r[:3] + (None,) + r[4:] for r in ROWS]) == {(q, kind, at, "fts", None) for q in (1, 2, 4) for kind, at in BARE}


def test_ranking_over_layers(spark):
    rows = [row("rule", k, "x", [1.0, 0.0], org=org, provenance=p) for k, (org, p) in enumerate([("HubSpot", None), ("Google", "neighbor-inferred"), ("Google", None), ("Google", "extracted")])]
    rows += [row("playbook", 9, "title title", None)]
    asks = spark.createDataFrame([(1, "title", [1.0, 0.0])], "query_id long, text string, embedding array<float>")
    got = layers.layered_citations(spark.createDataFrame(rows, CORPUS), asks, spark.createDataFrame([], META), "m", 5)
    assert [(r.kind, r.id) for r in got.orderBy("rank").collect()] == [("playbook", 9), ("rule", 3), ("rule", 2), ("rule", 1), ("rule", 0)]


def test_words_by_broadcast_and_by_shuffle(spark):
    docs = spark.createDataFrame([(1, "k", "red red blue"), (2, "k", "blue"), (3, "j", "red"), (4, "j", None)], "doc_id long, kind string, text string")
    asks = spark.createDataFrame([(1, "red blue blue"), (2, "blue"), (3, ""), (4, None)], "query_id long, text string")
    for by in ((), ("kind",)):
        both = [sorted(map(tuple, grounding.full_text(docs, asks, 2, rows, by).collect())) for rows in (100, 1)]
        assert both[0] == both[1]
        assert len(both[0]) == (5 if by else 4)
    assert sorted(map(tuple, grounding.full_text(docs, asks, 2).collect())) == [(1, 1, 1, 3), (1, 2, 2, 1), (2, 1, 1, 1), (2, 2, 2, 1)]
