"""Vector operators against brute force."""

from __future__ import annotations

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import embedding_dedup, topk

NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("label", "node", "n", "filter", "score", "rank")})


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 24))
    out = [(k, list(map(float, v))) for k, v in enumerate(x)]
    for k in range(300):  # pairs on both sides of the threshold, and chains
        v = x[k % 60] / np.linalg.norm(x[k % 60])
        u = rng.standard_normal(24)
        u -= (u @ v) * v
        c = [0.951, 0.949, 0.97, 0.99][k % 4]
        out.append((1000 + k, list(map(float, 3 * (c * v + np.sqrt(1 - c * c) * u / np.linalg.norm(u))))))
    out += [(2000, out[0][1]), (2001, out[0][1]), (2000, out[0][1]), (2002, [0.0] * 24), (2003, None), (2004, []), (2005, [NAN] * 24), (2006, [INF] + [1.0] * 23)]
    out += [(2007, [None] + [1.0] * 23), (2008, [1.0, 2.0]), (2009, [2.0, 4.0]), (None, out[5][1]), (2010, [1e300] * 24), (2011, [1e-300] * 24)]
    return out


def usable(v):
    return v and all(c is not None and np.isfinite(c) for c in v) and any(v)


@pytest.mark.parametrize("block", [embedding_dedup.BLOCK, 4])
def test_near_vectors(spark, rows, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    unit = []
    for _, v in rows:
        w = np.array(v, float) / np.abs(v).max() if usable(v) else None
        unit.append(None if w is None else w / np.linalg.norm(w))
    links = {k: set() for k in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95:
                links[a].add(b), links[b].add(a)
    want = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j), todo.append(j)
        names = [rows[j][0] for j in seen if rows[j][0] is not None]
        want.append((i, len(links[k]), min(names, default=None), i is not None and i == min(names)))
    got = [tuple(r) for r in embedding_dedup.near_vectors(spark, frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("shards", [(4096, 65536), (50, 50)])
def test_top_k(spark, rows, shards, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", shards)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    plain = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows if i is not None and i < 2010 and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    want, asked = [], set()
    for i, v in plain:
        if i % 50 == 0 and i not in asked:
            asked.add(i)
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in plain if j != i)[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scores)]
    got = [tuple(r) for r in topk.top_k(spark, frame(spark, [r for r in rows if r[0] is not None and r[0] < 2010])).collect()]
    assert sorted(got) == sorted(want)


def test_top_k_with_fewer_candidates_and_ties(spark):
    got = topk.top_k(spark, frame(spark, [(0, [1.0, 0.0]), (2, [0.5, 0.0]), (1, [0.5, 9.0]), (None, [1.0, 1.0])])).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 1, 32768), (0, 2, 2, 32768)]


def test_top_k_of_components_beyond_64_bits(spark):
    """Finite components of any size take part and are ranked exactly."""
    rows = [(0, [1e300, 1.0]), (1, [1.0, 2.0]), (2, [-1e300, 0.0]), (3, [1e300, 3.0]), (4, [1e300, 2.0]), (5, [9e15, 1e10]), (50, [0.5, -0.25]), (100, [2e9, 0.0])]
    exact = {i: [int(c) * 256 if abs(c) >= 2**53 else int(np.floor(256 * c)) for c in v] for i, v in rows}
    want = []
    for q in (0, 50, 100):
        scores = sorted((-sum(a * b for a, b in zip(exact[q], v)), j) for j, v in exact.items() if j != q)[:5]
        want += [(q, k + 1, j, min(max(-s, -(2**63)), 2**63 - 1)) for k, (s, j) in enumerate(scores)]
    got = [tuple(r) for r in topk.top_k(spark, frame(spark, [(i, list(map(float, v))) for i, v in rows])).collect()]
    assert sorted(got) == sorted(want)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_vectors(spark, empty).count() == 0 and topk.top_k(spark, empty).count() == 0


def test_recall_at_the_threshold():
    """Unit vectors exactly at 0.95 share a filter nearly always."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    u = rng.standard_normal(x.shape)
    u -= (u * x).sum(1)[:, None] * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * u / np.linalg.norm(u, axis=1)[:, None]
    codes = [embedding_dedup.CapCodes(64, 256, r, 8.0, 8, 11) for r in range(2)]
    a, b = ([np.concatenate(f) for f in zip(*(c.decode(z) for c in codes))] for z in (x, y))
    assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b)]) > 0.99


@pytest.mark.parametrize("code_words", [512, 2048])
def test_recall_of_the_defaults_on_larger_tables(code_words):
    """Unit vectors exactly at 0.95 share a filter however many code words a larger table has."""
    rotations = inspect.signature(embedding_dedup.near_vectors).parameters["rotations"].default
    rng = np.random.default_rng(4)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    u = rng.standard_normal(x.shape)
    u -= (u * x).sum(1)[:, None] * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * u / np.linalg.norm(u, axis=1)[:, None]
    codes = [embedding_dedup.CapCodes(64, code_words, r, 8.0, 8, 11) for r in range(rotations)]
    a, b = ([np.concatenate(f) for f in zip(*(c.decode(z) for c in codes))] for z in (x, y))
    assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b)]) > 0.999
