"""The ways that only large or skewed tables take: shuffles beyond broadcasts, hot keys, shared names."""

from __future__ import annotations

import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import _scratch, bpe, embedding_dedup, jaccard_join, mixing, quality, secrets, suffix_dedup, toxicity, url_filter
from lodestone.llm._graph import connected_components
from lodestone.llm._scratch import Scratch, spread_join
from test_texts import ODD, brute_components, counted


def as_rows(df):
    return collections.Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_is_a_join(spark, how, monkeypatch):
    """A key with most rows, null keys and light ones, against the plain join."""
    monkeypatch.setattr(_scratch, "LIGHT_ROWS", 20)
    rows = spark.createDataFrame([(k, (7 if k % 3 else None) if k % 4 else k) for k in range(600)], "n long, key long")
    table = spark.createDataFrame([(k, f"v{k}") for k in range(0, 600, 8)] + [(7, "hot")], "key long, v string")
    assert as_rows(spread_join(rows, table, "key", how)) == as_rows(rows.join(table, "key", how))


def test_components_of_a_star_and_a_chain(spark):
    star = [(5, 10_000 + k) for k in range(3_000)]
    chain = [(100_000 + k, 100_001 + k) for k in range(40)]
    edges = spark.createDataFrame(star + chain + [(100_020, 10_500), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in connected_components(Scratch(spark), edges).collect()}
    assert set(got.values()) == {5} and set(got) == {b for _, b in star} | {100_000 + k for k in range(41)}


def small_docs(spark):
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    near = [(910000 + k, " ".join(base[:k] + ["#"] * (k % 3) + base[k:])) for k in range(26)]
    common = [(920000 + k, "the very same opening of every one of them " + " ".join(f"w{(k * 17 + j) % 400}" for j in range(30))) for k in range(60)]
    return ODD + near + common + [(930000, near[3][1])] * 3


def test_jaccard_beyond_all_bounds(spark, monkeypatch):
    for name, value in {"MAX_BROADCAST_TEXTS": 0, "MAX_BROADCAST_KEPT": 0, "MAX_FREQUENT": 8, "SMALL_GROUP": 2, "BLOCK": 3}.items():
        monkeypatch.setattr(jaccard_join, name, value)
    monkeypatch.setattr(_scratch, "LIGHT_ROWS", 4)
    rows = small_docs(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert counted(jaccard_join.jaccard_components(spark, docs).collect()) == counted(brute_components(rows))
    groups = {c for _, n, c in brute_components(rows) if n}
    assert {r.doc_id for r in jaccard_join.drop_near_duplicates(spark, docs).collect() if (r.text or "").strip()} == groups


def test_sets_that_share_a_name(spark, monkeypatch):
    """With nine first halves for all sets, the second half tells them apart."""
    whole = jaccard_join._digest
    monkeypatch.setattr(jaccard_join, "_digest", lambda s: (whole(s)[0] % 9, whole(s)[1]))
    rows = small_docs(spark)
    got = jaccard_join.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert counted(got.collect()) == counted(brute_components(rows))


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_GROUP, 2])
def test_repeats_beyond_all_bounds_and_with_shared_names(spark, hot, monkeypatch):
    """Shuffled lists, no broadcast of hot groups, texts that share names, texts with many copies."""
    for name, value in {"MAX_BROADCAST_PLACES": 0, "MAX_HOT_GROUPS": 0, "MANY_COPIES": 30}.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    monkeypatch.setattr(suffix_dedup, "_hashed", lambda d: d.withColumns({"text_hash": F.pmod(F.xxhash64("text"), F.lit(11)), "check": F.xxhash64(F.lit(1), "text")}))
    monkeypatch.setattr(_scratch, "LIGHT_ROWS", 4)
    line = "".join(hashlib.md5(str(k).encode()).hexdigest() for k in range(12))
    rows = [r for r in ODD if len(r[1] or "") < 20_000] + [(k, f"{k}" * 30 + line[: 250 + k] + f"{k}x" * 40) for k in range(40)] + [(500 + k, line) for k in range(8)]
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[k : k + 200] for _, b in raw for k in range(len(b) - 199))
    want = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = suffix_dedup.remove_repeats(spark, docs, hot).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert counted(got) == counted(want)


def test_vectors_beyond_the_broadcast_bound(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3, 16))
    rows = [(k, list(map(float, x[k % 3] + 0.02 * rng.standard_normal(16)))) for k in range(90)] + [(200, None), (201, list(map(float, x[0])))] * 2
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = as_rows(embedding_dedup.near_vectors(spark, docs))
    for name, value in {"MAX_BROADCAST_FILTERS": 0, "BLOCK": 4}.items():
        monkeypatch.setattr(embedding_dedup, name, value)
    monkeypatch.setattr(_scratch, "LIGHT_ROWS", 4)
    assert as_rows(embedding_dedup.near_vectors(spark, docs)) == want


def test_mixes_and_masks_beyond_their_bounds(spark, monkeypatch):
    rows = [(k, "w " * (k % 40) + f'token = "{hashlib.sha1(str(k).encode()).hexdigest()}"' * (k % 3 == 0), "abc"[k % 3]) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    scanner = secrets.Scanner([], secrets.fit_forest(secrets.labelled_findings(spark)))
    want = as_rows(mixing.write_mix(spark, docs)), as_rows(secrets.redact_secrets(spark, docs, scanner))
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 0)
    monkeypatch.setattr(mixing, "MAX_BROADCAST_DOCUMENTS", 0)
    monkeypatch.setattr(secrets, "MAX_BROADCAST_SECRETS", 0)
    assert (as_rows(mixing.write_mix(spark, docs)), as_rows(secrets.redact_secrets(spark, docs, scanner))) == want


def test_additive_tables_against_plain_loops():
    """The lookup tables of one feature are those of a loop over rows; a score is the sum of its entries."""
    rng = np.random.default_rng(2)
    x = np.round(rng.random((200, 2)), 1)
    y = (x[:, 0] > 0.5).astype(float)
    model = quality.fit_additive(x, y, n_bins=8, rounds=3, n_pairs=1)
    bins = model.bins(x)
    z = [model.intercept + sum(t[b[k]] for t, b in zip(model.tables, bins)) + sum(t[bins[i][k], bins[j][k]] for (i, j), t in model.pairs.items()) for k in range(len(x))]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-np.array(z))))
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.97


def test_toxicity_penalty_is_the_sum_over_sentences(spark):
    """The matrix summed in tasks gives the penalty that a loop over all sentences gives, repeated ids counted once."""
    kinds = ["A christian met a woman. The old tree is green! ", "A muslim met a woman. The young gay boy is an idiot! "]
    texts = [(k, kinds[k % 2] * (1 + k % 3) + "muslim idiot." * (k % 2)) for k in range(40)]
    docs = spark.createDataFrame(texts + [(0, "another text of the same id")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    a, b = (toxicity.fit_toxicity(d, labels) for d in (docs, docs.repartition(7)))
    assert np.array_equal(a.vocabulary, b.vocabulary) and np.allclose(a.weights, b.weights, atol=1e-9)
    data = np.frombuffer(texts[5][1].lower().encode(), np.uint8)
    w = np.arange(1.0, len(a.vocabulary) + 1)
    changes = list(toxicity._changes(data, np.array([0, len(data)]), a))
    want = sum(sum(v * w[k] for k, v in c.items()) ** 2 for c in changes)
    got = next(toxicity._products(iter([pa.RecordBatch.from_arrays([pa.array([texts[5][1]])], ["text"])]), a)).to_pylist()
    total = sum(r["sum"] / toxicity._UNIT * w[r["i"]] * w[r["j"]] * (2 if r["i"] != r["j"] else 1) for r in got if r["i"] >= 0)
    assert abs(total - want) < 1e-5 * max(1, want) and [r["sum"] for r in got if r["i"] < 0] == [len(changes)]


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """Nulls, empties, long texts, repeats, clashing columns and no rows at all pass every stage."""
    import corpus_pipeline as cp

    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(8)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(1, None, "en", None, 0), (2, "", None, "a", 0), (3, "word " * 40_000, "en", "a", 1), (3, "word " * 40_000, "en", "a", 1), (None, "some words of a null id", "en", "b", 2), (5, "\u0001 é <|endoftext|>", "fr", "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in ("row", "node", "copies", "secrets")})
    for table in (docs, docs.limit(0)):
        now = table
        for name, stage in cp.STAGES:
            done = stage(spark, now, str(tmp_path))
            assert done.count() >= 0
            if name != cp.STAGES[-1][0]:
                assert done.columns == docs.columns
                now = done
        assert bpe.encode(spark, now).count() == now.count()


def test_one_site_holds_most_pages(spark, monkeypatch):
    monkeypatch.setattr(_scratch, "LIGHT_ROWS", 4)
    rules = [("hot.example", "/a/", "block"), ("other.example", "/", "block"), ("", "", "block")]
    urls = ["https://hot.example/a/b"] * 300 + [None] * 200 + ["no scheme"] * 50 + ["http://other.example/"] + [f"http://h{k}.example/" for k in range(40)]
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)], "page_id long, url string, Host string, VERDICT string")
    got = url_filter.filter_urls(spark, pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    assert len(rows) == len(urls) == got.count()
    assert {rows[k] for k in range(300)} == {("hot.example", "/a/b", "hot.example/a/", "block")}
    assert {rows[k] for k in range(300, 550)} == {("", "", "", "block")}
    assert rows[550] == ("other.example", "/", "other.example/", "block") and {rows[k][2:] for k in range(551, len(urls))} == {(None, "allow")}
