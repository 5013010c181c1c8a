"""Spelling variants against a plain loop over all pairs of words."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import _scratch, spelling
from lodestone.llm.registry import oracle_sql

LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]))


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall(f"[{LETTERS}]+", text or ""):
            run = re.sub("[A-Z]", lambda c: c[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain(counts):
    found = {}
    for w, n in counts.items():
        others = [(-counts[o], o) for o in counts if near(w, o)]
        best = min(others, default=(0, None))
        found[w] = (best[1] if best[1] and -best[0] >= 2 * n else None, len(others))
    rows = []
    for w, (form, n_near) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        rows.append((w, form, root, counts[w], n_near, counts[form] if form else None))
    return sorted(rows)


def rows_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@pytest.mark.parametrize("bits", [64, 8])
def test_all_pairs(spark, bits):
    rng = np.random.default_rng(bits)
    alphabet = list("aabé") + ["ß"]
    words = {"".join(rng.choice(alphabet, int(rng.integers(5, 8)))) for _ in range(500 if bits == 64 else 150)} | {"a" * k for k in range(5, 12)} | {"é" * 6, "x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1499}
    counts = {w: int(rng.choice([3, 4, 8, 16, 40, 90, 300])) for w in words}
    df = spark.createDataFrame([(w, n, 1) for w, n in counts.items()] + [(None, 9, 1)], "word string, n int, id long")
    assert rows_of(spelling.spelling_variants(spark, df, bits=bits)) == plain(counts)


def test_whole_query(spark, monkeypatch):
    rng = np.random.default_rng(5)
    stems = ["".join(rng.choice(list("abcdeüéÀ"), 7)) for _ in range(30)]
    text = lambda: " ".join(w[:k] + str(rng.choice(["", "x", "É"])) + w[k + int(rng.integers(2)) :] for w, k in zip(rng.choice(stems, 60), rng.integers(0, 8, 60)))
    docs = [(int(i), text()) for i in range(300)] + [(5, "Wörter-wörter wörtER×× 123 wörter"), (5, "wörter"), (None, "wörter wortey " * 40), (6, None), (7, ""), (8, "longer " * 30_000), (9, "q" * 40_000)]
    monkeypatch.setattr(_scratch, "LIGHT_ROWS", 4)
    monkeypatch.setattr(_scratch, "HEAVY_KEYS", 10)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("word", "N", "run", "id", "form")})
    assert rows_of(spelling.spelling_variants(spark, spelling.word_counts(df.repartition(7)))) == plain(plain_counts(docs))
    assert spelling.spelling_variants(spark, spelling.word_counts(df.limit(0))).count() == 0


def test_query_equals_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    got = spelling.op12_spelling(spark, folder)
    told = duckdb.connect()
    told.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    cursor = told.execute(oracle_sql()["op12_spelling"])
    assert [d[0] for d in cursor.description] == got.columns
    rows = rows_of(got)
    assert rows == sorted(cursor.fetchall()) and len(rows) > 100
    assert rows == plain(plain_counts([(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]))
