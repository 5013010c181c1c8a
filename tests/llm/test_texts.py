"""Text operators against brute force, the tokenizers library and each other, with every odd row."""

from __future__ import annotations

import collections
import hashlib
import re
import string

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, jaccard_join, suffix_dedup

SF = "/root/testdata/sf0.001"
LONG = "".join(hashlib.md5(str(k).encode()).hexdigest() for k in range(40))
ODD = [
    (900001, None), (900002, ""), (900003, " \t\n"), (900004, "One two three"), (900005, "one TWO three"), (900006, "é ñ 日本語 👍🏽 it's we'll  x"),
    (900007, "<|endoftext|> a <|endoftext|><|endoftext|>b \u0000 \u0001"), (900008, LONG), (900008, LONG), (900009, "zz" + LONG[:700]), (900010, LONG[:199]),
    (900011, "ab" * 4000), (900012, "word " * 30000), (None, LONG), (None, None), (900013, "a" * 200), (900014, "b" + "a" * 199 + "c"), (900015, "'s 're\u00a0 \r\n12½ ١٢"),
]
EXTRA = ["row", "text_hash", "spans", "cut", "node", "n", "root", "size", "place", "ids", "word", "kept"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(ODD, "doc_id long, text string"))
    return rows.withColumns({c: F.lit("x") for c in EXTRA})


@pytest.fixture(scope="module")
def table(docs):
    return docs.select("doc_id", "text").toPandas()


def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, node int")


def counted(rows):
    return collections.Counter(tuple(None if pd.isna(v) else v for v in r) for r in rows)


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_GROUP, 2])
def test_repeated_bytes(spark, docs, table, hot):
    raw = [(None if pd.isna(i) else int(i), (t or "").encode()) for i, t in zip(table.doc_id, table.text)]
    seen = collections.Counter(b[k : k + 200] for _, b in raw for k in range(len(b) - 199))
    want = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.remove_repeats(spark, docs, hot).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert counted(got) == counted(want)


def test_hash_compared_sort_agrees_with_bytes():
    import numpy as np

    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 99, rng.integers(0, 12)).astype(np.uint8)) for _ in range(500)]
    rows = np.zeros((500, 16), np.uint8)
    for k, w in enumerate(words):
        rows[k, : len(w)] = list(w)
    bounds = np.array([0, 1, 3, 200, 200, 500])
    order, common = suffix_dedup.SuffixSorter(rows, np.array([len(w) for w in words]), bounds).sorted_extensions()
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        assert [words[k] for k in order[lo:hi]] == sorted(words[lo:hi])
        for k in range(lo + 1, hi):
            a, b = words[order[k - 1]], words[order[k]]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert common[k] == n


@pytest.mark.parametrize("chunk_words", [bpe.CHUNK_WORDS, 200])
def test_bpe_agrees_with_the_library(spark, docs, table, chunk_words):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_tokenizer())
    want = []
    for i, t in zip(table.doc_id, table.text):
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((None if pd.isna(i) else int(i), len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert counted(bpe.encode_digests(spark, docs, chunk_words=chunk_words).collect()) == counted(want)


def test_bpe_round_trip_keeps_other_columns(spark, docs):
    rows = bpe.encode(spark, docs.filter("doc_id = 900006 OR doc_id = 900001"))
    got = {r.doc_id: (r.ids, r.back, r.node) for r in rows.withColumn("back", bpe.decode_ids(spark, F.col("ids"))).collect()}
    assert got[900001] == ([], "", "x") and got[900006][1] == ODD[5][1]


def brute_components(rows):
    low = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    sets, inverse = [], collections.defaultdict(list)
    for k, (_, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
        for s in sets[-1]:
            inverse[s].append(k)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, s in enumerate(sets):
        shared = collections.Counter(j for g in s for j in inverse[g] if j > k)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                up[find(k)] = find(j)
    names = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            names[find(k)].append(i)
    return [(i, len(sets[k]), min(names[find(k)], default=None)) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize(("small", "block"), [(jaccard_join.SMALL_GROUP, jaccard_join.BLOCK), (1, 2)])
def test_jaccard_components(spark, docs, table, small, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL_GROUP", small)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = [(None if pd.isna(i) else int(i), t) for i, t in zip(table.doc_id, table.text)]
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    near = [(910000 + k, " ".join(base[:k] + ["#"] * (k % 3) + base[k:])) for k in range(26)]
    more = spark.createDataFrame(near, "doc_id long, text string").withColumns({c: F.lit("x") for c in EXTRA})
    got = jaccard_join.jaccard_components(spark, docs.unionByName(more)).collect()
    assert counted(got) == counted(brute_components(rows + near))


def test_one_row_of_each_group_stays(spark, docs, table):
    rows = [(None if pd.isna(i) else int(i), t) for i, t in zip(table.doc_id, table.text)]
    got = jaccard_join.drop_near_duplicates(spark, docs)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    groups = collections.Counter(c for i, n, c in brute_components(rows) if n)
    ids = {i for i, t in kept if (t or "").strip()}
    assert ids == set(groups) and len([1 for i, t in kept if (t or "").strip()]) == len(groups)
    assert sorted((i or 0) for i, t in kept if not (t or "").strip()) == [0, 900001, 900002, 900003]


def test_empty_tables(spark):
    empty = none(spark)
    assert suffix_dedup.remove_repeats(spark, empty).count() == 0
    assert bpe.encode_digests(spark, empty).count() == 0 and bpe.encode(spark, empty).count() == 0
    assert jaccard_join.jaccard_components(spark, empty).count() == 0 and jaccard_join.drop_near_duplicates(spark, empty).count() == 0
