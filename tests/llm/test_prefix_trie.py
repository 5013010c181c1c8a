"""The prefix trie against a plain loop over whole prefixes."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import _scratch, prefix_trie
from lodestone.llm.registry import oracle_sql

KIND = "conv_id long, turn long, role string, text string"


def plain(rows, forked=True):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(t)] for c, t in convs.items()}
    made = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 4 if forked else 0
        made[c] = tuple(convs.get(c - c % 20, [])[:h] + convs[c][h:])
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
            if d:
                kids[made[c][: d - 1]].add(made[c][:d])
        ends[made[c]].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(who) - 1) * words
    return sorted(
        (who[0], len(node), members[node[:-1]][0] if node else -1, len(who), len(kids[node]), leaves[node], saved[node], hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest())
        for node, who in members.items()
    )


def found(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def chats(n=400, seed=3):
    """Conversations of few different turns, so that prefixes meet; odd rows among them."""
    rng = np.random.default_rng(seed)
    texts = ["", "hi", "hi there", " a  b\tc ", "é ü", None, "hi "]
    rows = []
    for c in rng.permutation(n + 40)[:n]:
        for t in range(int(rng.integers(1, 7))):
            rows.append((int(c), [t, None, 2][int(rng.choice(3, p=[0.9, 0.05, 0.05]))], [None, "user", "assistant"][int(rng.integers(3))], texts[int(rng.integers(len(texts)))]))
    rows += [(7, 1, "user", "hi")] * 3 + [(None, 1, "user", "hi"), (-5, None, None, None), (10**15, 0, "user", "long " * 50_000)]
    return rows


@pytest.mark.parametrize("bits", [64, 6])
def test_trie_with_forks_and_collisions(spark, bits):
    rows = chats() if bits == 64 else chats(120)
    rows = [r for r in rows if r[0] is None or r[0] >= 0]
    df = spark.createDataFrame(rows, KIND).withColumns({c: F.lit(1) for c in ("node", "pos", "DEPTH", "n_", "part", "print")})
    assert found(prefix_trie.prefix_trie(spark, df.repartition(5), prefix_trie.twentieth, bits)) == plain(rows)


def test_trie_without_forks(spark):
    rows = chats(60)
    assert found(prefix_trie.prefix_trie(spark, spark.createDataFrame(rows, KIND))) == plain(rows, forked=False)
    same = [(c, t, "user", "x y") for c in range(50) for t in range(3)]
    assert found(prefix_trie.prefix_trie(spark, spark.createDataFrame(same, KIND))) == plain(same, forked=False)
    assert prefix_trie.prefix_trie(spark, spark.createDataFrame([], KIND)).count() == 0
    # Conversations of one turn that take over one turn of a base that is absent have none.
    few = [(c, 0, "user", "x") for c in range(21, 40)]
    assert found(prefix_trie.prefix_trie(spark, spark.createDataFrame(few, KIND), prefix_trie.twentieth)) == plain(few)


def test_hot_conversation_and_node(spark, monkeypatch):
    """One conversation over many ranges, and one first turn that most conversations share."""
    rows = [(40, t, "user", f"t{t % 7} w") for t in range(3000)] + [(c, t, "user", f"t{t % 7} w") for c in range(41, 600) for t in range(int(c % 5))]
    monkeypatch.setattr(_scratch, "LIGHT_ROWS", 32)
    monkeypatch.setattr(_scratch, "HEAVY_KEYS", 40)
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rows += [(601, t, "user", f"t{t % 7} w") for t in range(900)]
        df = spark.createDataFrame(rows, KIND)
        got = found(prefix_trie.prefix_trie(spark, df))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # All are prefixes of the longest: one node a depth, its members those who are at least as long.
    lengths = {40: 3000, 601: 900} | {c: c % 5 for c in range(41, 600) if c % 5}
    for conv, depth, parent, n, kids, leaves, saved, digest in got:
        assert conv == 40 and parent == (40 if depth else -1) and leaves == 1 and kids == (depth < 3000)
        assert n == sum(v >= depth for v in lengths.values())
        assert saved == sum(2 * (sum(v >= d for v in lengths.values()) - 1) for d in range(max(depth, 1), 3001))
        assert digest == hashlib.sha256(",".join(str(c) for c in sorted(lengths) if lengths[c] == depth).encode()).hexdigest()
    assert len(got) == 3001


def test_query_equals_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    got = prefix_trie.op13_prefix_trie(spark, folder)
    told = duckdb.connect()
    told.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    cursor = told.execute(oracle_sql()["op13_prefix_trie"])
    assert [d[0] for d in cursor.description] == got.columns
    assert found(got) == sorted(tuple(-1 if v is None else v for v in r) for r in cursor.fetchall())
