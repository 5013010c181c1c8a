from __future__ import annotations

import itertools
import random
import re
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.operators import clusters, retrieval, store, visibility
from lodestone.plans import queries


def test_delta(spark):
    findings = spark.createDataFrame(
        [(1, 0, "A1", "fail"), (1, 1, "A2", "pass"), (1, 2, "D1", "fail"), (1, 3, "N1", "na"), (2, 0, "A1", "warn"), (2, 1, "A1", "pass"), (2, 2, "A2", "fail"),
         (2, 3, "D1", "warn"), (2, 4, "G1", "fail"), (2, 5, "N1", "fail")],
        "audit_id long, ord int, check_id string, status string",
    )
    pairs = spark.createDataFrame([(2, 1)], "audit_id long, prior_id long")
    got = {r.check_id: r.change for r in store.delta(pairs, findings).collect()}
    assert got == {"A1": "resolved", "A2": "regressed", "D1": "persisting", "G1": "new", "N1": "regressed"}


def test_writes(spark):
    table = spark.createDataFrame([("a", "old", 1), ("b", "old", 2)], "k string, v string, n int")
    rows = spark.createDataFrame([("b", "new", 3), ("b", "newer", 4), ("c", "new", 5)], "k string, v string, n int")
    as_dict = lambda df: {r.k: r.v for r in df.collect()}
    assert as_dict(store.upsert(table, rows, "k", "n")) == {"a": "old", "b": "newer", "c": "new"}
    assert as_dict(store.insert_if_absent(table, rows, "k", "n")) == {"a": "old", "b": "old", "c": "new"}
    assert store.replace_children(table, rows, "k").count() == 4
    domains = spark.createDataFrame([("www.X.example",), ("y.example",), (None,)], "domain string")
    assert store.delete_domains(domains, ["x.example"]).count() == 2
    assert store.suppress(domains, spark.createDataFrame([("x.example",)], "domain string")).count() == 2


def test_links_and_quota(spark):
    checks = spark.createDataFrame([("u", 1, 1, "ok"), ("u", 2, 2, "broken"), ("u", 3, 3, "broken"), ("v", 1, 4, "broken")], "url string, checked_at int, check_id int, verdict string")
    assert [r.url for r in store.last_two_broken(checks).collect()] == ["u"]
    codes = spark.createDataFrame([(200,), (404,), (429,), (500,), (None,)], "c int").select(store.link_verdict(F.col("c"), F.lit(None).cast("string")).alias("v"))
    assert [r.v for r in codes.collect()] == ["ok", "broken", "blocked", "error", "error"]


def test_running_jobs(spark):
    jobs = spark.createDataFrame([(1, "full", 0, 10), (2, "full", 5, 15), (3, "full", 10, 20), (4, "light", 0, None)], "job_id long, profile string, started long, ended long")
    assert {r.job_id: r.running for r in store.running_jobs(jobs).collect()} == {1: 1, 2: 2, 3: 2, 4: 1}


def test_running_jobs_of_one_profile_spread(spark):
    """Against brute force across buckets, a null profile and equal moments included; one profile takes many tasks."""
    rng = random.Random(7)
    rows = [(k, rng.choice(["full", None]), t := rng.randrange(40) * 900, rng.choice([t + 900, t + 20_000, None])) for k in range(120)]
    jobs = spark.createDataFrame(rows, "job_id long, profile string, started long, ended long")
    edges = sorted([(t, 1, k, p) for k, p, t, _ in rows] + [(e, -1, k, p) for k, p, _, e in rows if e is not None])
    want = {k: sum(s for t2, s, j, q in edges if q == p and (t2, s, j) <= (t, 1, k)) for t, step, k, p in edges if step == 1}
    assert {r.job_id: r.running for r in store.running_jobs(jobs).collect()} == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        one = store.running_jobs(jobs.withColumn("profile", F.expr("substring(concat(job_id, 'x'), -1)"))).filter("running > 0")
        assert one.select(F.spark_partition_id().alias("task")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_tiers_and_trust(spark):
    names = ["developers of x", "Google", "www.moz.com", "unknown.example", None]
    rows = spark.createDataFrame([(n,) for n in names], "o string").select(retrieval.tier_of(F.col("o")).alias("t"), retrieval.tier_of(F.col("o"), True).alias("l")).collect()
    assert [(r.t, r.l) for r in rows] == [(5, 5), (1, 1), (5, 4), (5, 4), (5, 5)]
    rows = spark.createDataFrame([("a", "active", None), ("b", "Retired", None), ("c", None, "a"), ("d", None, "")], "id string, status string, superseded_by string")
    assert {r.id for r in retrieval.trusted(rows).collect()} == {"a", "d"}


def test_band_rank_prefers_relevance_then_tier(spark):
    cites = spark.createDataFrame(
        [("q", "rule", 1, 0.59, 5, 0.5, "", ""), ("q", "rule", 2, 0.51, 1, 0.5, "", ""), ("q", "rule", 3, 0.61, 5, 0.1, "", ""), ("q", "rule", 4, 0.2, 1, 1.0, "", "")],
        "query_id string, kind string, id int, relevance double, tier int, confidence double, source_url string, provenance string",
    )
    assert [r.id for r in retrieval.band_rank(cites, 5).orderBy("rank").collect()] == [3, 2, 1]


def test_supports_and_plausible(spark):
    row = spark.range(1).select(
        retrieval.supports(F.split(F.lit("a b c d"), " "), F.split(F.lit("a b c x y z"), " ")).alias("yes"),
        retrieval.supports(F.split(F.lit("a b"), " "), F.split(F.lit("a b"), " ")).alias("few"),
        retrieval.plausible(F.array().cast("array<string>"), F.split(F.lit("a"), " ")).alias("empty"),
    ).first()
    assert (row.yes, row.few, row.empty) == (True, False, True)


def test_bindings(spark):
    findings = spark.createDataFrame([("a", "D12_x", "warn"), ("a", "D4_x", "pass"), ("a", "A1_x", "fail")], "audit_id string, check_id string, status string")
    bindings = spark.createDataFrame([("D12", 0, "rule", "1", ["fail"]), ("D12", 1, "rule", "2", ["warn"]), ("A1", 0, "rule", "3", ["fail"])], "base string, bind_ord int, kind string, id string, statuses array<string>")
    corpus = spark.createDataFrame([("rule", "1", "active", None, "x", "verified", "t", "u"), ("rule", "2", "active", None, "x", "verified", "t", "u"), ("rule", "3", "active", None, "", "verified", "t", "u")],
        "kind string, id string, status string, superseded_by string, source_excerpt string, provenance_status string, title string, text1 string")
    assert [(r.check_id, r.id) for r in retrieval.bind_rules(findings, bindings, corpus).collect()] == [("D12_x", "2")]
    claims = spark.createDataFrame([("a", "c", "rule", "1", "alpha beta gamma"), ("a", "c", "rule", "9", "x")], "audit_id string, check_id string, kind string, id string, evidence string")
    pool = spark.createDataFrame([("c", "rule", "1")], "check_id string, kind string, id string")
    assert {r.id: r.reason for r in retrieval.binding_reasons(claims, corpus, pool).collect()} == {"1": "unsupported", "9": "missing"}


def test_all_bindings_count(spark):
    """The first of 12,000 bindings by order is the last row; broadcast or not, it is found."""
    findings = spark.createDataFrame([("a", "D1_x", "fail")], "audit_id string, check_id string, status string")
    bindings = spark.range(12_000).selectExpr("'D1' AS base", "cast(12000 - id AS int) AS bind_ord", "'rule' AS kind", "cast(id AS string) AS id", "array('fail') AS statuses")
    corpus = spark.range(12_000).selectExpr("'rule' AS kind", "cast(id AS string) AS id", "'active' AS status", "cast(NULL AS string) AS superseded_by", "'x' AS source_excerpt", "'verified' AS provenance_status")
    for bound in ({}, {"broadcast_rows": 20_000}):
        assert [r.id for r in retrieval.bind_rules(findings, bindings, corpus, **bound).collect()] == ["11999"]


def test_clusters(spark):
    names = ["alpha beta gamma delta", "alpha beta gamma delta", "alpha beta gamma epsilon", "other thing", "", None]
    rows = spark.createDataFrame([(k, "b", n) for k, n in enumerate(names)], "id long, block string, name string")
    pairs = clusters.candidate_pairs(rows, 0.6)
    assert sorted((r.a, r.b, r.jaccard) for r in pairs.collect()) == [(0, 1, 1.0), (0, 2, 0.6)]
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<double>")
    kept = clusters.veto(pairs, vectors)
    assert [(r.a, r.b) for r in kept.collect()] == [(0, 1)]
    roots = clusters.components(spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 51)], "a long, b long"))
    assert {(r.id, r.root) for r in roots.collect()} == {(k, 0) for k in range(31)} | {(50, 50), (51, 50)}


def test_pairs_see_whole_texts_and_null_blocks(spark, tmp_path):
    """Against brute force: copies that begin differently pair, texts that share only an opening don't, nor do blocks."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    opening = "permission is hereby granted free of charge to any person obtaining a copy "
    texts = [("en", opening + " ".join(rng.sample(words, 60))) for _ in range(6)]
    for lang in ("en", "de", None, None):
        base = rng.sample(words, 60)
        texts += [(lang, "other beginning here " + " ".join(base)), (lang, " ".join(base[4:] + rng.sample(words, 5))), (lang, " ".join(base[:30]))]
        texts += [(lang, " ".join(base)), (lang, " ".join(reversed(base)).upper())]
    rows = [(k, text, lang, "org") for k, (lang, text) in enumerate([*texts, ("en", None), (None, "")])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    bags = {k: (lang, frozenset(re.findall("[a-z0-9]+", text.lower())) - set(retrieval.STOP)) for k, (lang, text) in enumerate(texts)}
    least, want = {}, set()
    for k, bag in bags.items():
        first = least.setdefault(bag, k)
        if first < k:
            want.add((bag[0], first, k, 1.0))
    for (p, x), (q, y) in itertools.combinations(least, 2):
        if p == q and len(x & y) / len(x | y) >= clusters.JACCARD:
            want.add((p, *sorted((least[p, x], least[q, y])), round(len(x & y) / len(x | y), 6)))
    got = [(r.block, r.a, r.b, r.jaccard) for r in queries.QUERIES["jaccard_pairs"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert any(p is None for p, *_ in want) and not any(a < 6 and b < 6 for _, a, b, _ in want)


def test_pairs_across_chunks_and_sizes(spark, tmp_path, monkeypatch):
    """Sets of 1 to 600 tokens in chunks of a few rows, against brute force; the forest connects what all pairs do."""
    monkeypatch.setattr(clusters, "CHUNK", 64)
    monkeypatch.setattr(clusters, "CHUNK_BITS", 64)
    rng = random.Random(5)
    bags = []
    for k in range(260):
        near = rng.choice(bags) if k % 3 and bags else frozenset(f"t{rng.randrange(900)}" for _ in range(rng.choice([1, 2, 5, 30, 31, 60, 130, 600])))
        drop = rng.choice([0, 0, 0.1, 0.2, 0.3])
        bags.append(frozenset(t for t in near if rng.random() >= drop) or near)
    rows = spark.createDataFrame([(k, "b", " ".join(sorted(x))) for k, x in enumerate(bags)], "id long, block string, name string")
    least, want = {}, set()
    for k, bag in enumerate(bags):
        if least.setdefault(bag, k) < k:
            want.add((least[bag], k, 1.0))
    alike = lambda x, y: len(x & y) / len(x | y)
    want |= {(*sorted((least[x], least[y])), round(alike(x, y), 6)) for x, y in itertools.combinations(least, 2) if alike(x, y) >= clusters.JACCARD}
    got = [(r.a, r.b, r.jaccard) for r in clusters.candidate_pairs(rows).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    few = clusters.candidate_pairs(rows, forest=True)
    assert {(r.a, r.b) for r in few.collect()} <= {(a, b) for a, b, _ in want}
    roots = lambda pairs: {(r.id, r.root) for r in clusters.components(pairs).collect()}
    assert roots(few) == roots(clusters.candidate_pairs(rows))


def test_pairs_across_bands_of_sizes(spark, tmp_path, monkeypatch):
    """Cells of many pairs are cut by size, and a row that meets very many is counted in parts."""
    monkeypatch.setattr(clusters, "BAND_PAIRS", 1)
    monkeypatch.setattr(clusters, "PAIRS", 16)
    test_pairs_across_chunks_and_sizes(spark, tmp_path, monkeypatch)


def test_sets_meet_by_their_rarest_tokens(spark, monkeypatch):
    """Every pair of like sizes was compared, and each text cut into tokens twice by patterns."""
    texts = ["Ab-ab 9z", None, "", "!?", "x" * 255 + " " + "x" * 300 + " " + "x" * 299 + "y " + "X" * 300, "\u212aelvin \u0130zmir \u00c4rger na\u00efve", "the THE of", "a\u0301b c" * 3, "longerthan8 longerthan9 longertha", "12345678 123456789 1234567890123456 12345678901234567"]
    texts += ["".join(random.Random(k).choices("abAB09 .\u00e9\u65e5\u0130\n", k=400)) for k in range(40)]
    hashes, places = clusters._token_hashes(pa.array([None, *texts]).slice(1))
    names, seen = {}, []
    for text, lo, hi in zip(texts, places[:-1], places[1:], strict=True):
        tokens = re.findall("[a-z0-9]+", (text or "").lower())
        assert len(tokens) == hi - lo
        seen += [(names.setdefault(t, h) == h) for t, h in zip(tokens, hashes[lo:hi].tolist(), strict=True)]
    assert all(seen) and len(set(names.values())) == len(names)
    # The rarest tokens of a set of ten: the four that alike sets may lack, and those that they share at least.
    alike = pa.array([" ".join([f"common{j}" for j in range(9)] + [f"rare{k}"]) for k in range(50)])
    bags = list(clusters._bags(iter([pa.RecordBatch.from_arrays([pa.array(range(50)), pa.nulls(50, pa.string()), alike], ["id", "block", "name"])])))
    counts = np.zeros(clusters.COUNTERS, np.int64)
    for counted in clusters._counted(iter([b.select(["tokens"]) for b in bags])):
        counts[counted["counter"].to_numpy()] += counted["rows"].to_numpy()
    [sets] = clusters._prefixed(types.SimpleNamespace(value=counts), 0.6)(iter(bags))
    first = [int.from_bytes(x[:4], "little") for x in sets["prefix"].to_pylist()]
    assert len(set(first)) == 50 and {len(x) for x in sets["prefix"].to_pylist()} == {4 * (4 + clusters.OVERLAP)}
    # Sets that share frequent tokens only don't meet: nothing is compared pair by pair.
    words = [f"w{k}" for k in range(4)]
    rows = [(k, "b", " ".join(words + [f"u{k}x{j}" for j in range(40)])) for k in range(300)] + [(300, "b", " ".join(words + [f"u7x{j}" for j in range(2, 40)]))]
    df = spark.createDataFrame(rows, "id long, block string, name string")
    before, made = clusters.written, []
    monkeypatch.setattr(clusters, "written", lambda rows: made.append(before(rows)) or made[-1])
    assert [(r.a, r.b) for r in clusters.candidate_pairs(df).collect()] == [(7, 300)]
    assert [x.count() for x in made if x.columns == ["cell", "block", "a", "b"]] == [1] and any("prefix" in x.columns for x in made)


def test_plan_faults(spark):
    corpus = spark.createDataFrame([(1, "active", None), (2, "active", ""), (3, "Retired", None), (4, None, "1"), (5, "active", None), (6, "active", None)], "id long, status string, superseded_by string")
    plan = [(1, 1, True), (1, 2, False), (1, 3, False), (1, 4, False), (1, 5, False), (6, 6, True), (6, 5, False), (6, 1, False), (6, 9, False)]
    faults = clusters.plan_faults(spark.createDataFrame(plan, "root long, id long, canonical boolean"), corpus).collect()
    want = [("demoted and canonical", 1), ("demoted twice", 5), ("not citeable", 3), ("not citeable", 4), ("not in corpus", 9)]
    assert sorted((r.fault, r.id) for r in faults) == want


def test_retired_rows_are_not_elected(spark, tmp_path):
    """Of equal texts 7 is retired and would win by its date; it neither wins nor is demoted."""
    rows = [(k, "the very same words in every one of them", "en", "Google" if k == 7 else "org") for k in (7, 8, 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.id: r.canonical for r in queries.QUERIES["canonical_election"](spark, str(tmp_path)).collect()}
    assert set(got) == {8, 9} and sum(got.values()) == 1
    assert {r.status: r.n for r in queries.QUERIES["demoted_corpus"](spark, str(tmp_path)).collect()} == {"active": 1, "superseded": 1, "retired": 1}
    assert queries.QUERIES["demotion_plan_faults"](spark, str(tmp_path)).count() == 0


def test_visibility(spark):
    row = spark.range(1).select(
        visibility.cites_domain(F.array(F.lit("https://blog.x.example/a"), F.lit("https://y.example")), F.lit("x.example")).alias("cited"),
        visibility.cites_domain(F.array(F.lit("https://notx.example")), F.lit("x.example")).alias("other"),
        visibility.mentions(F.lit("Ask ACME about it"), F.lit("shop.example"), F.lit("Acme Inc")).alias("named"),
    ).first()
    assert (row.cited, row.other, row.named) == (True, False, True)


def test_bm25_shuffles_no_postings_by_term(spark):
    """All postings of a frequent term met in one task."""
    docs = spark.createDataFrame([(k, f"common word{k}") for k in range(9)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = retrieval.bm25(docs, docs.limit(2).withColumnRenamed("doc_id", "query_id"), 3, 0.0)
        assert "SortMergeJoin" not in found._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
