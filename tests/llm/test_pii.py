"""Personal data: base spans against Python's patterns, added spans against planted ones."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                found.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(found)]


TEXTS = [
    None, "", "a@b.c", "é😀 mail jo.e+x%y-z@m-1.example.com, ok", "a@b.c_d@e.f@g.h x@y", "@a.b c@d. e@f..g %%@--.-", "1.2.3.4.5.6.7.8 and 256.1.1.1 001.02.3.0255 1.2.3 0.0.0.0",
    "4111 1111 1111 1111 and 4111111111111111 4111-1111-1111-1111-1 4111 1111 1111 1112", "+1 (377) 555-0271 190.137.223.204", "+49 (0)30.1234-5678) +123 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 ++12345678901",
    "4111 1111 1111 1111 5500 0000 0000 0004", "\u0001 x@y.z \u0001\u0002 4012888888881881", "1 2 3 4", "5555  5555 5555 4444 5105-105 1051 05100", "tel+4917612345678x", "9" * 5000, "a." * 5000 + "@b.c",
    ("x" * 6_000) + " z@z.zz " + "1" * 20_000 + " +1 5550100200", "+1" + " " * 4000 + "234567890 1", "é" * 70 + "10.20.30.40", "4242424242424242@1.2.3.4",
]


def test_base_spans_equal_plain_patterns(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "q@r.st")], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("x") for c in ("kind", "Row", "start", "nth_row", "hit", "LEFT")})
    got = pii.span_digests(spark, docs).collect()
    assert len(got) == len(TEXTS) + 2 and sum(r.doc_id == 3 for r in got) == 2
    for r in got:
        text = "q@r.st" if r.doc_id is None else TEXTS[r.doc_id]
        base = base_spans(text)
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), r.doc_id
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in base) for k in pii.KINDS]
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if s in base] == base and len(spans) == len(base) + r.n_added
    spans = pii.find_personal_data(spark, docs)
    assert {"Row", "nth_row"} < set(spans.columns)
    for r in spans.filter("doc_id IS NOT NULL AND doc_id <> 11").collect():
        assert TEXTS[r.doc_id][r.start : r.stop] == r.hit
    assert pii.span_digests(spark, docs.limit(0)).count() == 0 and pii.find_personal_data(spark, docs.limit(0)).count() == 0
    # Nothing but base spans: nothing to judge.
    assert pii.span_digests(spark, spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string")).first().spans == "email:0:5"


def test_added_spans(spark):
    """Disguised and national forms are found among base spans; numbers of other things are left alone."""
    base = [(k, f"see w{k}.x@mail{k % 7}.example.com or +1 (21{k % 10}) 555-01{k % 90 + 10} from 8.{k % 250}.4.{k % 200 + 1} visa 4111 1111 1111 1111") for k in range(300)]
    number = lambda k: str(4000_0000_0000_0000 + k * 7_654_321_987)
    other = [(1000 + k, f"order no {number(k)} version 4.300.{k}.2 build 2{k % 10}0.{k % 900 + 100}.{k % 900 + 100}") for k in range(300) if not luhn(number(k))]
    planted = {
        2000: ("mail me: joe.doe [at] example [dot] com please", "joe.doe [at] example [dot] com"), 2001: ("contact jane(at)mail.example.org.", "jane(at)mail.example.org"),
        2002: ("phone (212) 555-0147 after six", "(212) 555-0147"), 2003: ("call 0049 30 1234 5678 now", "0049 30 1234 5678"), 2004: ("card 4111.1111.1111.1111 is blocked", "4111.1111.1111.1111"),
    }
    docs = spark.createDataFrame(base + other + [(k, t) for k, (t, _) in planted.items()], "doc_id long, text string")
    added = pii.find_personal_data(spark, docs).filter("NOT is_base").collect()
    hits = {r.doc_id: r.hit for r in added}
    assert {k: hits.get(k) for k in planted} == {k: h for k, (_, h) in planted.items()}
    assert not [r for r in added if r.doc_id < 2000]


def test_reliabilities_follow_the_votes(spark):
    """Labelers of known reliability: the estimate comes near it, whatever the first guess."""
    import random

    rng = random.Random(4)
    rows = []
    for k in range(6000):
        personal = rng.random() < 0.6
        votes = {j: -1 for j in pii.LABELERS}
        votes["check"] = int((rng.random() < 0.9) == personal)
        votes["gazetteer"] = int((rng.random() < 0.8) == personal)
        votes["words_for"] = 1 if rng.random() < (0.6 if personal else 0.1) else -1
        votes["bounds"] = 0 if rng.random() < (0.05 if personal else 0.5) else -1
        rows.append(("phone", personal and rng.random() < 0.5, *votes.values()))
    df = spark.createDataFrame(rows, "kind string, is_base boolean, " + ", ".join(f"{j} int" for j in pii.LABELERS))
    found = pii.estimate(df.groupBy(*df.columns).agg(F.count("*").alias("n")), rounds=40)
    assert found.tables["phone", "check", 1][1] == pytest.approx(0.9, abs=0.05) and found.tables["phone", "check", 0][0] == pytest.approx(0.9, abs=0.07)
    assert found.tables["phone", "gazetteer", 1][1] == pytest.approx(0.8, abs=0.05) and found.tables["phone", "bounds", 0][0] == pytest.approx(0.5, abs=0.07)
    assert found.share["phone"] == pytest.approx(3 / 7, abs=0.06)


def test_documents_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = pii.op11_pii(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(texts) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got) > 20
    for r in got:
        assert r.base_sha256 == hashlib.sha256(",".join(base_spans(texts[r.doc_id])).encode()).hexdigest(), r.doc_id
