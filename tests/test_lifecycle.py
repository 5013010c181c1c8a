"""Redirect chains, guarded plans and job streams against plain loops."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.operators import demotions, joins, redirects
from lodestone.streaming import lifecycle

AT = dt.datetime(2026, 1, 1)
STORE = "spark.sql.streaming.stateStore.providerClass"


def followed(sends, url):
    """Hops and end of a chain; None for a loop."""
    n, seen = 0, set()
    while sends.get(url):
        if url in seen:
            return None
        seen.add(url)
        url, n = sends[url], n + 1
    return n, url


def test_redirects_of_a_random_graph(spark, monkeypatch):
    monkeypatch.setattr(joins, "LIGHT_ROWS", 20)
    monkeypatch.setattr(joins, "HEAVY_KEYS", 50)
    rng = random.Random(8)
    url = lambda k: f"http://h.example/{k}"
    sends = {url(k): url(rng.choice([0, k + 1, rng.randrange(700)])) if rng.random() < 0.8 else None for k in range(600)}
    sends |= {url(1000 + k): url(1001 + k) for k in range(70)}  # one long chain to a page without a response
    sends |= {url(2000): url(2000), url(2001): url(2002), url(2002): url(2003), url(2003): url(2001), url(2004): url(2002)}
    rows = [(u, 301 if t else 200, t) for u, t in sends.items()] + [(None, 301, url(1)), (url(3), 999, None), (url(3000), 302, None), (url(3001), 200, url(1)), ("HTTP://H.example/3002#x", 307, "/5?a#b")]
    got = {r.url: r for r in redirects.redirect_ends(spark.createDataFrame(rows, "url string, status int, location string")).collect()}
    assert len(got) == len(sends) + 3
    for u in sends:
        want = followed(sends, u)
        assert got[u].loop == (want is None), u
        assert (got[u].hops, got[u].final_url) == (want or (None, None)), u
    assert got[url(1000)].hops == 70 and got[url(1000)].final_status is None
    assert got[url(3000)].hops == 0 and got[url(3001)].final_url == url(3001)
    assert got["http://h.example/3002"].final_url == "http://h.example/5?a" and got["http://h.example/3002"].hops == 1


def test_canonical_verdicts(spark):
    """The rules of canonical links: none, empty, own, redirecting, redirecting back, endless, and another page."""
    page = "https://x.example/a/b?q=1#f"
    answers = [("https://x.example/go", 308, "/a/b?q=1"), ("https://x.example/away", 301, "https://y.example/"), ("https://x.example/r1", 302, "/r2"), ("https://x.example/r2", 302, "/r1"), ("https://x.example/ok", 200, None)]
    links = [(None, "warn"), (" ", "warn"), ("HTTPS://X.example/a/b?q=1", "pass"), ("b?q=1#z", "pass"), ("/a/b", "warn"), ("/go", "fail"), ("/away", "fail"), ("/r1", "fail"), ("/ok", "warn"), ("https://unknown.example/", "warn")]
    pages = spark.createDataFrame([(k, page, c) for k, (c, _) in enumerate(links)], "page_id int, served string, canonical string")
    got = {r.page_id: r for r in redirects.canonical_chains(pages, spark.createDataFrame(answers, "url string, status int, location string")).collect()}
    assert [got[k].status for k in range(len(links))] == [s for _, s in links]
    assert [k for k in got if got[k].back] == [5] and [k for k in got if got[k].loop] == [7]
    assert (got[6].hops, got[6].final_url, got[6].final_status) == (1, "https://y.example/", None)
    assert redirects.canonical_chains(pages.limit(0), spark.createDataFrame([], "url string, status int, location string")).count() == 0


CORPUS = "id long, block string, name string, rule_key string, status string, superseded_by string, version long"


def test_guarded_apply_and_reversal(spark, tmp_path):
    rows = [(1, "x", "a", None, "active", None, 0), (2, "x", "a", None, None, None, 0), (3, "x", "a", None, "active", None, 0), (4, "x", "a", None, "active", None, 0), (5, "x", "b", None, "active", None, 0)]
    table = demotions.Snapshots(spark, str(tmp_path / "t"))
    assert table.current() == -1 and table.commit(spark.createDataFrame(rows, CORPUS), -1) == 0
    chosen = spark.createDataFrame([(1, k, k == 1) for k in (1, 2, 3, 4)] + [(1, 9, False)], "root long, id long, canonical boolean")
    plan = demotions.demotions(chosen, table.read()).checkpoint()
    # Two others start from the same version: the first wins, the second has to look again.
    edited = table.read().withColumn("status", F.when(F.col("id") == 3, "retired").otherwise(F.col("status"))).withColumn("version", F.when(F.col("id") >= 3, 1).otherwise(F.col("version")))
    assert table.commit(edited, 0) == 1 and table.commit(table.read(0), 0) is None and table.current() == 1
    after, told = demotions.apply_guarded(table.read(), plan)
    # Row 4 has its status still, but another version; row 9 is gone.
    assert {r.id: r.outcome for r in told.collect()} == {2: "applied", 3: "drifted", 4: "drifted", 9: "missing"}
    assert table.commit(after, 1) == 2
    now = {r.id: (r.status, r.superseded_by, r.version) for r in table.read().collect()}
    assert now[2] == ("superseded", "1", 1) and now[3] == ("retired", None, 1) and now[4] == ("active", None, 1) and now[1] == ("active", None, 0)
    again, told = demotions.apply_guarded(table.read(), plan)
    assert "applied" not in {r.outcome for r in told.collect()} and again.exceptAll(table.read()).isEmpty()
    back = {r.id: (r.status, r.superseded_by) for r in demotions.revert_guarded(table.read(), plan).collect()}
    assert back[2] == (None, None) and back[3] == ("retired", None) and back[5] == ("active", None)
    moved = table.read().withColumn("superseded_by", F.when(F.col("id") == 2, "5"))
    assert {r.status for r in demotions.revert_guarded(moved, plan).filter("id = 2").collect()} == {"superseded"}
    with pytest.raises(ValueError):
        table.read(7)


def test_keyed_rows_are_never_matched_by_name(spark):
    name = "alpha beta gamma delta"
    rows = [(1, "x", name, "k"), (2, "x", "other thing", " k "), (3, "x", name, None), (4, "x", name, ""), (5, "x", name + " epsilon", None), (6, "y", "zeta eta theta", "k"), (7, "x", name, "solo"), (8, "x", "alpha beta gamma zeta", None)]
    df = spark.createDataFrame(rows, "id long, block string, name string, rule_key string")
    assert {(r.id, r.root, r.method) for r in demotions.clustered(df).collect()} == {(1, 1, "rule_key"), (2, 1, "rule_key"), *[(k, 3, "name_similarity") for k in (3, 4, 5, 8)]}
    # Vectors that differ speak against; where one is missing, names decide.
    vectors = spark.createDataFrame([(3, [1.0, 0.0]), (8, [0.0, 1.0]), (5, [1.0, 0.1])], "id long, embedding array<float>")
    assert {r.id for r in demotions.clustered(df, vectors).collect()} == {1, 2, 3, 4, 5}


def seconds(*pairs):
    return [(j, AT + dt.timedelta(seconds=s), status) for j, s, status in pairs]


def run_stream(spark, tmp_path, schema, make, batches):
    """Appends each batch's file, drains, and returns what is written so far after each."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "in"))
    seen = []
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            # A new query each time: it goes on from its checkpoint.
            df = make(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
            df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
            seen.append(sorted(map(tuple, spark.read.schema(df.schema).parquet(str(tmp_path / "out")).collect()), key=repr))
    finally:
        spark.conf.set(STORE, before)
    return seen


def test_job_states_over_restarts(spark, tmp_path):
    """Timers fire, late rows are dropped, order within and between batches doesn't matter, and a restart goes on."""
    tick = lambda s: ("z", s, "queued")
    batches = [
        seconds(("a", 10, "running"), ("a", 0, "queued"), ("b", 0, "queued"), ("c", 0, "queued"), tick(100)),
        seconds(("a", 90, "completed"), ("a", 90, "completed"), ("b", 95, "error"), ("b", 96, "completed"), tick(300)),
        seconds(("c", 5, "running"), ("c", 1190, "polled"), tick(1261)),
        seconds(("c", 1300, "completed"), ("d", 1250, "running"), ("d", 1240, "queued"), tick(2000)),
        seconds(tick(9000)),
    ]
    seen = run_stream(spark, tmp_path, "job_id string, ts timestamp, status string", lifecycle.job_states, batches)
    at = lambda s: AT + dt.timedelta(seconds=s)
    final = {(j, state, t) for j, state, t in seen[-1] if j != "z"}
    assert final == {
        ("a", "pending", at(0)), ("a", "running", at(10)), ("a", "complete", at(90)), ("b", "pending", at(0)), ("b", "failed", at(95)),
        # c's row of second 5 came after the watermark; its end came after it was given up.
        ("c", "pending", at(0)), ("c", "failed", at(1200)), ("d", "pending", at(1240)), ("d", "running", at(1250)), ("d", "failed", at(2440)),
    }
    assert ("a", "complete", at(90)) not in seen[0] and ("c", "failed", at(1200)) not in seen[1] and ("c", "failed", at(1200)) in seen[2]
    states = spark.createDataFrame(list(final), "job_id string, state string, at timestamp")
    asked = spark.createDataFrame([("a",), ("c",), ("old",), ("none",)], "job_id string")
    got = lifecycle.public_states(asked, states, spark.createDataFrame([("old",), ("a",)], "job_id string"))
    assert {r.job_id: r.state for r in got.collect()} == {"a": "complete", "c": "failed", "old": "complete", "none": "lost"}


def test_starts_and_checks_in_order_of_time(spark, tmp_path):
    schema = "target string, ts timestamp, job_id string, failed boolean"
    row = lambda t, s, j, failed=False: (t, AT + dt.timedelta(seconds=s), j, failed)
    batches = [[row("t", 30, "b"), row("t", 0, "a"), row("u", 0, "x", True)], [row("u", 5, "y"), row("t", 61, "c"), row("t", 60, "late b"), row("u", 64, "w")], [row("z", 400, "z")]]
    got = run_stream(spark, tmp_path / "s", schema, lifecycle.starts, batches)[-1]
    assert {j: a for t, j, a in got if t != "z"} == {"a": "a", "b": "a", "late b": "a", "c": "c", "x": "x", "y": "y", "w": "y"}
    schema = "url string, ts timestamp, check_id long, verdict string"
    row = lambda s, k, v: ("u", AT + dt.timedelta(seconds=s), k, v)
    batches = [[row(20, 2, "broken"), row(10, 1, "broken")], [row(40, 4, "broken"), row(30, 3, "ok"), row(50, 5, "broken")], [row(900, 9, "ok")]]
    assert run_stream(spark, tmp_path / "c", schema, lifecycle.broken_twice, batches)[-1] == [("u", 2), ("u", 5)]


def test_a_key_has_one_timer_however_many_rows_wait():
    """Each row's own timer, and each job's own state, cost a call: 6 million events took over 20 minutes."""
    calls = []

    class Value:
        now = None
        get = lambda self: self.now
        update = lambda self, v: setattr(self, "now", v)
        clear = lambda self: setattr(self, "now", None)

    class Rows:
        appendValue = lambda self, v: calls.append("append")

    class Handle:
        getListState = lambda self, *a: Rows()
        getValueState = lambda self, *a: Value()
        registerTimer = lambda self, m: calls.append(m)
        deleteTimer = lambda self, m: calls.append(-m)

    one = lifecycle.Starts()
    one.init(Handle())
    table = lambda *s: pd.DataFrame({"target": [f"t{x}" for x in s], "ts": pd.to_datetime(s, unit="s"), "job_id": "j", "failed": False})
    assert not [*one.handleInputRows((1,), iter([table(*range(20, 500))]), None)] and calls == ["append", 20_000]
    assert not [*one.handleInputRows((1,), iter([table(30, 40)]), None), *one.handleInputRows((1,), iter([table(9, 10)]), None)]
    assert calls == ["append", 20_000, "append", "append", -20_000, 9_000]


def test_starts_take_a_slot_at_once_and_moments_whole(monkeypatch):
    """A task held all rows of a target, a step of Python each, and a failed start of the anchor's moment answered itself."""
    monkeypatch.setattr(lifecycle.Starts, "step", lambda *a: pytest.fail("a step a row"))

    class State:
        def __init__(self):
            self.rows, self.now = [], None

        appendValue = lambda self, v: self.rows.append(v)
        get = lambda self: iter(self.rows) if self.now is None and self.rows else self.now or (None if self.kind == "value" else iter(()))
        update = lambda self, v: setattr(self, "now", v)

        def clear(self):
            self.rows, self.now = [], None

    class Handle:
        def make(self, kind):
            state = State()
            state.kind = kind
            return state

        getListState = lambda self, *a: self.make("list")
        getValueState = lambda self, *a: self.make("value")
        registerTimer = deleteTimer = lambda self, m: None

    class Times:
        def __init__(self, seconds):
            self.getCurrentWatermarkInMs = lambda: seconds * 1000

    rng = random.Random(7)
    day = 86_400
    rows = [(rng.choice("tuv"), rng.randrange(3 * day) // 7 * 7, f"j{k}", rng.random() < 0.3) for k in range(9_000)] + [("w", 50, "a", True), ("w", 50, "b", False), ("w", day - 1, "c", False), ("w", day + 58, "d", False), ("w", day + 60, "e", True), ("w", 9 * day, None, None)]
    one, sizes = lifecycle.Starts(), []
    one.init(Handle())
    answered = one._answered
    one._answered = lambda table, held: (sizes.append(len(table)), answered(table, held))[1]
    rng.shuffle(rows)
    table = pd.DataFrame(rows, columns=["target", "s", "job_id", "failed"])
    table["ts"] = pd.to_datetime(table["s"], unit="s")
    assert not [*one.handleInputRows((1,), iter([table[:4_000], table[4_000:]]), None)]
    got = pd.concat([*one.handleExpiredTimer((1,), Times(2 * day - 40_000), None), *one.handleExpiredTimer((1,), Times(8 * day), None)])
    want, last, moments = {}, {}, {}
    for target, s, j, failed in rows:
        moments.setdefault((target, s), []).append((j, failed))
    for target, s in sorted(k for k in moments if k[1] <= 8 * day):
        now = moments[target, s]
        if not (target in last and s <= last[target][0] + 60) and not all(failed for _, failed in now):
            last[target] = (s, min(j for j, failed in now if not failed))
        open_now = target in last and s <= last[target][0] + 60
        want |= {j: last[target][1] if open_now else j for j, _ in now}
    assert dict(zip(got["job_id"], got["answered_by"])) == want and len(got) == len(want)
    assert {j: want[j] for j in "abcde"} == {"a": "b", "b": "b", "c": "c", "d": "c", "e": "e"}
    assert len(sizes) == 4 and max(sizes) < 3_500


def test_share_of_voice_gives_out_finished_windows_only(spark, tmp_path):
    schema = "run_id long, ts timestamp, domain string"
    day = lambda n: AT + dt.timedelta(days=n)
    batches = [[(1, day(0), "a"), (1, day(0), "a"), (1, day(0), "b"), (2, day(1), "a"), (3, day(1), None)], [(4, day(3), "b")], [(5, day(30), "a")]]
    make = lambda rows: lifecycle.rolling_citations(rows, "2 days", "1 day", "1 day")
    counts = run_stream(spark, tmp_path, schema, make, batches[:1])[0]
    assert {r[0] for r in counts} <= {AT - dt.timedelta(days=1)}
    counts = run_stream(spark, tmp_path / "all", schema, make, batches)[-1]
    got = {(r.start, r.domain): (r.n, r.share) for r in lifecycle.shares_of_voice(spark.createDataFrame(counts, "start timestamp, domain string, n long")).collect()}
    assert got[day(0), "a"] == (2, 66.6667) and got[day(0), "b"] == (1, 33.3333) and got[day(2), "b"] == (1, 100.0) and (day(30), "a") not in got


def test_progress(spark):
    cases = [("completed", 0, 0, None, None, 100), ("error", 9, 9, None, 50, 0), (None, 9, 9, None, None, 2), ("running", 0, 0, None, None, 5), ("running", 15, 10, None, None, 47), ("running", 40, 0, None, None, 95), ("running", 0, 180, None, None, 45), ("running", 0, 44, 45, None, 88), ("running", 0, 9999, None, 97.9, 97), ("running", None, None, None, 250.0, 99)]
    rows = [(s, t, None if e is None else float(e), x, None if h is None else float(h), w) for s, t, e, x, h, w in cases]
    df = spark.createDataFrame(rows, "status string, tools int, elapsed double, expected int, hint double, want int")
    got = df.select(lifecycle.progress(*[F.col(c) for c in ("status", "tools", "elapsed", "expected", "hint")]).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
