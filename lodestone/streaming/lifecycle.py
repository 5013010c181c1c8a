"""Job streams that don't depend on batches: rows are held until the watermark passes them and then taken in order of time.

State goes away by event-time timers, so that a key that is done, or silent for long, costs nothing.  A batch rewrites
the states of the buckets that it touches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds in which a start of the same target is the same job; seconds after which a running job is given up.
SAME_JOB, GIVEN_UP = 60, 1_200
#: Seconds that an ended job is remembered, so that what arrives later changes nothing.
REMEMBERED = 3_600
#: Groups that keys are dealt into; those of one group share state and a timer.
BUCKETS = 1_024
#: Public names of the states.
PUBLIC = {"queued": "pending", "running": "running", "completed": "complete", "error": "failed"}


class InOrder(StatefulProcessor):
    """Holds rows of keys, (micros, ...), and hands those that the watermark has passed to ``step``, a key's rows in order.

    Keys are grouped into BUCKETS by a hash, so that state and timers are asked once for many keys.  A bucket's waiting
    rows are texts of many rows, its held states are one text, and one timer stands for whatever is due first.
    """

    #: Column of the key; columns of a row after its time.
    KEY = ""
    ROW: list[str] = []
    OUT: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows string")
        self.held = handle.getValueState("held", "states string")
        self.timer = handle.getValueState("timer", "millis long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for table in rows:
            micros = table["ts"].astype("int64") // {"datetime64[ns]": 1000}.get(str(table["ts"].dtype).split(",")[0].rstrip("]") + "]", 1)
            new = list(zip(table[self.KEY].tolist(), micros.tolist(), *[table[c].tolist() for c in self.ROW]))
            if new:
                self.waiting.appendValue((json.dumps(new),))
                first = min(first or (1 << 62), min(x[1] for x in new))
        if first is not None:
            self._wake(self._millis(first))
        yield from ()

    def _wake(self, millis: int) -> None:
        """Sets the bucket's timer, unless it is set for earlier."""
        before = self.timer.get()
        if before is not None and before[0] <= millis:
            return
        if before is not None:
            self.handle.deleteTimer(before[0])
        self.handle.registerTimer(millis)
        self.timer.update((millis,))

    @staticmethod
    def _ordered(rows: list[tuple]) -> list[tuple]:
        try:
            return sorted(rows)
        except TypeError:  # nulls come first
            return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))

    @staticmethod
    def _millis(micros: int) -> int:
        return -(-micros // 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        ready: dict[Any, list[tuple]] = {}
        later: list[list] = []
        for (text,) in self.waiting.get():
            for name, *row in json.loads(text):
                ready.setdefault(name, []).append(tuple(row)) if row[0] <= now else later.append([name, *row])
        before = self.held.get()
        held = {name: tuple(state) for name, *state in json.loads(before[0])} if before is not None else {}
        self.waiting.clear()
        if later:
            self.waiting.put([(json.dumps(later[k : k + 10_000]),) for k in range(0, len(later), 10_000)])
        out: list[tuple] = []
        for name in list(held | ready):
            state = held.pop(name, None)
            for row in self._ordered(ready.pop(name, [])):
                state = self.step((name,), self.passed((name,), state, row[0], out), row, out)
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=self.OUT)
                    out = []
            state = self.passed((name,), state, now, out)
            if state is not None:
                held[name] = state
        if held:
            self.held.update((json.dumps([[name, *state] for name, state in held.items()]),))
        elif before is not None:
            self.held.clear()
        due = [d for state in held.values() if (d := self.due(state)) is not None] + [row[1] for row in later]
        self.timer.clear()
        if due:
            self._wake(max(self._millis(min(due)), now // 1000 + 1))
        if out:
            yield pd.DataFrame(out, columns=self.OUT)

    def step(self, key: Any, held: tuple | None, row: tuple, out: list[tuple]) -> tuple | None:
        """The state after a row; appends results to ``out``."""
        raise NotImplementedError

    def due(self, held: tuple) -> int | None:
        """When, in microseconds, something happens to this state by itself."""
        return None

    def passed(self, key: Any, held: tuple | None, now: int, out: list[tuple]) -> tuple | None:
        """The state once it is ``now``; what was due before has happened."""
        return held

    def close(self) -> None:
        pass


class Starts(InOrder):
    """A start within SAME_JOB seconds of one that counts gets that one's job; failed jobs don't count.

    Starts of one moment are alike: the one that counts, the smallest job of those that don't fail, answers all of them.
    Rows wait as Arrow tables of one SLOT of time, and a slot is taken at once: few targets may hold all rows, so no row
    costs a step of Python, and a task holds no more of them than a slot's.
    """

    KEY, ROW = "target", ["job_id", "failed"]
    OUT = ["target", "job_id", "answered_by"]
    #: Microseconds of a slot, lists that slots are dealt into in turn, and rows that are kept together at most before they are stored.
    SLOT, LISTS, TOGETHER = 24 * 3_600_000_000, 16, 200_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = [handle.getListState(f"waiting{k}", "rows binary") for k in range(self.LISTS)]
        #: The first moment of each slot that has rows.
        self.slots = handle.getValueState("slots", "firsts string")
        self.held = handle.getValueState("held", "states string")
        self.timer = handle.getValueState("timer", "millis long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        firsts, tables = {}, []
        for table in rows:
            micros = table["ts"].astype("int64") // {"datetime64[ns]": 1000}.get(str(table["ts"].dtype).split(",")[0].rstrip("]") + "]", 1)
            columns = [table[self.KEY], micros, table["job_id"], table["failed"]]
            tables.append(pa.table([pa.array(c, t, from_pandas=True) for c, t in zip(columns, ("string", "int64", "string", "bool"), strict=True)], self.NAMES))
            if sum(map(len, tables)) >= self.TOGETHER:
                self._store(pa.concat_tables(tables), firsts)
                tables = []
        if tables:
            self._store(pa.concat_tables(tables), firsts)
        if firsts:
            self._keep(self._firsts(), firsts)
            self._wake(self._millis(min(firsts.values())))
        yield from ()

    NAMES = ["target", "at", "job", "failed"]

    def _firsts(self) -> dict[int, int]:
        before = self.slots.get()
        return dict(json.loads(before[0])) if before is not None else {}

    def _keep(self, before: dict[int, int], firsts: dict[int, int]) -> None:
        both = {slot: min(m for m in (before.get(slot), firsts.get(slot)) if m is not None) for slot in before | firsts}
        self.slots.update((json.dumps(sorted(both.items())),))

    def _store(self, table: pa.Table, firsts: dict[int, int]) -> None:
        """Appends rows to the lists of their slots; ``firsts`` takes note of the slots."""
        at = table["at"].to_numpy()
        slot = at // self.SLOT
        order = np.argsort(slot, kind="stable")
        cuts = np.flatnonzero(np.diff(slot[order])) + 1
        for places in np.split(order, cuts) if len(order) else []:
            one, part = int(slot[places[0]]), table.take(pa.array(places)).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as stream:
                stream.write_table(part)
            self.waiting[one % self.LISTS].appendValue((sink.getvalue().to_pybytes(),))
            firsts[one] = min(firsts.get(one, 1 << 62), int(at[places].min()))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        before = self.held.get()
        held = {name: tuple(state) for name, *state in json.loads(before[0])} if before is not None else {}
        firsts = self._firsts()
        for slot in sorted(s for s, first in firsts.items() if first <= now):
            waiting = self.waiting[slot % self.LISTS]
            ready, later = [], []
            for (blob,) in waiting.get():
                table = pa.ipc.open_stream(pa.py_buffer(bytes(blob))).read_all()
                at = table["at"].to_numpy()
                due = (at // self.SLOT == slot) & (at <= now)
                ready.append(table.filter(pa.array(due)))
                if not due.all():
                    later.append(table.filter(pa.array(~due)))
            waiting.clear()
            del firsts[slot]
            left: dict[int, int] = {}
            for k in range(0, len(later), 16):
                self._store(pa.concat_tables(later[k : k + 16]), left)
            if slot in left:
                firsts[slot] = left[slot]
            yield from self._answered(pa.concat_tables(ready), held)
        held = {name: state for name, state in held.items() if now < self.due(state)}
        if held:
            self.held.update((json.dumps([[name, *state] for name, state in held.items()]),))
        elif before is not None:
            self.held.clear()
        self.slots.clear()
        if firsts:
            self._keep(firsts, {})
        due = [self.due(state) for state in held.values()] + list(firsts.values())
        self.timer.clear()
        if due:
            self._wake(max(self._millis(min(due)), now // 1000 + 1))

    def _answered(self, table: pa.Table, held: dict[Any, tuple]) -> Iterator[pd.DataFrame]:
        """Answers of a slot's rows; ``held``, the last start that counts of each target, goes on with them."""
        names = table["target"].combine_chunks().dictionary_encode()
        code = names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        at = table["at"].to_numpy()
        order = np.lexsort((at, code))
        code, at = code[order], at[order]
        jobs = table["job"].to_numpy()[order]
        counts = ~table["failed"].combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)[order]
        answers = jobs.copy()
        span = SAME_JOB * 1_000_000
        cuts = np.append(0, np.flatnonzero(np.diff(code)) + 1)
        for lo, hi in zip(cuts, np.append(cuts[1:], len(code)), strict=True) if len(code) else []:
            name = names.dictionary[int(code[lo])].as_py() if code[lo] >= 0 else None
            able = lo + np.flatnonzero(counts[lo:hi])
            when = at[able]
            moments, first_jobs = ([held[name][1]], [held[name][0]]) if name in held else ([], [])
            k = int(np.searchsorted(when, moments[0] + span, "right")) if moments else 0
            while k < len(able):
                moment = int(when[k])
                same = jobs[able[k : int(np.searchsorted(when, moment, "right"))]]
                moments.append(moment), first_jobs.append(min(same, key=lambda j: (j is not None, j)))
                k = int(np.searchsorted(when, moment + span, "right"))
            if moments:
                held[name] = (first_jobs[-1], moments[-1])
                last = np.searchsorted(np.array(moments), at[lo:hi], "right") - 1
                within = np.flatnonzero((last >= 0) & (at[lo:hi] <= np.array(moments)[last] + span))
                answers[lo + within] = np.array(first_jobs, object)[last[within]]
        targets = np.append(names.dictionary.to_numpy(zero_copy_only=False), None)[code]
        for k in range(0, len(code), 100_000):
            yield pd.DataFrame(dict(zip(self.OUT, (targets[k : k + 100_000], jobs[k : k + 100_000], answers[k : k + 100_000]), strict=True)))

    def due(self, held: tuple) -> int:
        return held[1] + SAME_JOB * 1_000_000 + 1


class Lifecycle(InOrder):
    """Public states of a job as they change; one that doesn't end within GIVEN_UP seconds of its first event has failed."""

    KEY, ROW = "job_id", ["status"]
    OUT = ["job_id", "state", "at"]

    def step(self, key: Any, held: tuple | None, row: tuple, out: list[tuple]) -> tuple | None:
        micros, status = row
        rank = {"queued": 0, "running": 1, "completed": 2, "error": 2}.get(status)
        # An ended job stays as it is, and no job goes back.
        if rank is None or (held and (held[2] is not None or rank <= (0 if held[0] == "queued" else 1))):
            return held
        out.append((key[0], PUBLIC[status], self._time(micros)))
        return (status, held[1] if held else micros, micros if rank == 2 else None)

    @staticmethod
    def _time(micros: int) -> pd.Timestamp:
        return pd.Timestamp(micros, unit="us")

    def due(self, held: tuple) -> int:
        return held[1] + GIVEN_UP * 1_000_000 + 1 if held[2] is None else held[2] + REMEMBERED * 1_000_000

    def passed(self, key: Any, held: tuple | None, now: int, out: list[tuple]) -> tuple | None:
        if held and held[2] is None and now >= self.due(held):
            ended = self.due(held) - 1
            out.append((key[0], PUBLIC["error"], self._time(ended)))
            held = ("error", held[1], ended)
        return None if held and held[2] is not None and now >= self.due(held) else held


class LastTwo(InOrder):
    """Checks of a URL that are the second broken one in a row."""

    KEY, ROW = "url", ["check_id", "verdict"]
    OUT = ["url", "check_id"]
    #: Seconds after which a URL without checks is forgotten.
    SILENT = 90 * 86_400

    def step(self, key: Any, held: tuple | None, row: tuple, out: list[tuple]) -> tuple | None:
        micros, check, verdict = row
        if verdict == "broken" and held and held[0] == "broken":
            out.append((key[0], check))
        return (verdict, micros)

    def due(self, held: tuple) -> int:
        return held[1] + self.SILENT * 1_000_000

    def passed(self, key: Any, held: tuple | None, now: int, out: list[tuple]) -> tuple | None:
        return None if held and now >= self.due(held) else held


def _run(rows: DataFrame, processor: InOrder, schema: str) -> DataFrame:
    bucket = F.pmod(F.xxhash64(processor.KEY), F.lit(BUCKETS)).alias("bucket")
    wanted = rows.select(bucket, processor.KEY, "ts", *processor.ROW)
    return wanted.groupBy("bucket").transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def _timed(rows: DataFrame, late: str) -> DataFrame:
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def starts(requests: DataFrame, late: str = "1 minute") -> DataFrame:
    """``target, job_id, answered_by`` of every request (target, job_id, ts, failed) once the watermark has passed it."""
    return _run(_timed(requests, late), Starts(), "target string, job_id string, answered_by string")


def job_states(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """``job_id, state, at`` whenever a job's public state changes (job_id, ts, status); repeated events count once.

    ``at`` is the time of the event, or when the job was given up.  Events later than the watermark are dropped.
    """
    once = _timed(events, late).dropDuplicatesWithinWatermark(["job_id", "status", "ts"])
    return _run(once, Lifecycle(), "job_id string, state string, at timestamp")


def broken_twice(checks: DataFrame, late: str = "1 minute") -> DataFrame:
    """``url, check_id`` of every check (url, ts, check_id, verdict) that is the second broken one in a row."""
    return _run(_timed(checks, late), LastTwo(), "url string, check_id long")


def public_states(asked: DataFrame, states: DataFrame, stored: DataFrame) -> DataFrame:
    """``job_id, state`` for every job asked for (job_id): its last state (job_id, state, at), complete if only the store has it, else lost."""
    rank = F.element_at(F.create_map(*[F.lit(x) for pair in (("pending", 0), ("running", 1), ("complete", 2), ("failed", 2)) for x in pair]), F.col("state"))
    last = states.groupBy("job_id").agg(F.max(F.struct("at", rank.alias("rank"), "state")).alias("last"))
    rows = asked.join(last, "job_id", "left").join(stored.select("job_id", F.lit(True).alias("kept")).distinct(), "job_id", "left")
    return rows.select("job_id", F.coalesce("last.state", F.when(F.col("kept"), "complete").otherwise("lost")).alias("state"))


def progress(status: Column, tool_count: Column, elapsed_s: Column, expected_s: Column, hint: Column) -> Column:
    """Progress in percent: 100 when completed, 0 in error, 2 in the queue; otherwise the furthest of tools, time and hint within 5 and 99.

    Fixed values: 30 tools make 95 percent, the expected time 90; full audits take 360 seconds where nothing else is expected.
    """
    tools = F.least(F.lit(95), F.floor(F.coalesce(tool_count, F.lit(0)) / 30 * 95))
    expected = F.greatest(F.lit(1), F.when(F.coalesce(expected_s, F.lit(0)) == 0, 360).otherwise(expected_s))
    time = F.floor(F.least(F.lit(90.0), elapsed_s / expected * 90))
    # int() cuts towards zero.
    far = F.greatest(tools, F.coalesce(time, F.lit(0)), F.coalesce(hint.cast("long"), F.lit(0)))
    running = F.greatest(F.lit(5), F.least(F.lit(99), far))
    return F.when(status == "completed", 100).when(status == "error", 0).when(F.coalesce(status, F.lit("queued")) == "queued", 2).otherwise(running).cast("int")


def rolling_citations(runs: DataFrame, size: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """``start, domain, n``: in how many runs (run_id, ts, domain) of each window a domain is cited; the null domain counts all runs.

    A run's repeated citations count once while the watermark remembers them; ``ts`` is the time of the run.  In append
    mode a window is given out once, when the watermark has passed its end.
    """
    rows = runs.select("run_id", "ts", F.explode(F.array(F.coalesce("domain", F.lit("")), F.lit(None).cast("string"))).alias("domain")).filter("domain IS NULL OR domain <> ''")
    once = _timed(rows, late).dropDuplicatesWithinWatermark(["run_id", "domain", "ts"])
    counts = once.groupBy(F.window("ts", size, slide), "domain").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), "domain", "n")


def shares_of_voice(counts: DataFrame) -> DataFrame:
    """``start, domain, n, share``: of finished windows, the percentage of runs that cite a domain."""
    total = counts.filter("domain IS NULL").select("start", F.col("n").alias("runs"))
    return counts.filter("domain IS NOT NULL").join(total, "start").select("start", "domain", "n", F.round(F.col("n") * 100.0 / F.col("runs"), 4).alias("share"))
