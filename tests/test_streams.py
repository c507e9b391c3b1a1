"""Streams whose state is bounded, and life cycles, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from notegrove.operators import folds, memory
from notegrove.streaming import lifecycles, notes

SECOND = 1_000_000
LOG = "job long, ts timestamp, event_id long, action string"


def at(seconds):
    return F.timestamp_seconds(F.lit(seconds))


def log(spark, rows):
    return spark.createDataFrame([(j, s, i, a) for i, (j, s, a) in enumerate(rows)], "job long, s double, event_id long, action string").select("job", F.timestamp_seconds("s").alias("ts"), "event_id", "action")


def life(rows, wait, lease, keep, until):
    """The rules of retries, one event after the other."""
    out, states = [], {}
    p = lifecycles.Retries(wait, lease, keep)
    for _, us, j, a in sorted((us, us, j, a) for us, j, a in rows):
        got: list = []
        states[j] = p.act(p.lapse(states.get(j, ("pending", 0, 0)), us, got), us, a, got)
        out += [(j, *x) for x in got]
    for j, s in states.items():
        got = []
        p.lapse(s, until, got)
        out += [(j, *x) for x in got]
    return sorted(out)


def test_rules_of_retries():
    """Parked by the third failure; not before it is due; an orphan is due at once; what has ended is forgotten."""
    s = SECOND
    rows = [(0, 1, "start"), (1 * s, 1, "fail"), (2 * s, 1, "start"), (11 * s, 1, "start"), (12 * s, 1, "fail"), (40 * s, 1, "start"), (41 * s, 1, "fail"), (50 * s, 1, "start"), (0, 2, "start"), (500 * s, 2, "complete"), (501 * s, 2, "start"), (502 * s, 2, "complete"), (503 * s, 2, "start"), (5000 * s, 2, "start")]
    got = life(rows, 10 * s, 100 * s, 1000 * s, 10**12)
    assert [x[1:] for x in got if x[0] == 1] == [(0, "running", 1), (s, "waiting", 1), (11 * s, "due", 1), (11 * s, "running", 2), (12 * s, "waiting", 2), (32 * s, "due", 2), (40 * s, "running", 3), (41 * s, "failed", 3)]
    assert [x[1:] for x in got if x[0] == 2] == [(0, "running", 1), (100 * s, "orphaned", 1), (501 * s, "running", 2), (502 * s, "completed", 2), (5000 * s, "running", 1), (5100 * s, "orphaned", 1)]


def test_retries_however_events_arrive(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(8) if rng.random() < 0.6 else 0, 1000 + rng.randrange(20_000), rng.choice(["start", "start", "fail", "fail", "complete", "recover", "other"])) for _ in range(500)]
    rows = sorted({(s, j): (j, float(s), a) for j, s, a in rows}.values(), key=lambda r: r[1])
    times = {"wait": 300 * SECOND, "lease": 900 * SECOND, "keep": 4000 * SECOND}
    until = int((max(r[1] for r in rows) - 60) * SECOND)
    want = life([(int(s * SECOND), j, a) for j, s, a in rows], *times.values(), until)
    for parts in (1, 4):
        runs = notes.Runs(notes.arrivals(log(spark, rows), "ts", parts), lambda e: lifecycles.retried(e, "1 minute", **times))
        assert sorted((r.job, r.at_us, r.what, r.attempts) for r in runs.out.collect()) == want


def test_state_is_of_what_is_open(spark):
    """Of 2,000 jobs and bursts one after the other few are held at any time; late rows are dropped and counted."""
    rows = [(i, 1000 + 100.0 * i + d, a) for i in range(2000) for d, a in ((0, "start"), (5, "complete"))]
    parts = notes.arrivals(log(spark, rows), "ts", 4)
    jobs = notes.Runs(parts, lambda e: lifecycles.retried(e, "10 seconds", wait=SECOND, lease=60 * SECOND, keep=600 * SECOND))
    assert jobs.out.count() == 4000 and max(jobs.held()) < 60  # a row for the state and its timer
    events = [p.select(F.col("job").alias("user_id"), "ts", "event_id") for p in parts]
    late = events[0].limit(1).select("user_id", at(0).alias("ts"), F.lit(10**9).alias("event_id"))
    bursts = notes.Runs([*events, late], lambda e: notes.debounced(e, "1 minute", "2 minutes"))
    assert max(bursts.held()) < 20 and bursts.out.count() >= 1990
    assert sum(int(o.numRowsDroppedByWatermark) for o in bursts.progress[-1].stateOperators) == 1 and bursts.out.where("last_event = 1000000000").count() == 0


def test_states_by_batches_equal_one_fold(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(6)}", i, i, rng.choice([*memory.MEMORY.to, "none"])) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, ts long, event_id long, action string")
    pick = lambda x: sorted(map(tuple, x.select("k", "state", "n").collect()))
    want = pick(folds.folded(df, "k", memory.MEMORY))
    assert pick(notes.folded([df.where((F.col("ts") >= a) & (F.col("ts") < a + 200)) for a in (0, 200, 400)], "k", memory.MEMORY)) == want and len(want) == 7


def test_snapshot_ignores_what_is_late(spark):
    schema = "k string, ts long, v string"
    parts = [spark.createDataFrame(r, schema) for r in ([("a", 5, "x"), ("a", 7, "y"), ("b", 1, "z")], [("a", 6, "late"), ("c", 9, None)], [("b", 1, "zz")])]
    table = notes.snapshot(parts, ["k"], ["ts", "v"], "k")
    assert sorted(map(tuple, table.read().collect())) == [("a", 7, "y"), ("b", 1, "zz"), ("c", 9, None)]
    held = table.manifest()["at"]
    table.newest(parts[0].where("k = 'a'"), ["k"], ["ts", "v"])
    touched = {b for b, f in table.manifest()["at"].items() if held.get(b) != f}
    assert len(touched) == 1 and table.swept() >= 1 and table.read().count() == 3


EVENT = "op long, step long, kind string, path string, action string, before string, after string, spot string, hash string"


def test_operations_run_whole_or_not_at_all(spark):
    f = lambda op, path, action, before=None, after="new", spot=None: (op, 0, "file", path, action, before, after, spot or path, None)
    do = lambda op, step, kind: (op, step, kind, None, None, None, None, None, None)
    see = lambda op, step, path, h: (op, step, "attest", path, None, None, None, None, h)
    rows = [
        f(1, "a", "edit", "old"), f(1, "b", "create"), f(1, "m", "move", "mm", "mm", "n"), do(1, 1, "execute"), do(1, 2, "approve"), do(1, 3, "reject"), see(1, 4, "a", "other"), see(1, 4, "m", "mm"), do(1, 5, "execute"),
        see(1, 6, "a", "old"), do(1, 7, "execute"), do(1, 8, "rollback"), see(1, 9, "a", "new"), see(1, 9, "b", "new"), see(1, 9, "n", "mm"), do(1, 10, "rollback"), do(1, 11, "rollback"),
        f(2, "c", "create"), do(2, 1, "approve"), see(2, 2, "c", "there"), do(2, 3, "execute"),
        f(3, "d", "edit", "x"), do(3, 1, "reject"), do(3, 2, "approve"), do(3, 3, "execute"),
        do(4, 1, "approve"), do(4, 2, "execute"),
    ]
    want = [(1, 1, "refused", 0), (1, 2, "approved", 0), (1, 3, "refused", 0), (1, 5, "aborted", 1), (1, 7, "executed", 0), (1, 8, "aborted", 3), (1, 10, "rolled_back", 0), (1, 11, "refused", 0), (2, 1, "approved", 0), (2, 3, "aborted", 1), (3, 1, "rejected", 0), (3, 2, "refused", 0), (3, 3, "refused", 0), (4, 1, "approved", 0), (4, 2, "executed", 0)]
    df = spark.createDataFrame(rows, EVENT)
    for cuts in ([(0, 99)], [(0, 3), (3, 6), (6, 99)]):
        out = notes.Runs([df.where((F.col("step") >= a) & (F.col("step") < b)) for a, b in cuts], lifecycles.operated).out
        assert sorted(map(tuple, out.collect())) == want


def test_state_is_fetched_by_groups(spark, monkeypatch):
    """Of 600 operations in 8 groups the state is a few entries for each group and run, however many operations and files there are; so is that of jobs, but for their rows."""
    monkeypatch.setattr(lifecycles, "GROUPS", 8)
    f = lambda op, path: (op, 0, "file", path, "create", None, "new", path, None)
    do = lambda op, step, kind: (op, step, kind, None, None, None, None, None, None)
    rows = [x for op in range(600) for x in (f(op, "a"), f(op, "b"), do(op, 1, "approve"), do(op, 2, "execute"))]
    df = spark.createDataFrame(rows, EVENT)
    runs = notes.Runs([df.where("step = 0"), df.where("step = 1"), df.where("step = 2")], lifecycles.operated)
    assert max(runs.held()) <= 3 * 8
    assert sorted(map(tuple, runs.out.collect())) == sorted(x for op in range(600) for x in ((op, 1, "approved", 0), (op, 2, "executed", 0)))
    times = {"wait": SECOND, "lease": 60 * SECOND, "keep": 600 * SECOND}
    events = [(i, 1000 + i / 100 + d, a) for i in range(600) for d, a in ((0, "start"), (5, "complete"))]
    jobs = notes.Runs(notes.arrivals(log(spark, events), "ts", 2), lambda e: lifecycles.retried(e, "10 seconds", **times))
    assert jobs.out.count() == 1200 and max(jobs.held()) <= 600 + 4 * 8
