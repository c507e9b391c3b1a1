"""Life cycles as keyed state with timers: jobs that wait, run out and are forgotten, and operations that run whole or not at all."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Tries of a job before it is parked.
TRIES = 3
HOUR = 3_600_000_000
#: What jobs are given in the queries, in microseconds: between tries, for one run, and until an ended job is forgotten.
WAIT, LEASE, KEEP = 8 * HOUR, 10 * HOUR, 72 * HOUR
#: Into so many groups jobs and operations are dealt: state is fetched and put once a group and batch, not once a key.
GROUPS = 1 << 12
STEP = {"job": "int64", "at_us": "int64", "what": "object", "attempts": "int64"}


def _frame(rows: list[tuple], columns: dict) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=list(columns)).astype(columns)


def _group(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(GROUPS)).cast("int")


class Retries(StatefulProcessor):
    """A job's tries: it starts only when it is due; a failure makes it due after ``wait`` for each try so far, the third parks it; a run that isn't heard of for ``lease`` is an orphan's, which is due at once;
    an ended job is forgotten after ``keep``, and what comes then is a new one's. Actions that a state doesn't allow change nothing.

    What time brings is applied before an event that comes after it, and by a timer where no event does: rows are the same however events fall into batches. The
    events of a group of jobs (one of ``GROUPS``) in one batch are put in order of time, so batches should be bounded (``maxBytesPerTrigger``). A group's state is its jobs that have begun.
    """

    def __init__(self, wait: int = WAIT, lease: int = LEASE, keep: int = KEEP):
        self.wait, self.lease, self.keep = wait, lease, keep

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getListState("jobs", "job long, status string, attempts long, since long")

    def due(self, status: str, attempts: int, since: int) -> int | None:
        """When time alone changes the state."""
        return since + {"waiting": self.wait * attempts, "running": self.lease, "completed": self.keep, "failed": self.keep}[status] if status != "pending" else None

    def lapse(self, s: tuple, now: int, out: list) -> tuple:
        """The state at ``now`` if nothing happens before; null when the job is forgotten."""
        at = self.due(*s)
        if at is None or now < at:
            return s
        if s[0] in ("completed", "failed"):
            return ("pending", 0, at)
        out.append((at, "due" if s[0] == "waiting" else "orphaned", s[1]))
        return ("pending", s[1], at)

    def act(self, s: tuple, now: int, action: str, out: list) -> tuple:
        status, attempts, _ = s
        if action == "start" and status == "pending":
            s = ("running", attempts + 1, now)
        elif status == "running" and action == "complete":
            s = ("completed", attempts, now)
        elif status == "running" and action == "recover":
            s = ("pending", attempts, now)
        elif status == "running" and action == "fail":
            s = ("failed" if attempts >= TRIES else "waiting", attempts, now)
        else:
            return s
        out.append((now, s[0], s[1]))
        return s

    def _held(self) -> dict[int, tuple]:
        return {job: (status, attempts, since) for job, status, attempts, since in map(tuple, self.state.get())}

    def _keep(self, held: dict[int, tuple]) -> None:
        """Puts the states of the jobs that have begun, and a timer for the first that time will change."""
        rows = [(job, *s) for job, s in held.items() if s[0] != "pending" or s[1]]
        if rows:
            self.state.put(rows)
        else:
            self.state.clear()
        at = min((at for _, *s in rows if (at := self.due(*s)) is not None), default=None)
        if at is not None:
            self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, out = self._held(), []
        for job, us, action in pd.concat(list(rows)).sort_values(["us", "event_id"])[["job", "us", "action"]].itertuples(index=False):
            got: list = []
            held[job] = self.act(self.lapse(held.get(job, ("pending", 0, 0)), us, got), us, action, got)
            out += [(job, *x) for x in got]
        self._keep(held)
        yield _frame(out, STEP)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, out = self._held(), []
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        after = {}
        for job, s in held.items():
            got: list = []
            after[job] = self.lapse(s, now, got)
            out += [(job, *x) for x in got]
        if after != held:
            self._keep(after)
        yield _frame(out, STEP)

    def close(self) -> None:
        pass


def retried(events: DataFrame, late: str = "2 hours", **times) -> DataFrame:
    """job, at_us, what, attempts: all that happens to the jobs of a stream (job, ts, event_id, action): running, waiting, due, orphaned, pending (recovered), completed, failed (parked).

    Rows more than ``late`` behind the newest are dropped. State is of jobs that have begun and aren't forgotten.
    """
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    return e.withColumn("g", _group("job")).groupBy("g").transformWithStateInPandas(Retries(**times), "job long, at_us long, what string, attempts long", "Append", "EventTime")


OUTCOME = {"op": "int64", "step": "int64", "what": "object", "faults": "int64"}


class Operations(StatefulProcessor):
    """An operation's files, what is attested of them, and its status: prepared, then approved or rejected, executed and rolled back.

    The state of a group of operations (one of ``GROUPS``) is a log: a batch adds its files, attestations and decisions as one entry, so large operations write what comes. It is read when a
    decision comes, and written anew, without what holds no more, when that is the larger part.

    An operation is executed if it is approved and every file is as it was when the operation was made: a path to create must not be attested, any other must be, with the text expected. One fault stops
    the whole operation, which stays approved. It is rolled back if it is executed and every file is as it left it, by what was attested since; a fault refuses that too.
    """

    def init(self, handle) -> None:
        self.log = handle.getListState("log", "rows string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        t = pd.concat(list(rows)).sort_values(["op", "step", "path"], na_position="first")
        told = t["kind"].isin(["file", "attest"])
        t["after"] = t["after"].where(t["kind"] != "attest", t["hash"])
        t = t[["step", "op", "kind", "path", "action", "before", "after", "spot"]].astype(object)
        t = t.where(t.notna(), None)
        if told.all():
            self.log.appendValue((json.dumps(t.iloc[:, 1:].values.tolist()),))
            return
        ops: dict[int, _Operation] = {}
        n, new, out = 0, [], []
        for (text,) in self.log.get():
            for op, *x in json.loads(text):
                n += 1
                ops.setdefault(op, _Operation()).note(*x)
        for step, op, kind, *x in t.values.tolist():
            o = ops.setdefault(op, _Operation())
            if kind in ("file", "attest"):
                o.note(kind, *x)
                new.append((op, kind, *x))
            else:
                what, faults = o.decide(kind)
                if what == o.status:
                    new.append((op, what))
                out.append((op, step, what, faults))
        if n + len(new) > 2 * sum(o.size() for o in ops.values()):
            self.log.put([(json.dumps([(op, *x) for op, o in ops.items() for x in o.entries()]),)])
        elif new:
            self.log.appendValue((json.dumps(new),))
        yield _frame(out, OUTCOME)

    def close(self) -> None:
        pass


class _Operation:
    """One operation as its log tells it."""

    def __init__(self):
        self.status, self.files, self.seen = "prepared", {}, {}

    def note(self, kind: str, path=None, action=None, before=None, after=None, spot=None) -> None:
        if kind == "file":
            if self.status == "prepared":
                self.files[path] = (action, before, after, spot)
        elif kind == "attest":
            self.seen[path] = after
        else:
            self.status = kind
            if kind == "executed":  # what was seen before tells nothing of what the operation left
                self.seen = {}

    def faults(self, check: str) -> int:
        bad = 0
        for path, (action, before, after, spot) in self.files.items():
            if check == "rollback":
                bad += self.seen.get(spot) != after
            else:
                bad += path in self.seen if action == "create" else self.seen.get(path) != before
        return bad

    def decide(self, kind: str) -> tuple[str, int]:
        wanted, to = {"approve": ("prepared", "approved"), "reject": ("prepared", "rejected"), "execute": ("approved", "executed"), "rollback": ("executed", "rolled_back")}[kind]
        if self.status != wanted:
            return "refused", 0
        faults = self.faults(kind) if kind in ("execute", "rollback") else 0
        if faults:
            return "aborted", faults
        self.note(to)
        return to, 0

    def size(self) -> int:
        return len(self.files) + len(self.seen) + (self.status != "prepared")

    def entries(self) -> Iterator[tuple]:
        """The shortest log: files come first, as they count while the operation is prepared; what was attested comes after the status, as execution forgets it."""
        yield from (("file", path, *x) for path, x in self.files.items())
        if self.status != "prepared":
            yield (self.status,)
        yield from (("attest", path, None, None, h, None) for path, h in self.seen.items())


def operated(events: DataFrame) -> DataFrame:
    """op, step, what, faults: what becomes of each decision of a stream (op, step, kind: file, attest, approve, reject, execute or rollback; path, action, before, after, spot: where it lies then, hash): the status it leads to,
    ``aborted`` with the number of files at fault, or ``refused`` in a status that doesn't allow it."""
    return events.withColumn("g", _group("op")).groupBy("g").transformWithStateInPandas(Operations(), "op long, step long, what string, faults long", "Append", "None")
