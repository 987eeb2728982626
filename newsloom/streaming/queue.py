"""The work queue and the polled sources as keyed state with event-time timers.

Both streams take a log with an event time `ts` and give the state of a key after each
row.  Timers fire when the watermark passes, so a run over what is available ends by
itself, and a log that is read again gives the same states, whatever the batches:
rows of one batch are taken in the order of their times, and a lease that ran out
before a row came is settled before it.  Rows further behind the newest than `lateness`
are dropped by Spark, which counts them in the query's progress
(numRowsDroppedByWatermark); flows.count_hours counts such rows itself.  A key has few
rows, so they are taken as rows: a pandas frame for each key costs more than its state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import ATTEMPTS, BACKOFF_MS, STAGES

LEASE_LOST = "the lease ran out before the work was finished"
ITEM = "id string, at long, stage string, status string, retryCount long, runAt long, leaseUntil long, finishedAt long, error string, due boolean"
_STATE = ("stage", "status", "retryCount", "runAt", "leaseUntil", "finishedAt", "error")


class _Queue(StatefulProcessor):
    """One item: pending, running under a lease, done or error."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("item", "stage string, status string, retryCount long, runAt long, leaseUntil long, finishedAt long, error string")

    def _failed(self, s: dict, at: int, error: str | None) -> dict:
        tries = s["retryCount"] + 1
        if tries >= ATTEMPTS[s["stage"]]:
            return s | {"status": "error", "retryCount": tries, "leaseUntil": None, "finishedAt": at, "error": error}
        return s | {"status": "pending", "retryCount": tries, "leaseUntil": None, "runAt": at + BACKOFF_MS * 2 ** (tries - 1), "error": error}

    def _lost(self, s: dict | None, now: int) -> dict | None:
        """The item after a lease that ended before `now`, else null."""
        if s and s["status"] == "running" and s["leaseUntil"] < now:
            return self._failed(s, s["leaseUntil"], LEASE_LOST)
        return None

    def _after(self, s: dict | None, row: dict) -> dict | None:
        kind, at = row["kind"], int(row["ms"])
        until = row["until"]
        if kind == "enqueue":  # an id that is queued already stays as it is
            return s or {"stage": row["stage"], "status": "pending", "retryCount": 0, "runAt": at if until is None else int(until), "leaseUntil": None, "finishedAt": None, "error": None}
        if s is None:
            return None
        if kind == "claim" and s["status"] == "pending" and s["runAt"] <= at:
            return s | {"status": "running", "leaseUntil": int(until)}
        if kind == "ok" and s["status"] == "running":
            return s | {"status": "done", "finishedAt": at, "leaseUntil": None, "error": None}
        if kind == "fail" and s["status"] == "running":
            return self._failed(s, at, row["error"])
        if kind == "replay" and s["status"] == "error":
            return s | {"status": "pending", "retryCount": 0, "runAt": at, "finishedAt": None, "error": None}
        return s

    def _keep(self, s: dict) -> None:
        self.state.update(tuple(s[c] for c in _STATE))
        if s["status"] == "running":
            self.handle.registerTimer(s["leaseUntil"] + 1)
        elif s["status"] == "pending":
            self.handle.registerTimer(s["runAt"])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        found = self.state.get()
        s = dict(zip(_STATE, found)) if found else None
        for row in sorted(rows, key=lambda r: (r["ms"], r["kind"])):  # of one item
            if (lost := self._lost(s, int(row["ms"]))) is not None:
                s = lost
                yield Row(id=key[0], at=lost["finishedAt"] or lost["runAt"], due=False, **lost)
            s = self._after(s, row)
            if s is not None:
                yield Row(id=key[0], at=int(row["ms"]), due=False, **s)
        if s is not None:
            self._keep(s)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, found = expiredTimerInfo.getExpiryTimeInMs(), self.state.get()
        s = dict(zip(_STATE, found)) if found else None
        if (lost := self._lost(s, now)) is not None:
            self._keep(lost)
            yield Row(id=key[0], at=now, due=False, **lost)
            if lost["status"] == "pending" and lost["runAt"] <= timerValues.getCurrentWatermarkInMs():
                yield Row(id=key[0], at=lost["runAt"], due=True, **lost)  # its time is over as well
        elif s and s["status"] == "pending" and s["runAt"] <= now:
            yield Row(id=key[0], at=now, due=True, **s)

    def close(self) -> None:
        pass


def queue_states(log: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Rows of ITEM for a log of id, stage, kind, ts, until, error.

    kind: enqueue (until: the time it is due, else at once), claim (until: the end of
    the lease), ok, fail, replay.  A row for every change; one with `due` when a
    pending item's time has come, which is what wakes a stage, and one when a lease
    runs out: a failed attempt.  Attempts and backoff are work.settle's."""
    rows = log.withWatermark("ts", lateness).select("id", "stage", "kind", "ts", F.unix_millis("ts").alias("ms"), "until", "error")
    return rows.groupBy("id").transformWithState(_Queue(), ITEM, "append", "eventTime")


def last_states(states: DataFrame) -> DataFrame:
    """The newest state of each item: of rows of one time the later change, which has
    the higher count of attempts or the later status."""
    order = F.array_position(F.lit(["pending", "running", "error", "done"]), "status")
    return states.groupBy("id").agg(F.max_by(F.struct(*_STATE), F.struct("at", "retryCount", order, "due")).alias("s")).select("id", "s.*")


def wakes(states: DataFrame, controls: DataFrame | None = None) -> DataFrame:
    """The stages to drain: those with a due item in a batch of states, and those whose
    control was written.  controls: stage."""
    due = states.where((F.col("status") == "pending") & (F.col("due") | (F.col("runAt") <= F.col("at")))).select("stage")
    if controls is not None:
        due = due.unionByName(controls.where(F.col("stage").isin(*STAGES)).select("stage"))
    return due.distinct()


SOURCE = "id string, at long, lastItemId string, lastCount long, zeroYieldRuns long, lastNonZeroCount long, stale boolean, quiet boolean"
STALE_RUNS = 3


class _Sources(StatefulProcessor):
    """One source: its cursor, zero-yield runs and the time of its last poll."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("source", "lastItemId string, lastCount long, zeroYieldRuns long, lastNonZeroCount long, at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest, count, runs, some, at = self.state.get() or (None, 0, 0, 0, 0)
        for row in sorted(rows, key=lambda r: r["ms"]):  # of one source
            count, at = int(row["n"]), int(row["ms"])
            if count:
                newest, runs, some = row["newest"], 0, count
            else:
                runs += 1
            yield Row(id=key[0], at=at, lastItemId=newest, lastCount=count, zeroYieldRuns=runs, lastNonZeroCount=some, stale=runs >= STALE_RUNS and some > 0, quiet=False)
        self.state.update((newest, count, runs, some, at))
        self.handle.registerTimer(at + self.quiet_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        newest, count, runs, some, at = self.state.get()
        if at + self.quiet_ms <= now:
            yield Row(id=key[0], at=now, lastItemId=newest, lastCount=count, zeroYieldRuns=runs, lastNonZeroCount=some, stale=runs >= STALE_RUNS and some > 0, quiet=True)

    def close(self) -> None:
        pass


def source_alerts(polls: DataFrame, quiet_ms: int, lateness: str = "10 minutes") -> DataFrame:
    """Rows of SOURCE for a log of polls (id, ts, n, newest): the cursor after each poll,
    `stale` from the third poll in a row without a post on, where there ever was one;
    and a row with `quiet` where no poll came for quiet_ms."""
    rows = polls.withWatermark("ts", lateness).select("id", "ts", F.unix_millis("ts").alias("ms"), "n", "newest")
    return rows.groupBy("id").transformWithState(_Sources(quiet_ms), SOURCE, "append", "eventTime")
