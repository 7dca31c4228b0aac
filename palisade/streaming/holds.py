"""The hold machine: requests that wait for a reviewer, as keyed state.

Events have scope (what shares a capacity: a tenant, or one constant for all),
hold_id, kind and ts.  Kind "create" asks for a hold; "approved" and "rejected"
are a reviewer's answers.  A scope with ``most`` holds pending refuses further
ones.  A hold that nobody answers in time expires, answered or not afterwards.
Answers to holds that are not pending change nothing.

The state of a scope is its pending holds, so never more than its capacity; each
has a timer.  Rows come out as holds change: pending, approved, rejected, expired
or refused, with the status that a client gets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGE = "scope string, hold_id string, status string, at timestamp"
ANSWERS = ("approved", "rejected")


def client_status(status: Column) -> Column:
    """HTTP status for what became of a hold; null while it waits, and where the request goes on."""
    return F.when(status == "rejected", 400).when(status.isin("expired", "refused"), 503)


def client_error(status: Column) -> Column:
    return F.when(status == "expired", "hold_timeout").when(status == "refused", "holds_capacity").when(status == "rejected", "hold_rejected")


def change(pending: dict[str, int], kind: str, hold_id: str, now: int, most: int, timeout_ms: int) -> str | None:
    """What an event makes of a hold; ``pending`` has the time by which each must be answered."""
    if kind == "create":
        if hold_id in pending:
            return None
        if len(pending) >= most:
            return "refused"
        pending[hold_id] = now + timeout_ms
        return "pending"
    if kind in ANSWERS and hold_id in pending:
        del pending[hold_id]
        return kind
    return None


def expire(pending: dict[str, int], now: int) -> list[tuple[str, int]]:
    """Holds whose time is over, in the order in which they end."""
    late = sorted((due, h) for h, due in pending.items() if due <= now)
    for _, h in late:
        del pending[h]
    return [(h, due) for due, h in late]


class _Holds(StatefulProcessor):
    def __init__(self, most: int, timeout_ms: int, event_time: bool):
        self.most, self.timeout_ms, self.event_time = most, timeout_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "hold_id string", "due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = {k[0]: v[0] for k, v in self.pending.iterator()}
        pending, out = dict(before), []
        for row in pd.concat(list(rows)).sort_values(["ts", "rank", "hold_id"], kind="stable").itertuples(index=False):
            now = row.ts.value // 1_000_000 if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            out += [(h, "expired", due) for h, due in expire(pending, now)]
            if got := change(pending, row.kind, row.hold_id, now, self.most, self.timeout_ms):
                out.append((row.hold_id, got, now))
        self._keep(before, pending)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = {k[0]: v[0] for k, v in self.pending.iterator()}
        pending = dict(before)
        out = [(h, "expired", due) for h, due in expire(pending, expiredTimerInfo.getExpiryTimeInMs())]
        self._keep(before, pending)
        yield self._rows(key, out)

    def _keep(self, before: dict[str, int], now: dict[str, int]) -> None:
        for h in before.keys() - now.keys():
            self.pending.removeKey((h,))
        for h in now.keys() - before.keys():
            self.pending.updateValue((h,), (now[h],))
        for due in set(before.values()) - set(now.values()):
            self.handle.deleteTimer(due)
        for due in set(now.values()) - set(before.values()):
            self.handle.registerTimer(due)

    @staticmethod
    def _rows(key, out: list) -> pd.DataFrame:
        return pd.DataFrame({"scope": [key[0]] * len(out), "hold_id": [x[0] for x in out], "status": [x[1] for x in out], "at": pd.to_datetime(pd.Series([x[2] for x in out], dtype="int64"), unit="ms")})

    def close(self) -> None:
        pass


def hold_machine(events: DataFrame, most: int, timeout_s: int = 30, event_time: bool = False, late: str = "0 seconds") -> DataFrame:
    """Changes of holds on a streaming DataFrame of events, in append mode.

    Holds expire by the clock, or with ``event_time`` by ts and its watermark.
    Creations come before answers of the same time.
    """
    rows = events.select(F.coalesce("scope", F.lit("")).alias("scope"), F.col("hold_id").cast("string"), "kind", "ts", (F.col("kind") != "create").cast("int").alias("rank"))
    if event_time:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy("scope").transformWithStateInPandas(_Holds(most, timeout_s * 1000, event_time), CHANGE, "append", "EventTime" if event_time else "ProcessingTime")
    return out.withColumns({"client_status": client_status(F.col("status")), "client_error": client_error(F.col("status"))})
