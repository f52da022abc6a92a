"""Jobs of a batch service over the log of their polls: which state each ends in, as a batch and as a stream.

A job is followed from its first poll. A poll that reports the state it is in says nothing new; one that reports a state
that can come next moves it there; any other is illegal, is counted and changes nothing. A terminal state ends it, and so
does its deadline (its first poll and the window): then it has expired at that time. Polls that come later don't count.
Polls count in the order of their times, then of the states' names; statuses are trimmed and lower-cased, blank ones and
null times are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What can follow each state (fixed values of the service); the empty one is a job not seen before.
NEXT = {
    "": ("validating", "in_progress", "finalizing", "completed", "failed", "expired", "cancelling", "cancelled"),
    "validating": ("in_progress", "finalizing", "completed", "failed", "expired", "cancelling", "cancelled"),
    "in_progress": ("finalizing", "completed", "failed", "expired", "cancelling", "cancelled"),
    "finalizing": ("completed", "failed", "expired", "cancelling", "cancelled"),
    "cancelling": ("cancelled", "completed", "failed", "expired"),
}
TERMINAL = ("completed", "failed", "expired", "cancelled")
SCHEMA = "job string, status string, ended_at timestamp, n_polls int, n_illegal int"


def _polls(polls: DataFrame) -> DataFrame:
    """(job, ts, status) of the polls that count."""
    status = F.lower(F.trim("status"))
    return polls.select(F.col("job").cast("string").alias("job"), F.col("ts").cast("timestamp").alias("ts"), status.alias("status")).filter("job is not null and ts is not null and status <> ''")


def outcomes(polls: DataFrame, window: str = "24 hours", now: Column | None = None) -> DataFrame:
    """Jobs that have ended by the last poll of all jobs (or by ``now``): job, status, ended_at, n_polls (up to the end, with
    the one that ended it) and n_illegal.

    A fold over each job's polls up to its deadline, whose number the window and the poll interval bound.
    """
    rows = _polls(polls)
    first = rows.groupBy("job").agg((F.min("ts") + F.expr(f"interval {window}")).alias("deadline"))
    last = rows.agg(F.max("ts").alias("now")) if now is None else rows.agg(F.first(now, ignorenulls=True).alias("now"))
    counted = rows.join(first, "job").filter("ts <= deadline").groupBy("job", "deadline").agg(F.array_sort(F.collect_list(F.struct("ts", "status"))).alias("polls"))
    follows = F.create_map(*(x for a, b in NEXT.items() for x in (F.lit(a), F.array(*map(F.lit, b)))))
    start = F.struct(F.lit("").alias("status"), F.lit(None).cast("timestamp").alias("at"), F.lit(0).alias("n"), F.lit(0).alias("bad"))

    def step(state: Column, poll: Column) -> Column:
        same = poll["status"] == state["status"]
        legal = F.array_contains(F.coalesce(F.try_element_at(follows, state["status"]), F.array().cast("array<string>")), poll["status"])
        moved = F.struct(F.when(legal, poll["status"]).otherwise(state["status"]).alias("status"), F.when(legal, poll["ts"]).otherwise(state["at"]).alias("at"), (state["n"] + 1).alias("n"), (state["bad"] + F.when(same | legal, 0).otherwise(1)).alias("bad"))
        return F.when(state["status"].isin(*TERMINAL), state).otherwise(moved)

    folded = counted.withColumn("s", F.aggregate("polls", start, step)).join(F.broadcast(last))  # one row
    ended = F.col("s.status").isin(*TERMINAL)
    out = folded.filter(ended | (F.col("deadline") < F.col("now")))
    return out.select("job", F.when(ended, F.col("s.status")).otherwise("expired").alias("status"), F.when(ended, F.col("s.at")).otherwise(F.col("deadline")).alias("ended_at"), F.col("s.n").alias("n_polls"), F.col("s.bad").alias("n_illegal"))


class _Job(StatefulProcessor):
    """Holds a job's polls until the watermark passes them, so that they are taken in the order of their times."""

    def __init__(self, window: timedelta):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, n int, bad int, deadline timestamp, done boolean")
        self.waiting = handle.getListState("waiting", "ts timestamp, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        job = self.state.get() if self.state.exists() else ("", 0, 0, None, False)
        polls = [(t.to_pydatetime(), s) for frame in rows for t, s in zip(frame["ts"], frame["status"], strict=True)]
        if not job[4] and polls:
            self.waiting.appendList(polls)
            self._wake(timerValues)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        status, n, bad, deadline, done = self.state.get() if self.state.exists() else ("", 0, 0, None, False)
        polls = sorted((t, s) for t, s in self.waiting.get()) if self.waiting.exists() else []
        ready = [p for p in polls if _millis(p[0]) < mark]
        rest = polls[len(ready) :]
        ended = None
        for t, s in ready:
            if deadline is None:
                deadline = t + self.window
            if ended or done or t > deadline:
                continue
            n += 1
            if s in NEXT.get(status, ()):
                status = s
                ended = t if s in TERMINAL else None
            elif s != status:
                bad += 1
        if not ended and not done and deadline is not None and _millis(deadline) < mark:
            status, ended = "expired", deadline
        done = done or ended is not None
        self.waiting.clear()
        if rest and not done:
            self.waiting.put(rest)
        self.state.update((status, n, bad, deadline, done))
        if not done:
            self._wake(timerValues)
        if ended:
            yield pd.DataFrame({"job": [key[0]], "status": [status], "ended_at": [pd.Timestamp(ended)], "n_polls": [n], "n_illegal": [bad]})

    def _wake(self, timerValues) -> None:
        """At the earliest time that something can happen: a poll that waits, or the deadline."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        times = [_millis(t) for t, _ in self.waiting.get()] if self.waiting.exists() else []
        if self.state.exists() and (deadline := self.state.get()[3]) is not None:
            times.append(_millis(deadline))
        if times:
            self.handle.registerTimer(max(min(times) + 1, timerValues.getCurrentWatermarkInMs() + 1))

    def close(self) -> None:
        pass


def _millis(t) -> int:
    return int(pd.Timestamp(t).value // 1_000_000)


def outcomes_stream(polls: DataFrame, window: timedelta = timedelta(hours=24), delay: str = "10 minutes") -> DataFrame:
    """The same rows from a stream of polls, each as soon as the watermark (``delay`` behind the latest poll) has passed what
    ends the job. Needs the RocksDB state store."""
    rows = _polls(polls).withWatermark("ts", delay)
    return rows.groupBy("job").transformWithStateInPandas(statefulProcessor=_Job(window), outputStructType=SCHEMA, outputMode="Append", timeMode="EventTime")
