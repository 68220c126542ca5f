"""Polling of sources as a stream with timers: when each source is due, woken early or stopped by signals.

A source's loop is one small state. Rows about it say that it starts, how its last poll ended, that it shall be polled
now, or that it shall stop; a timer says that its sleep is over. The same two functions, :func:`settle` and
:func:`receive`, run on a batch in order of event time, where timers fire between rows, and in a streaming query with
processing-time timers of the state store.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from postlake.streaming.folds import Fold, poll_loop

#: What a row can say about a source, beside the outcomes of polls.
START, POLL_NOW, STOP = "start", "poll_now", "stop"
OUTCOMES = ("new_jobs", "no_change", "rate_limited", "failed")
_STATE = "mode string, until double, interval int, failures int, wake boolean"


@dataclass(frozen=True)
class Loop:
    """A source's loop. ``mode`` is stopped, polling (its poll is under way), ending (it stops after that), sleeping or circuit; ``until`` is when its sleep ends.

    ``wake`` remembers that it shall be polled again at once.
    """

    mode: str = "stopped"
    until: float = 0.0
    interval: int = 0
    failures: int = 0
    wake: bool = False


def settle(loop: Loop, now: float) -> tuple[Loop, list[float]]:
    """The loop after the timers up to ``now``, and when it became due: the end of its sleep."""
    if loop.mode in ("sleeping", "circuit") and loop.until <= now:
        return Loop("polling", 0.0, loop.interval, loop.failures), [loop.until]
    return loop, []


def receive(loop: Loop, now: float, kind: str, retry_after: float | None, low: int = 60, high: int = 3600) -> tuple[Loop, list[float]]:
    """The loop after a row, and when it became due.

    poll_now ends a sleep at once, is remembered while a poll is under way, and doesn't wake an open circuit. stop ends a sleep for
    good, and lets a poll that is under way end. The outcome of a poll that isn't under way says nothing, nor does the start of
    a loop that runs. An outcome that isn't known raises ValueError.
    """
    running = loop.mode in ("polling", "ending")
    if kind == START:
        if loop.mode == "stopped":
            return Loop("polling", 0.0, low, 0), [now]
        return (Loop("polling", 0.0, loop.interval, loop.failures, loop.wake) if loop.mode == "ending" else loop), []
    if kind == STOP:
        return Loop("ending" if running else "stopped", 0.0, loop.interval, loop.failures), []
    if kind == POLL_NOW:
        if loop.mode == "sleeping":
            return Loop("polling", 0.0, loop.interval, loop.failures), [now]
        return Loop(loop.mode, loop.until, loop.interval, loop.failures, loop.wake or loop.mode == "polling"), []
    if kind not in OUTCOMES:
        raise ValueError(f"unknown outcome {kind}")
    if not running:
        return loop, []
    (interval, failures), decided = poll_loop(low, high).step((loop.interval, loop.failures), {"outcome": kind, "retry_after": retry_after})
    if loop.mode == "ending":
        return Loop("stopped", 0.0, interval, failures), []
    if loop.wake and not decided["circuit_open"]:
        return Loop("polling", 0.0, interval, failures), [now]
    return Loop("circuit" if decided["circuit_open"] else "sleeping", now + decided["sleep"], interval, failures), []


def poll_timers(low: int = 60, high: int = 3600, at: str = "at", kind: str = "kind", retry_after: str = "retry_after") -> Fold:
    """The loop over a source's rows in order of time (seconds): ``due`` are the times at which it became due since the row before."""

    def step(state: tuple, row: dict) -> tuple[tuple, dict]:
        loop, fired = settle(Loop(*state), row[at])
        asked = row.get(retry_after)
        loop, due = receive(loop, float(row[at]), row[kind], None if asked is None or asked != asked else asked, low, high)
        return (loop.mode, loop.until, loop.interval, loop.failures, loop.wake), {"due": fired + due, "mode": loop.mode, "until": loop.until, "interval": loop.interval, "failures": loop.failures}

    return Fold("due array<double>, mode string, until double, interval int, failures int", _STATE, (Loop().mode, 0.0, 0, 0, False), step)


class PollTimers(StatefulProcessor):
    """The same in a streaming query: rows (source, seq, kind, retry_after), sorted by seq in a micro-batch, count from when they come in."""

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("loop", _STATE)

    def _loop(self) -> Loop:
        return Loop(*self.state.get()) if self.state.exists() else Loop()

    def _keep(self, loop: Loop) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if loop.mode == "stopped":
            self.state.clear()
            return
        self.state.update((loop.mode, loop.until, loop.interval, loop.failures, loop.wake))
        if loop.mode in ("sleeping", "circuit"):
            self.handle.registerTimer(int(loop.until * 1000))

    def _rows(self, source: str, due: list[float], why: str) -> pd.DataFrame:
        return pd.DataFrame({"source": [source] * len(due), "due": due, "why": [why] * len(due)})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() / 1000
        loop, fired = settle(self._loop(), now)
        if fired:
            yield self._rows(key[0], fired, "timer")
        for row in pd.concat(list(rows)).sort_values("seq", kind="stable").to_dict("records"):
            asked = row["retry_after"]
            loop, due = receive(loop, now, row["kind"], None if asked is None or asked != asked else asked, self.low, self.high)
            if due:
                yield self._rows(key[0], due, row["kind"])
        self._keep(loop)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        loop, fired = settle(self._loop(), expiredTimerInfo.getExpiryTimeInMs() / 1000 + 0.001)
        if fired:
            yield self._rows(key[0], fired, "timer")
            self._keep(loop)


def due_polls(rows: DataFrame, low: int = 60, high: int = 3600) -> DataFrame:
    """(source, due, why) of a stream (source string, seq long, kind string, retry_after double): each poll that becomes due.

    Outcomes of polls and signals come in the same stream. Timers need the RocksDB state store (``STORE``).
    """
    return rows.groupBy("source").transformWithStateInPandas(PollTimers(low, high), "source string, due double, why string", "append", "processingTime")


#: The setting of a session whose streaming queries have timers.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
