"""Sequential state per key, for batches and streams alike.

A fold takes a key's rows in order of time through a step function. On a batch, partitions are sorted and rows
stream through, so memory doesn't grow with a key; on a stream, the state is kept between micro-batches. What a
fold computes is sequential, so one key is one task's work, however many rows it has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Step = Callable[[tuple, dict], tuple[tuple, dict]]


@dataclass(frozen=True)
class Fold:
    """``step(state, row)`` returns the next state and the columns ``output`` (DDL) of a row; ``state`` is DDL too.

    ``order`` sorts a key's rows. A null state begins as ``start``.
    """

    output: str
    state: str
    start: tuple
    step: Step

    def _columns(self, df: DataFrame) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + self.output

    def batch(self, df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
        start, step, names = self.start, self.step, [x.split()[0] for x in self.output.split(", ")]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last, state = None, start
            for pdf in batches:
                made = []
                for row in pdf.to_dict("records"):
                    k = tuple(row[c] for c in key)
                    state = state if k == last else start
                    last = k
                    state, out = step(state, row)
                    made.append(out)
                yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(made, columns=names)], axis=1)

        return df.repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(run, self._columns(df))

    def stream(self, df: DataFrame, key: list[str], order: list[str], idle_ms: int | None = None) -> DataFrame:
        """State of keys that are idle for ``idle_ms`` of processing time is dropped."""
        start, step, names = self.start, self.step, [x.split()[0] for x in self.output.split(", ")]

        def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            if state.hasTimedOut:
                state.remove()
                return
            now = tuple(state.get) if state.exists else start
            rows = pd.concat(list(parts)).sort_values(order, kind="stable").reset_index(drop=True)
            made = []
            for row in rows.to_dict("records"):
                now, out = step(now, row)
                made.append(out)
            state.update(now)
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
            yield pd.concat([rows, pd.DataFrame(made, columns=names)], axis=1)

        timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
        return df.groupBy(*key).applyInPandasWithState(run, self._columns(df), self.state, "append", timeout)


def sliding_limit(limit: int, seconds: float, at: str = "at") -> Fold:
    """Admission by a log of admitted times within the last ``seconds``; refused ones aren't logged. ``at`` is in seconds."""

    def step(state: tuple, row: dict) -> tuple[tuple, dict]:
        log = [x for x in state[0] if x > row[at] - seconds]
        allowed = len(log) < limit
        log = [*log, float(row[at])] if allowed else log
        wait = max(0.0, log[0] + seconds - row[at]) if log else 0.0
        return (log,), {"allowed": allowed, "remaining": limit - len(log), "reset_seconds": wait}

    return Fold("allowed boolean, remaining int, reset_seconds double", "log array<double>", ([],), step)


def circuit_breaker(failures: int = 2, cooldown: float = 5.0, at: str = "at", ok: str = "ok") -> Fold:
    """Opens after so many failures in a row; while open, one try per cooldown is let through, and success closes it."""

    def step(state: tuple, row: dict) -> tuple[tuple, dict]:
        failed, last = state
        open_ = failed >= failures
        if open_ and row[at] - last < cooldown:
            return state, {"tried": False, "open": True}
        failed = 0 if row[ok] else failed + 1
        return (failed, float(row[at])), {"tried": True, "open": failed >= failures}

    return Fold("tried boolean, open boolean", "failed int, last double", (0, 0.0), step)


def poll_loop(low: int = 60, high: int = 3600, outcome: str = "outcome", retry_after: str = "retry_after") -> Fold:
    """Intervals, failures and circuit of a source over its polls; the circuit starts the count anew."""
    from postlake.functions import vocabulary as V

    rungs = [s for s in V.POLL_LADDER if low <= s <= high]
    slower = dict(zip(rungs, [*rungs[1:], *rungs[-1:]]))  # each rung's next; the last stays
    doubled = lambda seconds, times: int(min(V.POLL_MOST_SECONDS, seconds * 2**times))

    def held(seconds: int) -> int:
        return sorted((low, int(seconds), high))[1]

    # each outcome gives (interval, sleep, failures) from the interval, the failures with this one, and the wait that was asked for
    def fresh(now: int, failures: int, asked: int) -> tuple[int, int, int]:
        return low, low, 0

    def quiet(now: int, failures: int, asked: int) -> tuple[int, int, int]:
        rung = min(rungs, key=lambda s: (abs(s - now), s), default=now)
        return slower.get(rung, now), slower.get(rung, now), 0

    def limited(now: int, failures: int, asked: int) -> tuple[int, int, int]:
        return held(2 * now), max(doubled(now, failures), asked), failures

    def failed(now: int, failures: int, asked: int) -> tuple[int, int, int]:
        return (high, V.POLL_CIRCUIT_SECONDS, 0) if failures >= V.POLL_FAILURES else (now, max(low, doubled(now, failures - 1)), failures)

    known = {"new_jobs": fresh, "no_change": quiet, "rate_limited": limited, "failed": failed}

    def step(state: tuple, row: dict) -> tuple[tuple, dict]:
        asked = row.get(retry_after)
        interval, sleep, failures = known[row[outcome]](held(state[0]), state[1] + 1, int(asked) if asked is not None and asked == asked else 0)
        opened = row[outcome] == "failed" and sleep == V.POLL_CIRCUIT_SECONDS
        return (interval, failures), {"interval": interval, "sleep": sleep, "failures": failures, "circuit_open": opened}

    return Fold("interval int, sleep int, failures int, circuit_open boolean", "interval int, failures int", (low, 0), step)


def idempotency(hours: float = 24, at: str = "at", fingerprint: str = "fingerprint", status: str = "status", seconds: str = "seconds") -> Fold:
    """The verdict on each request of a key: executed, replayed, mismatch, or in_progress.

    A request that is executed is under way for its ``seconds``, and others of its key are in_progress meanwhile. An answer
    that counts (not a server error, not 429) is then kept for ``hours``: the same fingerprint is replayed, another one is a
    mismatch. After that, or while there's no such answer, requests are executed anew. Times are in seconds.
    """

    def step(state: tuple, row: dict) -> tuple[tuple, dict]:
        kept, until, under_way, ends, answer = state
        if under_way is not None and row[at] >= ends:
            if answer < 500 and answer != 429:
                kept, until = under_way, ends + 3600.0 * hours
            under_way = None
        if kept is not None and row[at] >= until:
            kept = None
        own = str(row[fingerprint])
        if kept is not None:
            verdict = "replayed" if kept == own else "mismatch"
        elif under_way is not None:
            verdict = "in_progress"
        else:
            verdict, under_way, ends, answer = "executed", own, float(row[at] + row[seconds]), int(row[status])
        return (kept, until, under_way, ends, answer), {"verdict": verdict}

    return Fold("verdict string", "kept string, until double, under_way string, ends double, answer int", (None, 0.0, None, 0.0, 0), step)
