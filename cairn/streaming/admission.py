"""SS6: when each call to a model may start, under a token budget a window, a cap on active calls, and first come first served."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ADMITTED = "model string, call_id long, queued_at long, started_at long, waited long, reserved_before long, reserved_after long, active_after int, problem string"
#: last start; starts and tokens of the reservations that still count; ends of active calls
STATE = "last long, starts array<long>, tokens array<long>, ends array<long>"


class Gate:
    """What one model's queue has to know: the last start, reservations within the window, ends of active calls.

    As calls start in the order they came, a call's start follows from those before it: it is the first instant, not
    before its own arrival nor the last start, at which a place is free and its tokens fit. So nothing waits in state,
    and the state holds no more than the budget and the cap let in.
    """

    def __init__(self, budget: int, cap: int, window: int, last: int = -(1 << 62), reserved=(), ends=()):
        self.budget, self.cap, self.window = budget, cap, window
        self.last, self.reserved, self.ends = last, deque(reserved), list(ends)
        self.load = sum(t for _, t in self.reserved)
        heapq.heapify(self.ends)

    def expire(self, now: int) -> None:
        while self.reserved and self.reserved[0][0] <= now - self.window:
            self.load -= self.reserved.popleft()[1]
        while self.ends and self.ends[0] <= now:
            heapq.heappop(self.ends)

    def admit(self, at: int, tokens: int, lasts: int) -> tuple:
        """(start, wait, reserved before, reserved after, active after, problem); an oversized call gets no start."""
        if tokens > self.budget:
            return (None, None, None, None, None, f"reservation {tokens} exceeds token budget {self.budget}")
        now = max(at, self.last)
        self.expire(now)
        while len(self.ends) >= self.cap or self.load + tokens > self.budget:
            now = self.ends[0] if len(self.ends) >= self.cap else self.reserved[0][0] + self.window
            self.expire(now)
        before, self.last = self.load, now
        if tokens:
            self.reserved.append((now, tokens))
            self.load += tokens
        active = len(self.ends) + 1
        if lasts > 0:
            heapq.heappush(self.ends, now + lasts)
        return (now, now - at, before, before + tokens, active, None)

    def run(self, rows: pd.DataFrame) -> list[tuple]:
        return [(r.model, r.call_id, r.queued_at, *self.admit(r.queued_at, r.tokens, r.lasts)) for r in rows.itertuples()]


def frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["model", "call_id", "queued_at", "started_at", "waited", "reserved_before", "reserved_after", "active_after", "problem"], dtype=object)


def reserved_tokens(text_bytes, output_ceiling):
    """FN: what a call reserves: a token for three bytes, rounded up, and all the output it may give."""
    return F.ceil(text_bytes / 3).cast("long") + output_ceiling


def calls_of(calls: DataFrame) -> DataFrame:
    return calls.select(F.col("model").cast("string").alias("model"), *[F.col(c).cast("long").alias(c) for c in ("call_id", "queued_at", "tokens", "lasts")])


def check(budget: int, cap: int, window: int) -> None:
    if budget < 1 or cap < 1 or window < 1:
        raise ValueError("budget, cap and window must be positive")


def admitted(calls: DataFrame, budget: int, cap: int, window: int) -> DataFrame:
    """``calls(model, call_id, queued_at, tokens, lasts)`` -> when each starts; times and lengths in one unit.

    Calls of a model queue by ``queued_at``, then ``call_id``. At most ``cap`` are active at once, the tokens of the calls
    that started within the last ``window`` never exceed ``budget``, and a call that alone exceeds it is rejected without
    holding up the others. A reservation is given back exactly ``window`` after its start, a place when its call ends.

    Calls are sorted within partitions, not grouped: a task holds the state of one model at a time.
    """
    check(budget, cap, window)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, gate = None, None
        for b in batches:
            out = []
            for name, rows in b.groupby("model", sort=False, dropna=False):
                if gate is None or name != model:
                    model, gate = name, Gate(budget, cap, window)
                out += gate.run(rows)
            yield frame(out)

    return calls_of(calls).where("model is not null").repartition("model").sortWithinPartitions("model", "queued_at", "call_id").mapInPandas(fold, ADMITTED)


def admitted_stream(calls: DataFrame, budget: int, cap: int, window: int) -> DataFrame:
    """The same over a stream: each call's start as soon as it is delivered; the gate of each model is kept as state.

    A call that is delivered in a later micro-batch than one that came after it queues behind that one.
    """
    check(budget, cap, window)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, starts, tokens, ends = state.get if state.exists else (-(1 << 62), [], [], [])
        gate = Gate(budget, cap, window, last, zip(starts, tokens, strict=True), ends)
        rows = pd.concat(list(parts)).sort_values(["queued_at", "call_id"])
        out = frame(gate.run(rows))
        state.update((gate.last, [s for s, _ in gate.reserved], [t for _, t in gate.reserved], sorted(gate.ends)))
        yield out

    return calls_of(calls).where("model is not null").groupBy("model").applyInPandasWithState(step, ADMITTED, STATE, "append", GroupStateTimeout.NoTimeout)
