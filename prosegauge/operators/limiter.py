"""Sliding-log rate limit: a request passes if fewer than ``limit`` passed in the ``seconds`` before it; refused ones leave no mark."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


class Log:
    """The times at which one client's requests passed, as far back as they count."""

    def __init__(self, seconds: float, limit: int, times: Iterable[float] = ()) -> None:
        self.seconds, self.limit, self.times = seconds, limit, deque(times)

    def ask(self, now: float) -> tuple[bool, int]:
        """(allowed, retry_after) of a request; requests come in order of time."""
        while self.times and self.times[0] < now - self.seconds:
            self.times.popleft()
        if len(self.times) < self.limit:
            self.times.append(now)
            return True, 0
        return False, max(1, int(self.seconds - (now - self.times[0])))


def decide(times: list[float], seconds: float, limit: int) -> list[tuple[bool, int]]:
    """(allowed, retry_after) of one client's requests in order of time."""
    log = Log(seconds, limit)
    return [log.ask(now) for now in times]


def sliding_limit(events: DataFrame, seconds: int = 3600, limit: int = 2) -> DataFrame:
    """(event_id, user_id, allowed, retry_after). The rule is sequential: users are dealt and sorted by Spark, and rows stream through with one user's log in memory."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, log = None, Log(seconds, limit)
        for f in frames:
            made = []
            for e, u, now in zip(f.event_id, f.user_id, f.t, strict=True):
                if u != user:
                    user, log = u, Log(seconds, limit)
                made.append((e, u, *log.ask(now)))
            yield pd.DataFrame(made, columns=["event_id", "user_id", "allowed", "retry_after"])

    dealt = events.selectExpr("event_id", "user_id", "unix_micros(CAST(ts AS timestamp)) / 1e6D AS t").repartition("user_id").sortWithinPartitions("user_id", "t", "event_id")
    return dealt.mapInPandas(run, "event_id long, user_id long, allowed boolean, retry_after long")
