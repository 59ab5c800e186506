"""Requests within a time window, and answers that go stale, as state of a stream that shrinks when time has passed.

``window_counts`` gives each request the number of requests of its client within the last ``seconds``, itself included: the
rows of ``operators.state.requests_in_window`` on the finished log. State holds a count for each second of the window;
a timer of event time drops a client's state when its window is empty. ``fresh_answers`` answers lookups from what was stored
within the last ``hours``: a key's answer leaves the state by a timer when it has become stale.

Time is event time: ``at``, in order within each client but for rows that share a second. Rows later than the watermark
are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds of a window, requests that it admits without and with a token, hours for which an answer is fresh.
WINDOW_SECONDS, REQUESTS, REQUESTS_WITH_TOKEN, FRESH_HOURS = 60, 25, 60, 24


def _seconds(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[us]").astype("int64") // 1_000_000


class Window(StatefulProcessor):
    """Requests of one client by second, as far back as the window goes."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "second long", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        batch["_second"] = _seconds(batch["at"])
        held = {k[0]: v[0] for k, v in self.counts.iterator()}
        for second, n in batch.groupby("_second").size().items():
            held[int(second)] = held.get(int(second), 0) + int(n)
        within = {s: sum(n for t, n in held.items() if s - self.seconds < t <= s) for s in set(batch["_second"])}
        newest = max(held)
        for second, n in held.items():
            if second > newest - self.seconds:
                self.counts.updateValue((second,), (n,))
            elif self.counts.containsKey((second,)):
                self.counts.removeKey((second,))
        for expiry in list(self.handle.listTimers()):
            self.handle.deleteTimer(expiry)
        self.handle.registerTimer((newest + self.seconds) * 1000)
        yield pd.DataFrame({"client": key[0], "request_id": batch["request_id"], "at": batch["at"], "n": batch["_second"].map(within).astype("int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.counts.clear()
        return iter(())

    def close(self) -> None:
        pass


def window_counts(requests: DataFrame, seconds: int = WINDOW_SECONDS, lateness: str = "1 minute") -> DataFrame:
    """(client, request_id, at, n) of a stream of requests (client, request_id, at)."""
    typed = requests.select(F.col("client").cast("string").alias("client"), F.col("request_id").cast("long").alias("request_id"), "at").withWatermark("at", lateness)
    return typed.groupBy("client").transformWithStateInPandas(Window(seconds), "client string, request_id long, at timestamp, n long", "Append", "EventTime", eventTimeColumnName="at")


def admitted(counts: DataFrame, has_token: bool = False) -> DataFrame:
    """``counts`` with whether a request is within its client's limit."""
    return counts.withColumn("admitted", F.col("n") <= (REQUESTS_WITH_TOKEN if has_token else REQUESTS))


class Fresh(StatefulProcessor):
    """The newest answer of one key and when it was stored."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.answer = handle.getValueState("answer", "value string, stored long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at", "value"], kind="stable", na_position="last")
        batch["_second"] = _seconds(batch["at"])
        value, stored = self.answer.get() if self.answer.exists() else (None, None)
        out = []
        for request, at, second, new in zip(batch["request_id"], batch["at"], batch["_second"], batch["value"]):
            if isinstance(new, str):
                value, stored = new, int(second)
            else:
                hit = stored is not None and second - stored < self.seconds
                out.append((key[0], request, at, value if hit else None, bool(hit)))
        if stored is not None:
            self.answer.update((value, int(stored)))
            for expiry in list(self.handle.listTimers()):
                self.handle.deleteTimer(expiry)
            self.handle.registerTimer((int(stored) + self.seconds) * 1000)
        yield pd.DataFrame(out, columns=["key", "request_id", "at", "value", "hit"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.answer.clear()
        return iter(())

    def close(self) -> None:
        pass


def fresh_answers(events: DataFrame, hours: int = FRESH_HOURS, lateness: str = "1 minute") -> DataFrame:
    """(key, request_id, at, value, hit) of the lookups in a stream of (key, request_id, at, value).

    A row with a value stores it, one without looks it up; of one moment, stores come first.
    """
    typed = events.select(F.col("key").cast("string").alias("key"), F.col("request_id").cast("long").alias("request_id"), "at", F.col("value").cast("string").alias("value")).withWatermark("at", lateness)
    schema = "key string, request_id long, at timestamp, value string, hit boolean"
    return typed.groupBy("key").transformWithStateInPandas(Fresh(hours * 3600), schema, "Append", "EventTime", eventTimeColumnName="at")
