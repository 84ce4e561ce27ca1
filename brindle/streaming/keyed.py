"""State per key with an end: rate limits, keys announced once, deliveries with attempts.

Each is a stateful processor over Spark's state store; what it holds for a key is bounded and goes when a timer or the time to
live says so. The state store must be one that keeps composite types and timers (RocksDB); with_store() sets it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from brindle.streaming.feeds import allowed

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_store(spark: SparkSession) -> None:
    """Queries started from now on keep their state in RocksDB, with checkpoints in their checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class RateLimit(StatefulProcessor):
    """At most `most` allowed starts within any `seconds`. State: the allowed starts of that time, a list of `most` at most. A
    timer in event time, `seconds` after the last of them, deletes it. Starts of a micro-batch are decided in order of time."""

    def __init__(self, most: int, seconds: float) -> None:
        self.most, self.seconds = most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "t double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = [t for (t,) in self.kept.get()]
        times = sorted(t for b in rows for t in b["t"])
        out, after = allowed(times, self.most, self.seconds, before)
        if after:
            self.kept.put([(t,) for t in after])
            for timer in [t for t in self.handle.listTimers()]:
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            self.handle.registerTimer(int((after[-1] + self.seconds) * 1000))
        yield pd.DataFrame({"u": [key[0]] * len(times), "t": times, "allowed": out})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_limit_stream(feed: DataFrame, user: str, time: str, most: int = 5, seconds: float = 3600, late: str = "10 minutes") -> DataFrame:
    """u, t (seconds), allowed. feed: a stream; rows later than the watermark are dropped."""
    at = F.col(time).cast("timestamp")
    rows = feed.select(F.col(user).cast("long").alias("u"), at.alias("at"), (F.unix_micros(at) / 1e6).alias("t")).withWatermark("at", late)
    return rows.groupBy("u").transformWithStateInPandas(RateLimit(most, seconds), "u long, t double, allowed boolean", "Append", "EventTime")


class Once(StatefulProcessor):
    """The first row of a key; later ones pass only after `keep` milliseconds without a mark (none: never again)."""

    def __init__(self, keep: int | None) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "yes boolean", self.keep)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fresh = not self.seen.exists()
        for b in rows:
            if fresh and len(b):
                self.seen.update((True,))
                fresh = False
                yield b.head(1)

    def close(self) -> None:
        pass


def once(feed: DataFrame, key: str, keep: int | None = None) -> DataFrame:
    """Keys that were not seen for `keep` milliseconds, across restarts; without it the state has a mark per key for ever."""
    mode = "None" if keep is None else "ProcessingTime"
    return feed.groupBy(key).transformWithStateInPandas(Once(keep), feed.schema, "Append", mode)


#: What is kept of a message: its id (none: it has no id), its status and its attempts.
KEPT = np.dtype([("id", "<i8"), ("none", "?"), ("status", "i1"), ("attempts", "<i4")])
STATUS = ("pending", "sent", "failed")


class Delivery(StatefulProcessor):
    """One attempt for each tick of a pending message. The state of a bucket of messages is one value, which is read and written
    once a batch: a key for each message would cost calls to the state store for each of them. Settled messages stay, so that
    later ticks don't send them again."""

    def __init__(self, send: Callable[[str, int], int | None], most: int) -> None:
        self.send, self.most = send, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "kept binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = np.frombuffer(self.state.get()[0], KEPT).tolist() if self.state.exists() else []
        kept = {(i, none): (status, attempts) for i, none, status, attempts in before}
        for b in rows:
            out = []
            for i, none, text in zip(b["id"].tolist(), b["none"].tolist(), b["text"].tolist(), strict=True):
                status, attempts = kept.get((i, none), (0, 0))
                if status == 0:
                    code = self.send(text, attempts)
                    attempts += 1
                    again = code is None or code == 429 or code >= 500
                    status = 1 if code == 200 else 0 if again and attempts < self.most else 2
                    out.append((None if none else i, STATUS[status], attempts))
                    kept[i, none] = status, attempts
            yield pd.DataFrame(out, columns=["id", "status", "attempts"]).astype({"id": "Int64", "status": object, "attempts": "int32"})
        self.state.update((np.array([(*k, *v) for k, v in kept.items()], KEPT).tobytes(),))

    def close(self) -> None:
        pass


def deliveries(ticks: DataFrame, send: Callable[[str, int], int | None], most: int = 5, buckets: int = 1024) -> DataFrame:
    """id, status, attempts after each attempt. ticks: id and text, once for each time that delivery is tried; send: a text and
    its attempts so far to the answer's code, null for none. The number of buckets stays as it was when a stream began."""
    i = F.col("id").cast("long")
    rows = ticks.select(F.coalesce(i, F.lit(0)).alias("id"), i.isNull().alias("none"), "text", F.pmod(F.xxhash64(i), F.lit(buckets)).alias("bucket"))
    return rows.groupBy("bucket").transformWithStateInPandas(Delivery(send, most), "id long, status string, attempts int", "Append", "None")
