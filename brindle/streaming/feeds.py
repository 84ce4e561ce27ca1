"""Polling jobs as Structured Streaming: cursors with overlap, rate limits, windows, deliveries. Keyed state is in keyed.py."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.rules import delivery


def deduplicated(feed: DataFrame, time: str, keys: list[str], overlap: str = "7 days") -> DataFrame:
    """Rows that an overlapping re-read repeats within the overlap come once; the state ends with the watermark."""
    return feed.withWatermark(time, overlap).dropDuplicatesWithinWatermark(keys)


def tumbling(feed: DataFrame, time: str, size: str, group: str, late: str = "10 minutes") -> DataFrame:
    timed = feed.withWatermark(time, late) if feed.isStreaming else feed
    return timed.groupBy(F.window(time, size).alias("w"), group).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), group, "n")


def sliding(feed: DataFrame, time: str, size: str, step: str, group: str, late: str = "10 minutes") -> DataFrame:
    timed = feed.withWatermark(time, late) if feed.isStreaming else feed
    return timed.groupBy(F.window(time, size, step).alias("w"), group).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), group, "n")


def sessions(feed: DataFrame, time: str, gap: str, group: str, late: str = "10 minutes") -> DataFrame:
    timed = feed.withWatermark(time, late) if feed.isStreaming else feed
    return timed.groupBy(F.session_window(time, gap).alias("w"), group).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), group, "n")


def allowed(times: list[float], most: int, seconds: float, before: list[float]) -> tuple[list[bool], list[float]]:
    """Decides starts in the order of time: at most `most` allowed ones within any `seconds` before one."""
    kept, out = list(before), []
    for t in times:
        kept = [x for x in kept if x > t - seconds]
        out.append(len(kept) < most)
        if out[-1]:
            kept.append(t)
    return out, kept


def rate_limited(rows: DataFrame, user: str, time: str, most: int = 5, seconds: float = 3600) -> DataFrame:
    """Batch form: user, time, allowed.

    A start that follows the one before after `seconds` or more finds an empty window, so the starts between two such gaps are
    decided by themselves, wherever they are; within them a task goes through sorted rows and holds `most` starts at a time.
    """
    seconds_of = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    order = Window.partitionBy("u").orderBy("t")
    gap = F.coalesce(F.col("t") - F.lag("t").over(order) >= seconds, F.lit(True))
    each = rows.select(F.col(user).cast("long").alias("u"), seconds_of.alias("t")).withColumn("run", F.sum(gap.cast("long")).over(order))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, kept = None, []
        for b in batches:
            out = []
            for u, n, t in zip(b["u"], b["run"], b["t"], strict=True):
                if (u, n) != at:
                    at, kept = (u, n), []
                ok, kept = allowed([t], most, seconds, kept)
                out += ok
            yield pd.DataFrame({"u": b["u"], "t": b["t"], "allowed": out})

    dealt = each.repartition("u", "run").sortWithinPartitions("u", "run", "t")
    return dealt.mapInPandas(run, "u long, t double, allowed boolean").withColumnsRenamed({"u": user, "t": time})


def deliver(pending: DataFrame, send: Callable[[pd.Series], pd.Series], most: int = 5) -> DataFrame:
    """One attempt for each pending row: its new status and attempts, whatever the answer. send: texts to response codes, in batches."""
    code = F.pandas_udf(lambda t: send(t), "int", functionType=200)(F.col("text"))
    tried = pending.withColumn("code", F.when(F.col("status") == "pending", code))
    counted = F.col("attempts") + F.when(F.col("status") == "pending", 1).otherwise(0)
    return tried.select("id", delivery(F.col("status"), F.col("attempts"), F.col("code"), most).alias("status"), counted.alias("attempts"))


def quiet(hour, start: int = 22, end: int = 7):
    """Whether messages wait at an hour of the local day."""
    return (hour >= start) | (hour < end)
