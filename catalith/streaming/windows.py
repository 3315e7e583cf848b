"""Windowed metrics that run alike on a table and on a stream: rates, ratios, sessions, histogram quantiles; and alerts.

On a stream, pass ``late``: rows that come later than that behind the newest event time are dropped by the watermark and
the state of closed windows is freed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Upper bounds of latency buckets; the last is open.
BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0)


def _timed(events: DataFrame, ts: str, late: str | None) -> DataFrame:
    return events.withWatermark(ts, late) if late else events


def rate(events: DataFrame, length: str = "5 minutes", slide: str | None = None, ts: str = "ts", key: str = "event_type", late: str | None = None) -> DataFrame:
    """(start, key, n): events per window and key."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    return _timed(events, ts, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def ratio(events: DataFrame, condition: Column, length: str = "1 hour", slide: str = "15 minutes", ts: str = "ts", late: str | None = None) -> DataFrame:
    """(start, n, hits, ratio): the share of events that meet a condition in sliding windows."""
    rows = _timed(events, ts, late).groupBy(F.window(ts, length, slide).alias("w")).agg(F.count("*").alias("n"), F.count_if(condition).alias("hits"))
    return rows.select(F.col("w.start").alias("start"), "n", "hits", F.round(F.col("hits") / F.col("n"), 6).alias("ratio"))


def sessions(events: DataFrame, gap: str = "30 minutes", ts: str = "ts", key: str = "user_id", late: str | None = None) -> DataFrame:
    """(key, start, finish, n): sessions that end after ``gap`` without an event."""
    rows = _timed(events, ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return rows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("finish"), "n")


def bucket_counts(events: DataFrame, value: str = "value", length: str = "1 day", ts: str = "ts", bounds: Sequence[float] = BOUNDS, late: str | None = None) -> DataFrame:
    """(start, counts): cumulative counts per bucket bound, the last entry being all."""
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    rows = _timed(events, ts, late).groupBy(F.window(ts, length).alias("w")).agg(*counts, F.count(value).alias("all"))
    return rows.select(F.col("w.start").alias("start"), F.array(*[F.col(f"b{i}") for i in range(len(bounds))], F.col("all")).alias("counts"))


def histogram_quantile(counts: Column, q: float, bounds: Sequence[float] = BOUNDS) -> Column:
    """The q-quantile of cumulative bucket counts, linear inside its bucket; the last bound if it lies in the open bucket."""
    uppers = F.array(*map(F.lit, bounds))
    rank = F.lit(q) * F.element_at(counts, -1)
    places = F.filter(F.sequence(F.lit(1), F.lit(len(bounds))), lambda i: F.element_at(counts, i) >= rank)
    i = F.get(places, F.lit(0))
    low = F.when(i == 1, 0.0).otherwise(F.get(uppers, i - 2))
    before = F.when(i == 1, 0).otherwise(F.get(counts, i - 2))
    inside = low + (F.get(uppers, i - 1) - low) * F.coalesce(F.try_divide(rank - before, F.get(counts, i - 1) - before), F.lit(0.0))
    return F.when(F.element_at(counts, -1) == 0, F.lit(None)).when(i.isNull(), F.lit(float(bounds[-1]))).otherwise(inside)


def alert_islands(windows: DataFrame, condition: Column, length: int, start: str = "start", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, first, last, windows): stretches of at least ``length`` consecutive rows that all meet a condition."""
    own = W.partitionBy(*keys).orderBy(start) if keys else W.partitionBy(F.lit(1)).orderBy(start)  # one row per window of time
    marked = windows.withColumn("__all", F.row_number().over(own)).filter(condition)
    island = F.col("__all") - F.row_number().over(own)
    grouped = marked.withColumn("__island", island).groupBy(*keys, "__island").agg(F.min(start).alias("first"), F.max(start).alias("last"), F.count("*").alias("windows"))
    return grouped.filter(F.col("windows") >= length).drop("__island")
