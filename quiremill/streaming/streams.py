"""Streams: the same operators on arriving rows, with watermarks, and rates over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiremill.functions import text as T


def unique_requests(stream: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """The first of the requests with equal keys within the watermark; later ones, and ones that come too late, are dropped. State is kept for `late` only."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, ts: str, by: str, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start, by and rows of tumbling windows; on a stream a window comes out when the watermark has passed it."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, length).alias("w"), by).agg(F.count(F.lit(1)).alias("rows")).select(F.col("w.start").alias("start"), by, "rows")


def text_stream_stats(stream: DataFrame, text: str = "text") -> DataFrame:
    """The stream with words and lines of its texts: per row, so that batch and stream give the same."""
    return stream.withColumns({"words": T.word_count(F.coalesce(text, F.lit(""))), "lines": F.size(F.split(F.coalesce(text, F.lit("")), "\n"))})


def over_rate(events: DataFrame, by: str, ts: Column, seconds: int, most: int) -> DataFrame:
    """Events that come when their key already has `most` in the `seconds` before and with them: a sliding limit, over a range window."""
    w = Window.partitionBy(by).orderBy(F.unix_micros(ts.cast("timestamp"))).rangeBetween(1 - seconds * 1_000_000, 0)
    return events.withColumn("recent", F.count(F.lit(1)).over(w)).where(F.col("recent") > most)


def sessions(events: DataFrame, by: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """by, start, end and rows of sessions that a gap ends."""
    return events.groupBy(by, F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("rows")).select(by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "rows")
