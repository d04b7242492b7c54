"""Event-time operators: works on streams and tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import native


def mint_time_ids(events: DataFrame, ts: str, hub: str | None = None, realm: int = 0, into: str = "time_id") -> DataFrame:
    """Events with an identifier of their time (and hub)."""
    h = F.pmod(F.col(hub).cast("long"), F.lit(4096)) if hub else F.lit(0)
    return events.withColumn(into, native.time_id(F.unix_micros(F.to_timestamp(ts)), h, realm))


def tumbling_counts(events: DataFrame, ts: str, by: str, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Events and different contents in each window: start, by, n."""
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sliding_counts(events: DataFrame, ts: str, by: str, width: str = "1 hour", slide: str = "30 minutes", late: str | None = None) -> DataFrame:
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.window(ts, width, slide).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sessions(events: DataFrame, ts: str, by: str, gap: str = "10 minutes", late: str | None = None) -> DataFrame:
    """Runs of events without a longer pause: by, start, stop, n."""
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(by, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def first_seen(events: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """A stream without events whose keys came within the watermark before."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
