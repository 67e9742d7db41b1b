"""Event time, windows and joins on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions.scalars import MINUTE_MS, minute_floor
from clickloom.operators.enrich import enrich, home_funnel_filter
from clickloom.operators.slices import prefix_max
from clickloom.operators.windows import COUNTERS, funnel_counters

DISORDER_MS = 10_000


def with_event_time(df: DataFrame, delay: str | None = "10 seconds") -> DataFrame:
    """Add ``event_time`` from ``ts``; without a delay no watermark is declared."""
    timed = df.withColumn("event_time", F.timestamp_millis("ts"))
    return timed if delay is None else timed.withWatermark("event_time", delay)


def enrich_stream(behavior: DataFrame, dim_user: DataFrame | None, dim_item: DataFrame | None) -> DataFrame:
    """Stream-static joins; the file list of a dimension is fixed when its frame is built.

    ``jobs.start_enriched`` reads the dimensions anew for every micro-batch.
    """
    return enrich(behavior, dim_user, dim_item)


def tumbling_minute(dwd: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """The home funnel per user, category and minute, emitted once when the watermark passes."""
    rows = home_funnel_filter(with_event_time(dwd, delay))
    out = rows.groupBy(F.window("event_time", "1 minute"), "uid", "category_id").agg(*funnel_counters())
    return out.select(
        F.col("uid").alias("user_id"),
        "category_id",
        F.unix_millis("window.start").alias("window_start"),
        F.unix_millis("window.end").alias("window_end"),
        *COUNTERS,
    )


def flag_late(
    df: DataFrame,
    delay_ms: int = DISORDER_MS,
    window_ms: int = MINUTE_MS,
    slice_rows: int = 1 << 20,
    seen_before: int | None = None,
    out: str = "late",
) -> DataFrame:
    """Add ``out``: whether the row's window ended at or before the newest ts that arrived earlier, minus the delay.

    ``seen_before`` is the newest ts of rows that arrived before all of ``df``.
    """
    seen = prefix_max(df, "arrival", "ts", "_seen", slice_rows)
    newest = F.greatest("_seen", F.lit(seen_before).cast("long"))
    window_end = minute_floor("ts") if window_ms == MINUTE_MS else F.col("ts") - F.pmod("ts", F.lit(window_ms))
    late = F.coalesce(window_end + window_ms <= newest - delay_ms, F.lit(False))
    return seen.withColumn(out, late).drop("_seen")


def split_late(
    df: DataFrame, delay_ms: int = DISORDER_MS, window_ms: int = MINUTE_MS, slice_rows: int = 1 << 20
) -> tuple[DataFrame, DataFrame]:
    """(on time, late) rows of a bounded input; ``jobs.start_late_split`` does the same on a running stream."""
    flagged = flag_late(df, delay_ms, window_ms, slice_rows, out="_late")
    return flagged.where(~F.col("_late")).drop("_late"), flagged.where("_late").drop("_late")
