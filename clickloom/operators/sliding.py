"""Counts over the last 5 minutes and the last hour, in one-minute buckets.

A bucket counts while its start is not older than the event minus the span, so
an event exactly on a minute sees one bucket more. The sums are built in two levels, so
a key that holds most events is never one sort:

* events are sorted by (key, time) in blocks, and a key may lie in several; inside a block a running count starts
  anew with every minute, and one row per (key, minute, block) carries what the earlier blocks counted in that minute;
* minutes are summed over spans inside one (key, hour), with the minutes of the hour before as border.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.scalars import MINUTE_MS, event_kind, minute_index
from clickloom.session import materialise

ORDER = ["ts", "arrival", "pos"]
SPANS = {"5min": 5, "1h": 60}
STAT_TTL_MS = 2 * 3_600_000


def _qualifying(dwd: DataFrame, keys: Sequence[str]) -> DataFrame:
    kind = event_kind()
    rows = dwd.withColumn("kind", kind).where(F.col("kind").isin("pv", "click"))
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return rows.select(
        *keys, *ORDER,
        (F.col("kind") == "pv").cast("long").alias("pv"),
        (F.col("kind") == "click").cast("long").alias("click"),
        minute_index("ts").alias("minute"),
    )


def _spans(minutes: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """(keys, minute, ``_{measure}_{span}_{edge}``): what the minutes before each minute of a key add to its spans."""
    hours = F.explode(F.array(F.lit(0), F.lit(1))).alias("_border")  # no span reaches further than the hour before
    hour = F.floor(F.col("minute") / 60)
    rows = minutes.select("*", hours).withColumn("_hour", hour + F.col("_border"))
    over = Window.partitionBy(*keys, "_hour").orderBy("minute")
    back = []
    for m in measures:
        for name, n in SPANS.items():
            for edge in (0, 1):
                frame = over.rangeBetween(-(n - 1 + edge), -1)
                back.append(F.coalesce(F.sum(m).over(frame), F.lit(0)).alias(f"_{m}_{name}_{edge}"))
    return rows.select(*keys, "minute", "_border", *back).where("_border = 0").drop("_border")


def sliding_stat(
    dwd: DataFrame, keys: Sequence[str], measures: Sequence[str] = ("pv", "click"), blocks: int | None = None
) -> DataFrame:
    """One row per qualifying event with ``{measure}_{span}`` counts; events are sorted in ``blocks`` blocks."""
    by = [*keys, *ORDER]
    rows = _qualifying(dwd, keys)
    rows = rows.repartitionByRange(blocks, *by) if blocks else rows.repartitionByRange(*by)
    rows = materialise(rows.withColumn("block", F.spark_partition_id()))
    place = [*keys, "minute", "block"]
    counted = rows.groupBy(*place).agg(*[F.sum(m).alias(m) for m in measures])
    sooner = Window.partitionBy(*keys, "minute").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = counted.select(*place, *[F.coalesce(F.sum(m).over(sooner), F.lit(0)).alias(f"_{m}_sooner") for m in measures])
    minutes = counted.groupBy(*keys, "minute").agg(*[F.sum(m).alias(m) for m in measures])
    carried = carried.join(_spans(minutes, keys, measures), [*keys, "minute"])
    here = Window.partitionBy(*place).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", *[F.sum(m).over(here).alias(f"_{m}_here") for m in measures])
    on_edge = F.col("ts") % MINUTE_MS == 0
    joined = rows.join(carried, place)
    return joined.select(
        *keys, *ORDER,
        *[
            (
                F.col(f"_{m}_here") + F.col(f"_{m}_sooner") + F.when(on_edge, F.col(f"_{m}_{s}_1")).otherwise(F.col(f"_{m}_{s}_0"))
            ).alias(f"{m}_{s}")
            for m in measures
            for s in SPANS
        ],
    )


def user_sliding_stat(dwd: DataFrame) -> DataFrame:
    return sliding_stat(dwd, ["uid"])


def user_category_click_stat(dwd: DataFrame) -> DataFrame:
    """Clicks per user and category; shows refresh the value without adding to it."""
    out = sliding_stat(dwd, ["uid", "category_id"], ["click"])
    return out.withColumnsRenamed({"click_5min": "cat_click_5min", "click_1h": "cat_click_1h"})


def item_sliding_stat(dwd: DataFrame) -> DataFrame:
    return sliding_stat(dwd, ["item_id"])


def latest_stat(
    dwd: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str] = ("pv", "click"),
    as_of_ms: Column | int | None = None,
) -> DataFrame:
    """The value at the key's last qualifying event, from minute buckets alone.

    The value does not age while the key is idle; with ``as_of_ms`` it expires
    two hours after that event.
    """
    buckets = _qualifying(dwd, keys).groupBy(*keys, "minute").agg(
        F.max("ts").alias("_ts"), *[F.sum(m).alias(m) for m in measures]
    )
    whole = Window.partitionBy(*keys)
    rows = buckets.withColumn("last_ts", F.max("_ts").over(whole))
    last_minute = minute_index("last_ts")
    edge = (F.col("last_ts") % MINUTE_MS == 0).cast("int")
    out = rows.groupBy(*keys, "last_ts").agg(
        *[
            F.sum(F.when(F.col("minute") >= last_minute - (n - 1) - edge, F.col(m)).otherwise(0)).alias(f"{m}_{s}")
            for m in measures
            for s, n in SPANS.items()
        ]
    )
    if as_of_ms is not None:
        out = out.where(F.col("last_ts") + STAT_TTL_MS >= as_of_ms)
    return out
