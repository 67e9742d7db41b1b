"""One-minute home funnel per user and category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.scalars import MINUTE_MS, minute_floor, ratio
from clickloom.operators.enrich import home_funnel_filter

COUNTERS = ["show_count", "click_count", "cart_count", "fav_count", "buy_count"]
WINDOW_TTL_MS = 600_000


def funnel_counters() -> list[Column]:
    """The five funnel counts as grouped aggregates."""
    at_home = F.col("bhv_page") == "home"
    click = F.col("bhv_type") == "click"
    value = F.col("bhv_value")
    return [
        F.count_if((F.col("bhv_type") == "show") & at_home).alias("show_count"),
        F.count_if(click & value.isNull() & at_home).alias("click_count"),
        *[F.count_if(click & (value == v)).alias(f"{v}_count") for v in ("cart", "fav", "buy")],
    ]


def home_funnel_window(dwd: DataFrame, rates: bool = False) -> DataFrame:
    """Funnel counts per (user, category, minute); a window without a hit stays, all zero."""
    out = (
        home_funnel_filter(dwd)
        .groupBy("uid", "category_id", minute_floor("ts").alias("window_start"))
        .agg(*funnel_counters())
        .select(
            F.col("uid").alias("user_id"),
            "category_id",
            "window_start",
            (F.col("window_start") + MINUTE_MS).alias("window_end"),
            *COUNTERS,
        )
    )
    if rates:
        out = out.withColumns(
            {
                "ctr": ratio("click_count", "show_count"),
                "ctb": ratio("buy_count", "click_count"),
                "cvr": ratio("buy_count", "show_count"),
            }
        )
    return out


def latest_window_feature(windows: DataFrame) -> DataFrame:
    """The last window of every (user, category)."""
    row = F.struct("window_start", "window_end", *COUNTERS)
    return windows.groupBy("user_id", "category_id").agg(F.max(row).alias("_w")).select(
        "user_id", "category_id", "_w.*"
    )
