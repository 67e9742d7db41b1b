"""Exponentially decayed interest per user and category or brand.

A counter becomes ``c * exp(-ln2 * gap / half_life) + 1`` at each of its events.
By default all counters of one (user, entity) share a clock: the gap runs from
the previous counted event of any kind, and only the counter that is raised
decays. ``clock='per_counter'`` gives every counter a clock of its own.

With L the log-decay of each row and S its running sum within a kind, the
counter ends at ``sum(exp(S_k - S_n))``. That sum splits into slices, each
decayed by the total L of the slices after it; the gap from one slice to the
next counts for the kind whose event opens the slice.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.scalars import DAY_MS, event_kind, fixed_decimal
from clickloom.operators.slices import HOT_KEYS, HOT_ROWS, with_slice

ORDER = ["ts", "arrival", "pos"]
CATEGORY_KINDS = ("pv", "click", "cart", "fav", "buy")
BRAND_KINDS = ("click", "buy")
HALF_LIFE_DAYS = 7.0
CROSS_TTL_MS = 30 * DAY_MS


def decayed_counts(
    events: DataFrame,
    keys: Sequence[str],
    kinds: Sequence[str],
    half_life_days: float = HALF_LIFE_DAYS,
    clock: str = "shared",
    at_most: int = HOT_KEYS,
    min_rows: int = HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """``{kind}_cnt`` and ``last_ts`` per key; ``events`` has keys, ORDER and ``kind``."""
    keys = list(keys)
    rows = events.where(F.col("kind").isin(*kinds))
    rows = with_slice(rows, keys, at_most=at_most, min_rows=min_rows, hot=hot)
    clock_keys = keys if clock == "shared" else [*keys, "kind"]
    rate = math.log(2.0) / (half_life_days * DAY_MS)

    def log_decay(ts, prev):
        return F.coalesce(F.greatest(ts - prev, F.lit(0)).cast("double") * rate, F.lit(0.0))

    tick = Window.partitionBy(*clock_keys, "slice").orderBy(*ORDER)
    rows = rows.withColumn("_prev", F.lag("ts").over(tick)).withColumn("_l", log_decay(F.col("ts"), F.col("_prev")))

    part = Window.partitionBy(*keys, "slice", "kind")
    upto = part.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slices = (
        rows.withColumn("_s", F.sum("_l").over(upto))
        .withColumn("_end", F.max("_s").over(part))
        .groupBy(*keys, "kind", "slice")
        .agg(
            F.sum(F.exp(F.col("_s") - F.col("_end"))).alias("_part"),
            F.max("_end").alias("_inner"),
            F.max(F.when(F.col("_prev").isNull(), F.col("ts"))).alias("_opens"),
            F.max("ts").alias("_ts"),
        )
    )
    earlier = Window.partitionBy(*clock_keys).orderBy("slice").rangeBetween(Window.unboundedPreceding, -1)
    bridge = log_decay(F.col("_opens"), F.max("_ts").over(earlier))
    per_kind = Window.partitionBy(*keys, "kind")
    so_far = per_kind.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slices = (
        slices.withColumn("_len", F.col("_inner") + bridge)
        .withColumn("_pos", F.sum("_len").over(so_far))
        .withColumn("_after", F.max("_pos").over(per_kind) - F.col("_pos"))
    )
    value = F.col("_part") * F.exp(-F.col("_after"))
    return slices.groupBy(*keys).agg(
        *[
            F.sum(F.when(F.col("kind") == k, value).otherwise(0.0)).alias(f"{k}_cnt")
            for k in kinds
        ],
        F.max("_ts").alias("last_ts"),
    )


def decayed_cross_category(dwd: DataFrame, **options) -> DataFrame:
    events = dwd.where(F.col("uid").isNotNull()).select(
        "uid", "category_id", *ORDER, event_kind().alias("kind")
    )
    return decayed_counts(events, ["uid", "category_id"], CATEGORY_KINDS, **options)


def decayed_cross_brand(dwd: DataFrame, **options) -> DataFrame:
    events = dwd.where(F.col("uid").isNotNull()).select(
        "uid",
        F.coalesce("item_brand", F.lit("unknown")).alias("brand"),
        *ORDER,
        event_kind().alias("kind"),
    )
    return decayed_counts(events, ["uid", "brand"], BRAND_KINDS, **options)


def format_counters(cross: DataFrame) -> DataFrame:
    """Counters as four-decimal text; an absent one reads 0.0000."""
    counters = [c for c in cross.columns if c.endswith("_cnt")]
    return cross.withColumns({c: fixed_decimal(c, 4) for c in counters})
