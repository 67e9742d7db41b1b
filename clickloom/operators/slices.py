"""Helpers that keep one hot key from becoming one big task.

Grouped aggregates need no help: Spark combines them before the shuffle. What
does need help are ordered windows over a key, running totals over a whole
table, and global row numbers. All three are done here in two levels, a local
pass per slice and a pass over one summary row per slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.session import materialise

# At most this many keys are treated as hot, so any other key holds less than
# 1/HOT_KEYS of all rows, and the keys to broadcast stay within a few megabytes.
HOT_KEYS = 200_000
# A key with fewer rows is never hot: one task can sort it comfortably.
HOT_ROWS = 2_000_000
# The rows of a hot key are cut into slices of this many milliseconds.
SLICE_MS = 1_000
# Distinct rows that one task holds at once.
DISTINCT_ROWS = 500_000


def hot_keys(df: DataFrame, keys: Sequence[str], at_most: int = HOT_KEYS, min_rows: int = HOT_ROWS) -> DataFrame:
    """The largest keys with more than ``min_rows`` rows, ``at_most`` of them.

    The limit is what makes the result safe to broadcast. Which keys are hot
    decides how the work is split, never what comes out of it.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > min_rows)
    return counts.orderBy(F.col("_n").desc(), *keys).limit(at_most).select(*keys, F.lit(True).alias("_hot"))


def with_slice(
    df: DataFrame,
    keys: Sequence[str],
    ts: str = "ts",
    at_most: int = HOT_KEYS,
    min_rows: int = HOT_ROWS,
    hot: DataFrame | None = None,
    slice_ms: int = SLICE_MS,
) -> DataFrame:
    """Add ``slice``: the number of the event's ``slice_ms`` for hot keys, 0 for all others.

    ``hot`` may bring the hot keys from a cheaper table than ``df``; any set of
    keys gives the same results.
    """
    hot = F.broadcast(hot_keys(df, keys, at_most, min_rows) if hot is None else hot)
    return (
        df.join(hot, list(keys), "left")
        .withColumn("slice", F.when(F.col("_hot"), F.floor(F.col(ts) / slice_ms)).otherwise(F.lit(0).cast("long")))
        .drop("_hot")
    )


def sliced_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column] | None = None,
    changes: dict[str, Column] | None = None,
    firsts: dict[str, Column] | None = None,
) -> DataFrame:
    """Inclusive running values per key over ``order``; ``df`` comes from ``with_slice``.

    * ``sums``: running sum;
    * ``changes``: how often a non-null value differed from the non-null value before it;
    * ``firsts``: the first non-null value so far.

    Each slice is scanned on its own. Its totals, its first and its last values
    make one summary row; what the earlier slices bring is computed over the
    summary rows and joined back. Keys with a single slice have no summary.
    """
    sums, changes, firsts = sums or {}, changes or {}, firsts or {}
    part = Window.partitionBy(*keys, "slice").orderBy(*order)
    before = part.rowsBetween(Window.unboundedPreceding, -1)
    upto = part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)

    rows = df.select(
        "*",
        *[c.cast("long").alias(f"_s_{n}") for n, c in sums.items()],
        *[c.alias(f"_v_{n}") for n, c in {**changes, **firsts}.items()],
    )
    rows = _with_change_flags(rows, changes, before)

    at = F.struct(*order)
    totals = [F.sum(f"_s_{n}").alias(f"_t_{n}") for n in [*sums, *changes]]
    firsts_of = [F.min_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), at)).alias(f"_f_{n}") for n in [*changes, *firsts]]
    lasts_of = [F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), at)).alias(f"_l_{n}") for n in changes]
    summary = rows.where(F.col("slice") != 0).groupBy(*keys, "slice").agg(*totals, *firsts_of, *lasts_of)
    # a slice that starts with the value the slice before ended with has one change less
    repeats = [
        F.coalesce((F.col(f"_f_{n}") == F.last(f"_l_{n}", ignorenulls=True).over(earlier)).cast("long"), F.lit(0)).alias(f"_r_{n}")
        for n in changes
    ]
    summary = summary.select("*", *repeats)
    carry = summary.select(
        *keys,
        "slice",
        *[F.sum(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in sums],
        *[F.sum(F.col(f"_t_{n}") - F.col(f"_r_{n}")).over(earlier).alias(f"_c_{n}") for n in changes],
        *[f"_r_{n}" for n in changes],
        *[F.first(f"_f_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in firsts],
    )

    rows = rows.select(
        "*",
        *[F.sum(f"_s_{n}").over(upto).alias(f"_u_{n}") for n in [*sums, *changes]],
        *[F.first(f"_v_{n}", ignorenulls=True).over(upto).alias(f"_u_{n}") for n in firsts],
    ).join(carry, [*keys, "slice"], "left")

    def zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    return rows.select(
        *df.columns,
        *[(F.col(f"_u_{n}") + zero(f"_c_{n}")).alias(n) for n in sums],
        *[
            (F.col(f"_u_{n}") + zero(f"_c_{n}") - F.when(F.col(f"_u_{n}") > 0, zero(f"_r_{n}")).otherwise(0)).alias(n)
            for n in changes
        ],
        *[F.coalesce(f"_c_{n}", f"_u_{n}").alias(n) for n in firsts],
    )


def _with_change_flags(rows: DataFrame, changes: dict[str, Column], before) -> DataFrame:
    """``_s_{n}`` = 1 where the value ``_v_{n}`` differs from the one before it in the slice."""
    if not changes:
        return rows
    rows = rows.select("*", *[F.last(f"_v_{n}", ignorenulls=True).over(before).alias(f"_p_{n}") for n in changes])
    flags = [
        (F.col(f"_v_{n}").isNotNull() & ~F.col(f"_v_{n}").eqNullSafe(F.col(f"_p_{n}"))).cast("long").alias(f"_s_{n}")
        for n in changes
    ]
    return rows.select("*", *flags)


def count_changes(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Per key the number of changes of ``value``, from slice summaries alone."""
    before = Window.partitionBy(*keys, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    rows = _with_change_flags(df.withColumn("_v_x", value), {"x": value}, before)
    at = F.when(F.col("_v_x").isNotNull(), F.struct(*order))
    summary = rows.groupBy(*keys, "slice").agg(
        F.sum("_s_x").alias("_t"), F.min_by("_v_x", at).alias("_f"), F.max_by("_v_x", at).alias("_l")
    )
    repeat = F.coalesce((F.col("_f") == F.last("_l", ignorenulls=True).over(earlier)).cast("long"), F.lit(0))
    return summary.withColumn("_r", repeat).groupBy(*keys).agg(F.sum(F.col("_t") - F.col("_r")).alias(out))


def prefix_max(
    df: DataFrame, order: str, value: str, out: str, slice_rows: int = 1 << 20
) -> DataFrame:
    """Maximum of ``value`` over all rows with a smaller ``order`` number.

    ``order`` must be a dense-ish arrival number. The only un-partitioned
    window runs over one row per ``slice_rows`` arrivals.
    """
    sliced = df.withColumn("_s", F.floor(F.col(order) / slice_rows))
    before = Window.partitionBy("_s").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    tops = (
        sliced.groupBy("_s")
        .agg(F.max(value).alias("_top"))
        .select("_s", F.max("_top").over(earlier).alias("_carry"))
    )
    return (
        sliced.withColumn("_local", F.max(value).over(before))
        .join(tops, "_s", "left")
        .withColumn(out, F.greatest("_local", "_carry"))
        .drop("_s", "_local", "_carry")
    )


def dense_index(df: DataFrame, order: Sequence[str], out: str = "idx") -> DataFrame:
    """Number the rows 0, 1, 2, … in the order of ``order`` (a unique key).

    Range-partitioned and sorted in parallel, then shifted by the row counts of
    the earlier partitions. The checkpoint pins the partition ids.
    """
    placed = materialise(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_p", F.spark_partition_id())
    )
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        placed.groupBy("_p")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    )
    return (
        placed.withColumn("_local", local)
        .join(shift, "_p")
        .withColumn(out, (F.col("_local") + F.col("_shift")).cast("long"))
        .drop("_p", "_local", "_shift")
    )


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "place", parts: int | None = None, kept: list[DataFrame] | None = None) -> DataFrame:
    """Number the rows of each key 0, 1, 2, … in ``order``, which has to tell them apart.

    Rows are sorted by range, so a hot key lies in several tasks; what its earlier tasks hold is added afterwards.
    The sorted rows are stored; ``kept`` takes them for a caller that stores the result and lets go of them.
    """
    by = [*keys, *order]
    dealt = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    placed = dealt.sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed.withColumn("_p", F.shiftright("_at", 33)))
    if kept is not None:
        kept.append(placed)
    parts = placed.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_low"))
    earlier = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.select(*keys, "_p", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_low")).alias("_shift"))
    return placed.join(shift, [*keys, "_p"]).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(out))


def distinct_rows(df: DataFrame, rows: int, per_task: int = DISTINCT_ROWS) -> DataFrame:
    """Distinct rows of ``df``, which has at most about ``rows`` of them; a task holds about ``per_task``, however many there are."""
    return df.repartition(max(1, -(-rows // per_task)), *df.columns).distinct()


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per key; Spark trims each map output to ``n`` first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)

