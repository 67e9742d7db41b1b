"""Candidate pools: the user's own recent items, filled up from the item dimension."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.scalars import hash_number
from clickloom.operators.slices import dense_index

READ_LENGTH = 20
POOL_MULTIPLIER = 5
SOURCES = ("click", "cart", "buy")
ROWS_PER_TASK = 250_000  # pool rows that one task holds


def pool_tasks(requests: DataFrame, per_task: int = ROWS_PER_TASK) -> int:
    """Tasks for the pools of all requests: no fewer than the session's partitions, and more as the requests grow."""
    rows = requests.agg(F.sum(F.col("top_k").cast("double") * POOL_MULTIPLIER)).first()[0] or 0
    return max(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / per_task))


def history_candidates(requests: DataFrame, sequences: dict[str, DataFrame]) -> DataFrame:
    """(req_id, uid, place, item_id): newest clicks, then carts, then buys, first occurrence kept.

    At most 3 x 20 rows per request.
    """
    per_source = []
    for i, name in enumerate(SOURCES):
        newest = F.posexplode(F.slice("members", 1, READ_LENGTH)).alias("_p", "_m")
        rows = sequences[name].select(F.col("key").alias("_k"), newest)
        per_source.append(
            rows.select("_k", (F.lit(i) * READ_LENGTH + F.col("_p")).alias("_order"), F.col("_m.member").alias("item_id"))
        )
    mine = reduce(DataFrame.unionByName, per_source).groupBy("_k", "item_id").agg(F.min("_order").alias("_order"))
    joined = requests.join(mine, F.col("uid") == F.col("_k"))
    place = F.row_number().over(Window.partitionBy("req_id").orderBy("_order")) - 1
    return joined.select("req_id", "uid", "top_k", place.alias("place"), "item_id")


def candidate_pool(
    requests: DataFrame, sequences: dict[str, DataFrame], dim_item: DataFrame, seed: str = "pool"
) -> DataFrame:
    """``top_k * 5`` items per request, own history first.

    The rest comes from a ring of all dimension items in a seeded random order:
    every request starts at its own place and takes the next items that are not
    in its history. A pool of n never needs more than n ring items, so no
    request meets more than n + 60 items.
    """
    history = history_candidates(requests, sequences)
    ring = dense_index(
        dim_item.select("item_id", F.md5(F.concat_ws("|", F.lit(seed), "item_id")).alias("_h")), ["_h", "item_id"], "_idx"
    ).select("_idx", "item_id")
    size = ring.agg(F.count(F.lit(1))).scalar()
    target = F.col("top_k") * POOL_MULTIPLIER
    # each request becomes many rows, so spread the requests first; the number keeps
    # adaptive execution from folding them into one task for being small now
    tasks = pool_tasks(requests)
    start = requests.repartition(tasks, "req_id").select("req_id", "uid", "top_k", hash_number(F.lit(seed), "uid").alias("_start"), size.alias("_size"))
    steps = F.sequence(F.lit(0), F.least(target, F.col("_size")).cast("int") - 1)
    slots = start.where(F.col("_size") > 0).select(
        "req_id", "uid", "top_k", F.explode(steps).alias("_step"), "_start", "_size"
    )
    drawn = slots.withColumn("_idx", (F.col("_start") + F.col("_step")) % F.col("_size")).join(ring, "_idx")
    # history places come before all ring steps
    ordered = history.select("req_id", "uid", "top_k", "item_id", F.col("place").alias("_order")).unionByName(
        drawn.select("req_id", "uid", "top_k", "item_id", (F.col("_step") + len(SOURCES) * READ_LENGTH).alias("_order"))
    )
    # dealt once by request, for telling items apart and for numbering them
    dealt = ordered.repartition(tasks, "req_id")
    first = dealt.groupBy("req_id", "uid", "top_k", "item_id").agg(F.min("_order").alias("_order"))
    place = F.row_number().over(Window.partitionBy("req_id").orderBy("_order")) - 1
    return first.withColumn("place", place).drop("_order").where(F.col("place") < target)
