"""Training pairs: uniform negatives and history/random triples.

Draws come from md5 of the row's own key, so a re-run or a retried task gives
the same samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions.scalars import hash_number
from clickloom.operators.slices import dense_index

ROW_KEY = ("user_id", "item_id", "order_key", "line")


def item_index(items: DataFrame) -> DataFrame:
    """(idx, item_id) over the sorted distinct items."""
    return dense_index(items.select("item_id").distinct(), ["item_id"])


def sample_negatives(
    positives: DataFrame, items: DataFrame, n: int = 2, seed: str = "neg", join_features: DataFrame | None = None
) -> DataFrame:
    """Each positive (label 1) with ``n`` copies whose item is uniform random (label -1).

    A negative may equal its positive, and keeps the positive's other columns
    unless ``join_features`` brings the item's own.
    """
    index = item_index(items)
    size = index.agg(F.count(F.lit(1)))
    base = positives.withColumn("label", F.lit(1)).withColumn("draw", F.lit(0))
    drawn = positives.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw"))
    keys = [F.col(c) for c in ROW_KEY if c in positives.columns]
    drawn = drawn.withColumn("idx", hash_number(F.lit(seed), *keys, "draw") % size.scalar())
    negative = (
        drawn.withColumnRenamed("item_id", "_positive")
        .join(index, "idx")
        .drop("idx", "_positive")
        .withColumn("label", F.lit(-1))
    )
    out = base.unionByName(negative.select(*base.columns))
    if join_features is not None:
        own = [c for c in join_features.columns if c != "item_id"]
        out = out.drop(*[c for c in own if c in out.columns]).join(join_features, "item_id", "left")
    return out


def bpr_triples(interactions: DataFrame, items: DataFrame, batch_size: int | None = None, seed: str = "bpr") -> DataFrame:
    """``batch_size`` distinct users with history, or all of them: one own item and one item of all.

    The user sample and the own item are minima of a hash, so neither needs the
    history of a user in one place.
    """
    rows = interactions.select("user_id", "item_id", "order_key", "line")
    picked = rows.groupBy("user_id").agg(
        F.min(F.struct(F.md5(F.concat_ws("|", F.lit(seed), "user_id", "item_id", "order_key", "line")).alias("h"), "item_id")).alias("_p")
    )
    batch = picked.select("user_id", F.col("_p.item_id").alias("pos_item"))
    if batch_size is not None:
        batch = batch.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "user_id")), "user_id").limit(batch_size)
    index = item_index(items)
    size = index.agg(F.count(F.lit(1)))
    drawn = batch.withColumn("idx", hash_number(F.lit(seed), F.lit("n"), "user_id") % size.scalar())
    return drawn.join(index, "idx").select("user_id", "pos_item", F.col("item_id").alias("neg_item"))


