"""Neighbourhood recommendation from co-occurrence.

Two members (items, or users) are similar through the groups (users, or items)
that hold both. ``partners`` finds the best of every member by bounds: no pair of
members is a row, and a group that holds everybody costs each member a few places.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.operators.partners import best_partners
from clickloom.operators.slices import first_n
from clickloom.session import materialise, work_path
from clickloom.sources.tables import store

NEIGHBOURS = 10
RECOMMENDED = 100
BLOCK = 256  # members of a group on one side of one join key
PAIRS_PER_TASK = 2_000_000  # products that one task adds up
LIST = 1_024  # items of a user that move as one row
HOT_CELLS = 100_000  # groups of a member whose partners one task adds up


def last_ratings(interactions: DataFrame) -> DataFrame:
    """(user_id, item_id, rating) with the last rating of a repeated pair."""
    order = F.struct("create_time", "order_key", "line", "rating")
    return interactions.groupBy("user_id", "item_id").agg(F.max(order).alias("_o")).select(
        "user_id", "item_id", F.col("_o.rating").cast("double").alias("rating")
    )


def stored_ratings(interactions: DataFrame) -> DataFrame:
    """``last_ratings`` with ``squares``, the sum over all ratings of the pair; read once and stored."""
    order = F.struct("create_time", "order_key", "line", "rating")
    r = F.col("rating").cast("double")
    pairs = interactions.groupBy("user_id", "item_id").agg(F.max(order).alias("_o"), F.sum(r * r).alias("squares"))
    return materialise(pairs.select("user_id", "item_id", F.col("_o.rating").cast("double").alias("rating"), "squares"))


def squared_norms(ratings: DataFrame) -> DataFrame:
    """Sum of squared ratings per item over all rows of ``stored_ratings``, repeated pairs included."""
    return ratings.groupBy(F.col("item_id").alias("member")).agg(F.sum("squares").alias("norm"))


def group_pairs(cells: DataFrame, block: int = BLOCK, per_task: int = PAIRS_PER_TASK, hot_cells: int = HOT_CELLS) -> DataFrame:
    """(a, b, dot) with a < b, over all groups of ``cells`` (grp, member, weight).

    The members of a group are packed into blocks and every block meets the group
    under its own join key, so a group of n members is spread over n / block keys.
    A member moves once per block with the list of its partners, not once per partner;
    a task adds up about ``per_task`` products, and a member of more than ``hot_cells`` groups is cut by partner.
    """
    spark = cells.sparkSession
    cells = store(cells.select("grp", "member", "weight"), work_path(spark, "cells"))
    counts = cells.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"))
    products = counts.agg(F.sum(F.col("_n").cast("double") * (F.col("_n") - 1) / 2)).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(products / per_task))
    sized = cells.join(counts.select("grp", F.ceil(F.col("_n") / block).cast("int").alias("_k")), "grp")
    blk = F.pmod(F.xxhash64("member"), F.col("_k")).cast("int")
    packs = sized.groupBy("grp", "_k", blk.alias("blk")).agg(F.array_sort(F.collect_list(F.struct("member", "weight"))).alias("_c"))
    left = packs.select("grp", "blk", F.col("_c.member").alias("of"), F.col("_c.weight").alias("of_weight"))
    right = packs.select(
        "grp",
        F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("blk"),
        F.col("_c.member").alias("b"),
        F.col("_c.weight").alias("wb"),
    )
    each = left.join(right, ["grp", "blk"]).select(F.posexplode("of").alias("_p", "a"), "of_weight", "b", "wb")
    each = each.select("a", F.get("of_weight", F.col("_p")).alias("wa"), F.filter("b", lambda x: x > F.col("a")).alias("b"), "wb")
    # members come in order, so the larger ones are the last of the list
    each = each.where(F.size("b") > 0).withColumn("wb", F.slice("wb", F.size("wb") - F.size("b") + 1, F.size("b")))
    hot = cells.groupBy(F.col("member").alias("a")).agg(F.ceil(F.count(F.lit(1)) / hot_cells).cast("int").alias("_cuts")).where("_cuts > 1")
    cut = each.join(F.broadcast(hot), "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("_cuts", F.lit(1)) - 1)))

    def mine(column: str) -> Column:
        at = lambda x, i: F.pmod(F.xxhash64(F.get("b", i)), F.col("_cuts")) == F.col("part")
        return F.when(F.col("_cuts").isNull(), F.col(column)).otherwise(F.filter(column, at))

    # new names: inside a lambda, a column named like an alias of the same select is that alias
    dealt = cut.select("a", "part", "wa", mine("b").alias("others"), mine("wb").alias("weights")).repartition(tasks, "a", "part")
    met = dealt.select("a", "part", "wa", "weights", F.posexplode("others").alias("_p", "b"))
    dots = met.groupBy("a", "part", "b").agg(F.sum(F.col("wa") * F.get("weights", F.col("_p"))).alias("dot"))
    return dots.select("a", "b", "dot")


def similarity(cells: DataFrame, norms: DataFrame, k: int = NEIGHBOURS, **options) -> DataFrame:
    """Top ``k`` partners per member: (member, other, sim, rank).

    ``cells`` is (grp, member, weight > 0), one row per pair; ``norms`` is
    (member, norm), and sim = dot / sqrt(norm_a * norm_b). Ties go to the
    smaller id. Weights are divided by their norm before members meet, so sums
    of products are similarities; ``options`` are those of ``partners.best_partners``.
    """
    known = cells.join(norms.where(F.col("norm") > 0), "member")
    unit = known.select("grp", "member", (F.col("weight") / F.sqrt("norm")).alias("weight"))
    return best_partners(unit, k, **options)


def item_cells(ratings: DataFrame) -> DataFrame:
    return ratings.where(F.col("rating") > 0).select(
        F.col("user_id").alias("grp"), F.col("item_id").alias("member"), F.col("rating").alias("weight")
    )


def user_cells(ratings: DataFrame) -> DataFrame:
    return ratings.select(F.col("item_id").alias("grp"), F.col("user_id").alias("member"), F.lit(1.0).alias("weight"))


def item_inputs(ratings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, norms) of the item side, from ``stored_ratings``."""
    return item_cells(ratings), squared_norms(ratings)


def user_inputs(ratings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, norms) of the user side: common items count, ratings play no part."""
    norms = ratings.groupBy(F.col("user_id").alias("member")).agg(F.count(F.lit(1)).cast("double").alias("norm"))
    return user_cells(ratings), norms


def as_item_sims(partners: DataFrame) -> DataFrame:
    return partners.select(F.col("member").alias("item_id"), F.col("other").alias("similar_item"), "sim", "rank")


def as_user_sims(partners: DataFrame) -> DataFrame:
    return partners.select(F.col("member").alias("user_id"), F.col("other").alias("similar_user"), "sim", "rank")


def item_cf_similarity(interactions: DataFrame, k: int = NEIGHBOURS, **options) -> DataFrame:
    """(item_id, similar_item, sim, rank) by rating cosine."""
    return _item_similarity(stored_ratings(interactions), k, **options)


def _item_similarity(ratings: DataFrame, k: int = NEIGHBOURS, **options) -> DataFrame:
    return as_item_sims(similarity(*item_inputs(ratings), k, **options))


def user_cf_similarity(interactions: DataFrame, k: int = NEIGHBOURS, ratings: DataFrame | None = None, **options) -> DataFrame:
    """(user_id, similar_user, sim, rank) by common items; ratings play no part. ``ratings`` are the stored ones, if there are."""
    return _user_similarity(stored_ratings(interactions) if ratings is None else ratings, k, **options)


def _user_similarity(seen: DataFrame, k: int = NEIGHBOURS, **options) -> DataFrame:
    return as_user_sims(similarity(*user_inputs(seen), k, **options))


def co_occurrence(interactions: DataFrame) -> DataFrame:
    """Unordered item pairs of a user with their summed rating products."""
    pairs = group_pairs(item_cells(last_ratings(interactions)))
    return pairs.select(F.col("a").alias("item_a"), F.col("b").alias("item_b"), F.col("dot").alias("weight"))


def _top(scores: DataFrame, n: int) -> DataFrame:
    return first_n(scores, ["user_id"], [F.round("score", 9).desc(), F.col("item_id")], n)


def item_lists(ratings: DataFrame, user: str, per_list: int = LIST) -> DataFrame:
    """(user, items, ratings): what a user rated, in lists of about ``per_list``."""
    counts = ratings.groupBy("user_id").agg(F.ceil(F.count(F.lit(1)) / per_list).cast("int").alias("_lists"))
    dealt = ratings.join(counts, "user_id").withColumn("_list", F.pmod(F.xxhash64("item_id"), F.col("_lists")))
    lists = dealt.groupBy("user_id", "_list").agg(F.collect_list(F.struct("item_id", "rating")).alias("_r"))
    return lists.select(F.col("user_id").alias(user), F.col("_r.item_id").alias("items"), F.col("_r.rating").alias("ratings"))


def exclude_history(scores: DataFrame, ratings: DataFrame) -> DataFrame:
    """Drop (user_id, item_id) the user already has.

    ``scores`` is one row per pair, or lists (user_id, items, parts, factor): the score of an item is then the sum of its
    parts times the list's factor. Lists and history move once, by user, and what follows stays there: sums,
    exclusion, and the ranks of ``_top``.
    """
    if "items" not in scores.columns:
        return scores.join(ratings.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    history = ratings.where("user_id is not null and item_id is not null").select(
        "user_id", F.array("item_id").alias("items"), F.lit(None).cast("array<double>").alias("parts"), F.lit(None).cast("double").alias("factor")
    )
    both = scores.select("user_id", "items", "parts", "factor").unionByName(history).repartition("user_id")
    rows = both.select("user_id", F.posexplode("items").alias("_p", "item_id"), "parts", "factor")
    part = F.get("parts", F.col("_p")) * F.col("factor")
    found = rows.groupBy("user_id", "item_id").agg(F.sum(part).alias("score"), F.max(F.col("parts").isNull()).alias("_seen"))
    return found.where("not _seen").drop("_seen")


def item_cf_recommend(interactions: DataFrame, sims: DataFrame | None = None, n: int = RECOMMENDED) -> DataFrame:
    """Sum of rating * sim over the user's items, without the items themselves, top ``n``."""
    ratings = stored_ratings(interactions)
    sims = _item_similarity(ratings) if sims is None else sims
    near = sims.groupBy("item_id").agg(F.collect_list(F.struct("similar_item", "sim")).alias("_near"))
    lists = ratings.join(near, "item_id").select(
        "user_id", F.col("_near.similar_item").alias("items"), F.col("_near.sim").alias("parts"), F.col("rating").alias("factor")
    )
    return _top(exclude_history(lists, ratings), n)


def lists_of_similar(sims: DataFrame, ratings: DataFrame) -> DataFrame:
    """(user_id, items, parts, factor): the lists of each similar user, weighted by the similarity."""
    near = sims.select("user_id", "similar_user", F.col("sim").alias("factor"))
    return near.join(item_lists(ratings, "similar_user"), "similar_user").withColumnRenamed("ratings", "parts")


def user_cf_recommend(interactions: DataFrame, sims: DataFrame | None = None, n: int = RECOMMENDED) -> DataFrame:
    """Sum of sim * rating over the similar users' items, without the user's own, top ``n``."""
    ratings = stored_ratings(interactions)
    sims = _user_similarity(ratings) if sims is None else sims
    return _top(exclude_history(lists_of_similar(sims, ratings), ratings), n)
