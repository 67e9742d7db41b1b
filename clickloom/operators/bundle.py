"""Feature bundles for (user, item) pairs, and per-user lookups.

The tables of one side are merged on their own key first, so a pair table of
any size is shuffled twice: by item and by user. Features of (user, category)
meet the pairs of their user, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.scalars import safe_double, safe_int

USER_COUNTS = ["total_pv", "total_click", "total_cart", "total_fav", "total_buy", "active_days"]
USER_STATS = ["click_5min", "click_1h", "pv_5min", "pv_1h"]
ITEM_COUNTS = ["total_detail_click", "total_buy", "total_cart", "total_fav", "uv"]
ITEM_STATS = ["click_5min", "click_1h"]
CROSS = ["pv_cnt", "click_cnt", "cart_cnt", "buy_cnt"]
WINDOW = ["show", "click", "cart", "buy"]


def _zero(c: Column | str, kind: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast(kind), F.lit(0).cast(kind))


def decode_user_feature(raw: DataFrame) -> DataFrame:
    """Typed user features from a table of text fields; bad text becomes the default."""
    return raw.select(
        "user_id",
        *[safe_int(c).cast("long").alias(c) for c in USER_COUNTS],
        safe_int("user_age").alias("user_age"),
        F.coalesce("user_city", F.lit("")).alias("user_city"),
        safe_int("user_level").alias("user_level"),
    )


def decode_item_feature(raw: DataFrame) -> DataFrame:
    return raw.select(
        "item_id",
        *[safe_int(c).cast("long").alias(c) for c in ITEM_COUNTS],
        safe_double("conversion_rate").alias("conversion_rate"),
        safe_int("category_id").alias("category_id"),
        F.coalesce("item_brand", F.lit("")).alias("item_brand"),
        safe_double("item_price").alias("item_price"),
    )


def user_side(user_feature: DataFrame, user_stat: DataFrame) -> DataFrame:
    stat = user_stat.select(F.col("uid").alias("_suid"), *[F.col(c).alias(f"_s_{c}") for c in USER_STATS])
    both = user_feature.join(stat, F.col("user_id") == F.col("_suid"), "full")
    return both.select(
        F.coalesce("user_id", "_suid").alias("_u"),
        *[_zero(c, "long").alias(f"u_{c}") for c in USER_COUNTS],
        _zero("user_age", "int").alias("u_age"),
        F.coalesce("user_city", F.lit("")).alias("u_city"),
        _zero("user_level", "int").alias("u_level"),
        *[_zero(f"_s_{c}", "double").alias(f"u_{c}") for c in USER_STATS],
    )


def item_side(item_feature: DataFrame, item_stat: DataFrame, dim_item: DataFrame) -> DataFrame:
    """Item features; an item without a feature row takes category, brand and price from the dimension."""
    feat = item_feature.withColumn("_has", F.lit(True))
    stat = item_stat.select(F.col("item_id").alias("_sid"), *[F.col(c).alias(f"_s_{c}") for c in ITEM_STATS])
    dim = dim_item.select(
        F.col("item_id").alias("_did"), F.col("category_id").alias("_dcat"),
        F.col("brand").alias("_dbrand"), F.col("price").alias("_dprice"),
    )
    both = feat.join(dim, F.col("item_id") == F.col("_did"), "full").withColumn("_i", F.coalesce("item_id", "_did"))
    both = both.join(stat, F.col("_i") == F.col("_sid"), "full")
    has = F.col("_has").eqNullSafe(True)

    def pick(own: str, dim_col: str) -> Column:
        return F.when(has, F.col(own)).otherwise(F.col(dim_col))

    return both.select(
        F.coalesce("_i", "_sid").alias("_item"),
        *[_zero(c, "long").alias(f"i_{c}") for c in ITEM_COUNTS],
        _zero("conversion_rate", "double").alias("i_conversion_rate"),
        _zero(pick("category_id", "_dcat"), "int").alias("i_category_id"),
        F.coalesce(pick("item_brand", "_dbrand"), F.lit("")).alias("i_brand"),
        _zero(pick("item_price", "_dprice"), "double").alias("i_price"),
        *[_zero(f"_s_{c}", "double").alias(f"i_{c}") for c in ITEM_STATS],
    )


def cross_side(cross: DataFrame, user_item_window: DataFrame) -> DataFrame:
    x = cross.select(
        F.col("uid").alias("_xu"), F.col("category_id").alias("_xc"), *[F.col(c).alias(f"x_{c}") for c in CROSS]
    )
    w = user_item_window.select(
        F.col("user_id").alias("_wu"), F.col("category_id").alias("_wc"),
        *[F.col(f"{c}_count").alias(f"w_{c}_cnt") for c in WINDOW],
    )
    both = x.join(w, (F.col("_xu") == F.col("_wu")) & (F.col("_xc") == F.col("_wc")), "full")
    return both.select(
        F.coalesce("_xu", "_wu").alias("_cu"),
        F.coalesce("_xc", "_wc").alias("_cc"),
        *[f"x_{c}" for c in CROSS],
        *[f"w_{c}_cnt" for c in WINDOW],
    )


def cold_item_fallback(
    items: DataFrame, item_feature: DataFrame, item_stat: DataFrame, dim_item: DataFrame
) -> DataFrame:
    """Item features for a list of item ids, zero where nothing is known."""
    side = item_side(item_feature, item_stat, dim_item)
    return _fill(items.join(side, F.col("item_id") == F.col("_item"), "left").drop("_item"))


def _fill(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    fills = {}
    for c, kind in kinds.items():
        if c.startswith(("u_", "i_", "x_", "w_")):
            fills[c] = F.coalesce(F.col(c), F.lit("") if kind == "string" else F.lit(0).cast(kind))
    return df.withColumns(fills) if fills else df


def assemble_bundle(
    pairs: DataFrame,
    user_feature: DataFrame,
    user_stat: DataFrame,
    item_feature: DataFrame,
    item_stat: DataFrame,
    dim_item: DataFrame,
    cross: DataFrame,
    user_item_window: DataFrame,
    tasks: int | None = None,
) -> DataFrame:
    """All features of each (uid, item_id); what is missing is 0 or ''.

    The category of the cross and window features is the item side's category.
    With ``tasks`` the pairs are dealt by user to that many, and stay so.
    """
    users = user_side(user_feature, user_stat)
    items = item_side(item_feature, item_stat, dim_item)
    crosses = cross_side(cross, user_item_window)
    out = pairs.join(items, F.col("item_id") == F.col("_item"), "left")
    out = out.withColumn("i_category_id", F.coalesce("i_category_id", F.lit(0)))
    out = out if tasks is None else out.repartition(tasks, "uid")
    out = out.join(users, F.col("uid") == F.col("_u"), "left")
    # the category is a condition inside the user, not a key: pairs dealt by user need not move again
    same = F.when(F.col("i_category_id") == F.col("_cc"), True).otherwise(False)
    out = out.join(crosses, (F.col("uid") == F.col("_cu")) & same, "left")
    return _fill(out.drop("_item", "_u", "_cu", "_cc"))


def user_lookup(requests: DataFrame, user_feature: DataFrame, click_seq: DataFrame) -> DataFrame:
    """The user row and the whole click sequence; an unknown user keeps the uid only."""
    seq = click_seq.select(F.col("key").alias("_k"), F.transform("members", lambda m: m["member"]).alias("sequence"))
    feats = user_feature.withColumnRenamed("user_id", "_u")
    return (
        requests.join(feats, F.col("uid") == F.col("_u"), "left")
        .join(seq, F.col("uid") == F.col("_k"), "left")
        .withColumn("sequence", F.coalesce("sequence", F.array().cast("array<string>")))
        .drop("_u", "_k")
    )
