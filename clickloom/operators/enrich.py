"""Behaviour events to item-level rows with user and item dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.scalars import derive_category

# fixed values: what a missing dimension field becomes
DEFAULT_AGE = 0
DEFAULT_CITY = "unknown"
DEFAULT_LEVEL = 1
DEFAULT_BRAND = "unknown"
DEFAULT_PRICE = 0.0

BASE = ["uid", "req_id", "bhv_id", "bhv_page", "bhv_src", "bhv_type", "bhv_value", "ts", "bhv_ext", "arrival"]


def passthrough_base(behavior: DataFrame) -> DataFrame:
    return behavior.select(*BASE)


def dedup_logid(behavior: DataFrame) -> DataFrame:
    """Opt-in: one row per log id."""
    return behavior.dropDuplicates(["logid"])


def resolve_click_item(ext: Column | str = "bhv_ext") -> Column:
    ext = F.col(ext) if isinstance(ext, str) else ext
    return F.nullif(ext["item_id"], F.lit(""))


def explode_shows(df: DataFrame) -> DataFrame:
    """One row per shown item; every other event, and a show without items, stays one row.

    Adds ``pos`` (place in the item list), ``item_id`` and ``category_id``, and
    slims ``bhv_ext`` of show rows to the query and the event position.
    """
    is_show = F.col("bhv_type").eqNullSafe("show")
    ext = F.col("bhv_ext")
    slim = F.struct(
        F.when(~is_show, ext["items"]).alias("items"),
        F.when(~is_show, ext["item_id"]).alias("item_id"),
        ext["position"].alias("position"),
        ext["query"].alias("query"),
    )
    rows = df.select("*", F.posexplode_outer(F.when(is_show, ext["items"])).alias("pos", "_shown"))
    return (
        rows.withColumn(
            "item_id",
            F.when(is_show, F.col("_shown.item_id")).otherwise(resolve_click_item()),
        )
        .withColumn("category_id", derive_category("item_id"))
        .withColumn("pos", F.coalesce("pos", F.lit(0)))
        .withColumn("bhv_ext", slim)
        .drop("_shown")
    )


def join_user_dim(df: DataFrame, dim_user: DataFrame | None) -> DataFrame:
    """Left join on uid; missing rows and fields take the defaults."""
    if dim_user is None:
        return df.withColumns(
            {
                "user_age": F.lit(DEFAULT_AGE),
                "user_city": F.lit(DEFAULT_CITY),
                "user_level": F.lit(DEFAULT_LEVEL),
            }
        )
    dim = dim_user.select(
        F.col("user_id").alias("_uid"),
        F.col("age").alias("_age"),
        F.col("city").alias("_city"),
        F.col("level").alias("_level"),
    )
    return (
        df.join(dim, F.col("uid") == F.col("_uid"), "left")
        .withColumns(
            {
                "user_age": F.coalesce("_age", F.lit(DEFAULT_AGE)),
                "user_city": F.coalesce("_city", F.lit(DEFAULT_CITY)),
                "user_level": F.coalesce("_level", F.lit(DEFAULT_LEVEL)),
            }
        )
        .drop("_uid", "_age", "_city", "_level")
    )


def needs_item_dim() -> Column:
    """Rows whose item is looked up: anything but a show, and shows on the home page."""
    is_show = F.col("bhv_type").eqNullSafe("show")
    at_home = F.col("bhv_page").eqNullSafe("home")
    return F.col("item_id").isNotNull() & (~is_show | at_home)


def join_item_dim(df: DataFrame, dim_item: DataFrame | None) -> DataFrame:
    """Left join for the rows of ``needs_item_dim``; the others get no brand.

    Rows that need no lookup carry a scattered key, so they do not all meet in
    one shuffle partition when the dimension is too large to broadcast.
    """
    if dim_item is None:
        is_show = F.col("bhv_type").eqNullSafe("show")
        return df.withColumns(
            {
                "item_brand": F.when(~is_show, F.lit(DEFAULT_BRAND)),
                "item_price": F.lit(DEFAULT_PRICE),
            }
        )
    wanted = needs_item_dim()
    scattered = F.concat(F.lit("~"), F.pmod(F.xxhash64("uid", "arrival", "pos"), F.lit(65_536)))
    dim = dim_item.select(
        F.col("item_id").alias("_iid"),
        F.col("brand").alias("_brand"),
        F.col("price").alias("_price"),
    )
    return (
        df.withColumn("_key", F.when(wanted, F.col("item_id")).otherwise(scattered))
        .join(dim, F.col("_key") == F.col("_iid"), "left")
        .withColumns(
            {
                "item_brand": F.when(wanted, F.coalesce("_brand", F.lit(DEFAULT_BRAND))),
                "item_price": F.coalesce(F.when(wanted, F.col("_price")), F.lit(DEFAULT_PRICE)),
            }
        )
        .drop("_key", "_iid", "_brand", "_price")
    )


def enrich(
    behavior: DataFrame, dim_user: DataFrame | None = None, dim_item: DataFrame | None = None
) -> DataFrame:
    """Item-level rows with both dimensions.

    The user is joined before the explode, once per event. Without dimensions
    this is the degraded form used when a lookup is not available.
    """
    with_user = join_user_dim(passthrough_base(behavior), dim_user)
    return join_item_dim(explode_shows(with_user), dim_item)


def home_funnel_filter(df: DataFrame) -> DataFrame:
    page, src = F.col("bhv_page"), F.col("bhv_src")
    return df.where((page == "home") | ((page == "pdp") & (src == "home")))


def search_query_filter(df: DataFrame) -> DataFrame:
    query = F.col("bhv_ext.query")
    return df.where((F.col("bhv_page") == "search") & query.isNotNull() & (query != ""))
