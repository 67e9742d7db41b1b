"""Adapter views: the given parquet tables read as behaviour and recommender tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.scalars import HOUR_MS

EPOCH_2024_MS = 1_704_067_200_000  # 2024-01-01 UTC, start of the event table
CLOCK_SQUEEZE = 96  # 30 days of events become 7.5 hours


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def padded(prefix: str, number: Column, width: int) -> Column:
    """``prefix`` and the number with at least ``width`` digits; longer numbers keep all of theirs."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0")))


def item_code(number: Column) -> Column:
    return padded("I", number, 7)


def user_code(number: Column) -> Column:
    return padded("U", number, 6)


def behavior_from_events(events: DataFrame, clock: str = "fast") -> DataFrame:
    """Behaviour events from the event table; also works on a stream of it.

    ``clock`` picks what becomes ``ts``: 'fast' (squeezed), 'raw', or 'late'
    (squeezed, with every 17th event 30 s behind).
    """
    event_id, user_id = F.col("event_id"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("int")
    e = events.select(
        event_id,
        user_id,
        "event_type",
        k.alias("k"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_raw"),
    )
    fast = F.lit(EPOCH_2024_MS) + F.floor((F.col("ts_raw") - EPOCH_2024_MS) / CLOCK_SQUEEZE).cast("long")
    late = F.when(event_id % 17 == 0, F.col("ts_fast") - 30_000).otherwise(F.col("ts_fast"))
    kind = F.col("event_type")
    is_show = kind.isin("view", "error")
    value = (
        F.when(kind == "purchase", "buy")
        .when((kind == "signup") & (event_id % 2 == 0), "fav")
        .when(kind == "signup", "cart")
    )
    shown = F.array(
        *[
            F.struct(
                item_code((F.col("k") + 7 * j) % 100 + 1).alias("item_id"),
                F.lit(j).cast("int").alias("position"),
            )
            for j in range(4)
        ]
    )
    page = (
        F.when(F.col("bhv_value").isNotNull(), "pdp")
        .when(event_id % 3 != 0, "home")
        .otherwise("search")
    )
    ext = F.struct(
        F.when(is_show, F.slice(shown, F.lit(1), (event_id % 5).cast("int"))).alias("items"),
        F.when(~is_show & (event_id % 101 != 0), item_code(F.col("k") + 1)).alias("item_id"),
        F.lit(None).cast("int").alias("position"),
        F.when(F.col("bhv_page") == "search", F.concat(F.lit("q"), F.col("k") % 12)).alias("query"),
    )
    hour = F.floor(F.col("ts_fast") / HOUR_MS).cast("long")
    e = (
        e.withColumn("ts_fast", fast)
        .withColumn("ts_late", late)
        .withColumn("bhv_value", value)
        .withColumn("bhv_page", page)
    )
    return e.select(
        user_code(user_id + 1).alias("uid"),
        F.concat(F.lit("log_"), event_id).alias("logid"),
        F.when(
            event_id % 97 != 0,
            F.concat(F.lit("req_"), user_id, F.lit("_"), hour - event_id % 2),
        ).alias("req_id"),
        F.when(is_show, "1001").when(F.col("bhv_value").isNull(), "2001").otherwise("3001").alias("bhv_id"),
        "bhv_page",
        F.when(F.col("bhv_value").isNull(), "direct")
        .when(event_id % 2 == 0, "home")
        .otherwise("search")
        .alias("bhv_src"),
        F.when(is_show, "show").otherwise("click").alias("bhv_type"),
        "bhv_value",
        F.col({"fast": "ts_fast", "raw": "ts_raw", "late": "ts_late"}[clock]).alias("ts"),
        ext.alias("bhv_ext"),
        event_id.alias("arrival"),
    )


def behavior(spark: SparkSession, sf_dir: str, clock: str = "fast") -> DataFrame:
    return behavior_from_events(table(spark, sf_dir, "events"), clock)


def dim_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        table(spark, sf_dir, "customer")
        .where(key % 23 != 0)
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            user_code(key + 1).alias("user_id"),
            F.when(key % 29 == 0, 0).otherwise((18 + key % 48).cast("int")).alias("age"),
            F.col("n_name").alias("city"),
            (1 + key % 5).cast("int").alias("level"),
        )
    )


def dim_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return (
        table(spark, sf_dir, "part")
        .where(key % 19 != 0)
        .select(
            item_code(key + 1).alias("item_id"),
            F.col("p_size").cast("int").alias("category_id"),
            F.col("p_brand").alias("brand"),
            F.col("p_retailprice").alias("price"),
        )
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    return table(spark, sf_dir, "part").select(
        key.alias("item_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("author"),
        F.concat(F.lit("C"), key % 10).alias("city"),
        F.col("p_type").alias("item_categories"),
        F.replace("p_name", F.lit(" "), F.lit(";")).alias("item_keywords"),
        F.col("p_retailprice").alias("price"),
        (start + F.make_dt_interval(mins=key.cast("int"))).alias("create_time"),
    )


# fixed values: the category and keyword texts of the part table, used to give
# users a taste
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
PART_WORDS = ["anvil", "blue", "bolt", "gear", "gizmo", "plate", "red", "ring", "widget"]


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")

    def pick(words: list[str], *steps: int) -> Column:
        texts = F.array(*[F.lit(w) for w in words])
        chosen = [F.element_at(texts, ((key * s + s) % len(words) + 1).cast("int")) for s in steps]
        return F.when(key % 31 == 0, "").otherwise(F.concat_ws(";", *chosen))

    return table(spark, sf_dir, "customer").select(
        key.alias("user_id"),
        F.when(key % 2 == 0, "f").otherwise("m").alias("gender"),
        (18 + key % 48).cast("int").alias("age"),
        pick(PART_TYPES, 1, 5).alias("user_categories"),
        pick(PART_WORDS, 1, 2).alias("user_keywords"),
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line; (create_time, order_key, line) is its order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"
    )
    flags = {
        "click": F.lit(1),
        "cart": (F.col("l_quantity") > 15).cast("int"),
        "forward": (F.col("l_returnflag") == "R").cast("int"),
        "buy": (F.col("l_linestatus") == "F").cast("int"),
    }
    day = F.dayofweek(F.col("o_orderdate").cast("date"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("o_orderdate").alias("create_time"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line"),
        (F.col("l_orderkey") % 24).cast("int").alias("hour"),
        day.isin(1, 7).cast("int").alias("is_weekend"),
        *[c.alias(n) for n, c in flags.items()],
        sum(flags.values(), F.lit(0)).cast("int").alias("rating"),
    )


def content_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")
    )


def ranking_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = interactions(spark, sf_dir)
    stage = F.element_at(
        F.array(F.lit("recall"), F.lit("rough"), F.lit("fine")), F.col("line") % 3 + 1
    )
    reasons = ["low_score", "low_diversity", "out_of_stock", "recall_miss"]
    place = F.col("item_id") % 5
    reason = F.when(place == 0, reasons[0])
    for i in (1, 2, 3):
        reason = reason.when(place == i, reasons[i])
    return seen.select(
        F.concat(F.lit("req_"), F.col("order_key")).alias("req_id"),
        user_code(F.col("user_id") + 1).alias("uid"),
        F.unix_seconds(F.col("create_time").cast("timestamp")).alias("ts"),
        stage.alias("stage"),
        reason.alias("filter_reason"),
        F.col("click").alias("click_label"),
        F.greatest("cart", "forward").alias("engage_label"),
        F.col("buy").alias("buy_label"),
    )


REQUEST_TS_MS = EPOCH_2024_MS + 9 * HOUR_MS


def requests(spark: SparkSession, sf_dir: str, top_k: int = 10) -> DataFrame:
    return dim_user(spark, sf_dir).select(
        F.concat(F.lit("req_"), F.col("user_id")).alias("req_id"),
        F.col("user_id").alias("uid"),
        F.lit(top_k).alias("top_k"),
        F.lit(REQUEST_TS_MS).cast("long").alias("ts"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), "turn", "role", "text"
    )
