"""Explicit schemas of the event and feature tables."""

from pyspark.sql import types as T

SHOWN_ITEM = T.StructType(
    [T.StructField("item_id", T.StringType()), T.StructField("position", T.IntegerType())]
)

BEHAVIOR_EXT = T.StructType(
    [
        T.StructField("items", T.ArrayType(SHOWN_ITEM)),
        T.StructField("item_id", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("query", T.StringType()),
    ]
)

BEHAVIOR = T.StructType(
    [
        T.StructField("uid", T.StringType()),
        T.StructField("logid", T.StringType()),
        T.StructField("req_id", T.StringType()),
        T.StructField("bhv_id", T.StringType()),
        T.StructField("bhv_page", T.StringType()),
        T.StructField("bhv_src", T.StringType()),
        T.StructField("bhv_type", T.StringType()),
        T.StructField("bhv_value", T.StringType()),
        T.StructField("ts", T.LongType()),
        T.StructField("bhv_ext", BEHAVIOR_EXT),
        # position in the arrival order; breaks ties of ts
        T.StructField("arrival", T.LongType()),
    ]
)

BEHAVIOR_DIM = T.StructType(
    [f for f in BEHAVIOR.fields if f.name != "logid"]
    + [
        T.StructField("pos", T.IntegerType()),
        T.StructField("user_age", T.IntegerType()),
        T.StructField("user_city", T.StringType()),
        T.StructField("user_level", T.IntegerType()),
        T.StructField("item_id", T.StringType()),
        T.StructField("category_id", T.IntegerType()),
        T.StructField("item_brand", T.StringType()),
        T.StructField("item_price", T.DoubleType()),
    ]
)

DIM_USER = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("city", T.StringType()),
        T.StructField("level", T.IntegerType()),
    ]
)

DIM_ITEM = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("category_id", T.IntegerType()),
        T.StructField("brand", T.StringType()),
        T.StructField("price", T.DoubleType()),
    ]
)

ITEMS_CSV = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("item_categories", T.StringType()),
        T.StructField("item_keywords", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("create_time", T.TimestampNTZType()),
    ]
)

USERS_CSV = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("gender", T.StringType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("user_categories", T.StringType()),
        T.StructField("user_keywords", T.StringType()),
    ]
)

INTERACTIONS_CSV = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("rating", T.IntegerType()),
        T.StructField("create_time", T.TimestampNTZType()),
        T.StructField("hour", T.IntegerType()),
        T.StructField("is_weekend", T.IntegerType()),
        T.StructField("click", T.IntegerType()),
        T.StructField("cart", T.IntegerType()),
        T.StructField("forward", T.IntegerType()),
        T.StructField("buy", T.IntegerType()),
    ]
)

# who speaks in a conversation turn, under either naming
HUMAN_ROLES = ("user", "human")
ANSWER_ROLES = ("assistant", "gpt")
CALL_ROLES = ("tool_call", "function_call")
RESULT_ROLES = ("tool", "observation")
