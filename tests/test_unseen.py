"""Recommendations without the history move once, by user."""

import re

import pytest
from pyspark.sql import functions as F

from clickloom.operators import cf

PAIRS = "user_id long, item_id long, rating double, squares double"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_unseen_keeps_null_keys_and_null_ratings_and_drops_the_history(spark):
    lists = [(1, [7, 8, None], [1.0, 2.0, 4.0], 2.0), (1, [7, 9], [3.0, 1.0], 1.0), (None, [7], [1.0], 1.0), (2, [7, 8], [1.0, None], None)]
    lists = spark.createDataFrame(lists, "user_id long, items array<long>, parts array<double>, factor double")
    ratings = spark.createDataFrame([(1, 9, 1.0, 1.0), (1, None, 1.0, 1.0), (None, 7, 1.0, 1.0), (2, 7, 1.0, 1.0), (3, 5, None, 1.0)], PAIRS)
    out = cf.exclude_history(lists, ratings)
    got = {(r.user_id, r.item_id): r.score for r in out.collect()}
    assert got == {(1, 7): 5.0, (1, 8): 4.0, (1, None): 8.0, (None, 7): 1.0, (2, 8): None}


def test_lists_hold_every_rating_in_bounded_pieces(spark):
    rows = spark.range(3000).select((F.col("id") % 2).alias("user_id"), F.col("id").alias("item_id"), F.lit(1.0).alias("rating"))
    rows = cf.item_lists(rows, "who", per_list=100).collect()
    assert sorted(i for r in rows for i in r["items"]) == list(range(3000))
    assert len(rows) == 30 and max(len(r["items"]) for r in rows) < 200


@pytest.mark.parametrize("recommend", [cf.item_cf_recommend, cf.user_cf_recommend])
def test_scores_move_once(spark, recommend):
    seen = [(u, i, u * i, i, 0, 1 + (u + i) % 3) for u in range(6) for i in range(8) if (u * i + u) % 3]
    seen = spark.createDataFrame(seen, "user_id long, item_id long, create_time long, order_key long, line int, rating int")
    ends = re.findall(r"hashpartitioning\(user_id#\d+L?, item_id#\d+", _plan(recommend(seen)))
    assert not ends  # scores and history were dealt by (user, item) and then again by user
