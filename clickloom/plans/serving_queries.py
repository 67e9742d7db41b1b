"""Registered queries: bundles, recommendation, snapshots, lineage, diagnosis, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.functions import scalars as S
from clickloom.operators import bundle, candidates, cumulative, diagnose, enrich, feedback, olap, rule, snapshots
from clickloom.operators import sequences, sliding
from clickloom.plans import event_queries as E
from clickloom.plans import serving
from clickloom.plans.oracle_views import VIEWS
from clickloom.plans.registry import query
from clickloom.session import work_path
from clickloom.sources import tables, views

AS_OF_MS = views.REQUEST_TS_MS

VIEWS["user_feature"] = E.USER_FEATURES_SQL
VIEWS["item_feature"] = E.ITEM_FEATURES_SQL
VIEWS["user_stat"] = E._latest_sql("uid")
VIEWS["item_stat"] = E._latest_sql("item_id")
VIEWS["cross_cat"] = E._decay_sql("category_id", ("pv", "click", "cart", "fav", "buy"), digits=12)
VIEWS["user_item"] = f"""SELECT * FROM ({E.FUNNEL_SQL})
    QUALIFY row_number() OVER (PARTITION BY user_id, category_id ORDER BY window_start DESC) = 1"""
VIEWS["seqs"] = """
SELECT kind, uid, item, ts, row_number() OVER (PARTITION BY kind, uid ORDER BY ts DESC, item DESC) AS rank
FROM (SELECT kind, uid, ext_item_id AS item, max(ts) AS ts FROM dwd
      WHERE kind IN ('click', 'cart', 'buy') AND ext_item_id IS NOT NULL GROUP BY ALL)
QUALIFY rank <= CASE kind WHEN 'click' THEN 50 WHEN 'cart' THEN 30 ELSE 20 END"""
VIEWS["history"] = """
SELECT r.req_id, r.uid, r.top_k, h.item AS item_id, row_number() OVER (PARTITION BY r.req_id ORDER BY h.o) - 1 AS place
FROM requests r JOIN (
  SELECT uid, item, min(CASE kind WHEN 'click' THEN 0 WHEN 'cart' THEN 20 ELSE 40 END + rank - 1) AS o
  FROM seqs WHERE rank <= 20 GROUP BY uid, item) h ON r.uid = h.uid"""
VIEWS["ring"] = """
SELECT item_id, row_number() OVER (ORDER BY md5('pool|' || item_id), item_id) - 1 AS idx, count(*) OVER () AS size
FROM dim_item"""
VIEWS["pool"] = """
SELECT req_id, uid, top_k, item_id, place FROM history WHERE place < top_k * 5
UNION ALL
SELECT req_id, uid, top_k, item_id, have + n AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY step) - 1 AS n FROM (
    SELECT s.req_id, s.uid, s.top_k, s.have, s.step, ring.item_id FROM (
      SELECT r.req_id, r.uid, r.top_k, coalesce(h.have, 0) AS have, g.step,
             (('0x' || substr(md5('pool|' || r.uid), 1, 15))::BIGINT + g.step) % (SELECT count(*) FROM dim_item) AS idx
      FROM requests r LEFT JOIN (SELECT req_id, count(*) AS have FROM history GROUP BY req_id) h ON r.req_id = h.req_id,
           range(50) g(step)) s
    JOIN ring ON s.idx = ring.idx
    ANTI JOIN history h ON h.req_id = s.req_id AND h.item_id = ring.item_id))
WHERE n < top_k * 5 - have"""
VIEWS["item_side"] = """
SELECT i.item_id, coalesce(f.total_detail_click, 0) AS i_total_detail_click, coalesce(f.total_buy, 0) AS i_total_buy,
  coalesce(f.total_cart, 0) AS i_total_cart, coalesce(f.total_fav, 0) AS i_total_fav, coalesce(f.uv, 0) AS i_uv,
  coalesce(f.conversion_rate, 0.0) AS i_conversion_rate,
  coalesce(CASE WHEN f.item_id IS NULL THEN d.category_id ELSE f.category_id END, 0) AS i_category_id,
  coalesce(CASE WHEN f.item_id IS NULL THEN d.brand ELSE f.item_brand END, '') AS i_brand,
  coalesce(CASE WHEN f.item_id IS NULL THEN d.price ELSE f.item_price END, 0.0) AS i_price,
  CAST(coalesce(s.click_5min, 0) AS DOUBLE) AS i_click_5min, CAST(coalesce(s.click_1h, 0) AS DOUBLE) AS i_click_1h
FROM (SELECT item_id FROM dim_item UNION SELECT item_id FROM item_feature UNION SELECT item_id FROM item_stat) i
LEFT JOIN item_feature f ON f.item_id = i.item_id LEFT JOIN dim_item d ON d.item_id = i.item_id
LEFT JOIN item_stat s ON s.item_id = i.item_id"""
VIEWS["bundles"] = """
SELECT p.req_id, p.uid, p.top_k, p.item_id, p.place, i.* EXCLUDE (item_id),
  coalesce(u.total_pv, 0) AS u_total_pv, coalesce(u.total_click, 0) AS u_total_click,
  coalesce(u.total_cart, 0) AS u_total_cart, coalesce(u.total_fav, 0) AS u_total_fav,
  coalesce(u.total_buy, 0) AS u_total_buy, coalesce(u.active_days, 0) AS u_active_days,
  coalesce(u.user_age, 0) AS u_age, coalesce(u.user_city, '') AS u_city, coalesce(u.user_level, 0) AS u_level,
  CAST(coalesce(s.click_5min, 0) AS DOUBLE) AS u_click_5min, CAST(coalesce(s.click_1h, 0) AS DOUBLE) AS u_click_1h,
  CAST(coalesce(s.pv_5min, 0) AS DOUBLE) AS u_pv_5min, CAST(coalesce(s.pv_1h, 0) AS DOUBLE) AS u_pv_1h,
  coalesce(x.pv_cnt, 0.0) AS x_pv_cnt, coalesce(x.click_cnt, 0.0) AS x_click_cnt,
  coalesce(x.cart_cnt, 0.0) AS x_cart_cnt, coalesce(x.buy_cnt, 0.0) AS x_buy_cnt,
  coalesce(w.show_count, 0) AS w_show_cnt, coalesce(w.click_count, 0) AS w_click_cnt,
  coalesce(w.cart_count, 0) AS w_cart_cnt, coalesce(w.buy_count, 0) AS w_buy_cnt,
  CAST(EXISTS (SELECT 1 FROM seqs q WHERE q.kind = 'click' AND q.rank <= 20 AND q.uid = p.uid AND q.item = p.item_id) AS DOUBLE) AS in_seq
FROM pool p JOIN item_side i ON i.item_id = p.item_id
LEFT JOIN user_feature u ON u.user_id = p.uid LEFT JOIN user_stat s ON s.uid = p.uid
LEFT JOIN cross_cat x ON x.uid = p.uid AND x.category_id = i.i_category_id
LEFT JOIN user_item w ON w.user_id = p.uid AND w.category_id = i.i_category_id"""
VIEWS["scored"] = """
SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY score DESC, place) AS rank FROM (
  SELECT *, CASE WHEN max(raw) OVER r > min(raw) OVER r
                 THEN (raw - min(raw) OVER r) / (max(raw) OVER r - min(raw) OVER r) ELSE 0.5 END AS score
  FROM (SELECT *, 0.0::DOUBLE + c1 + c2 + c3 + c4 + c5 AS raw FROM (
    SELECT *, 0.35::DOUBLE * least(i_conversion_rate, 1.0) AS c1, 0.25::DOUBLE * least(x_click_cnt / 10.0, 1.0) AS c2,
           0.20::DOUBLE * least(x_buy_cnt / 5.0, 1.0) AS c3, 0.10::DOUBLE * in_seq AS c4,
           0.10::DOUBLE * least(i_click_1h / 100.0, 1.0) AS c5 FROM bundles))
  WINDOW r AS (PARTITION BY req_id))"""
VIEWS["shares"] = """
SELECT *, round(coalesce(c1 / nullif(raw, 0), 0), 4) AS conversion_rate, round(coalesce(c2 / nullif(raw, 0), 0), 4) AS cross_click_cnt,
  round(coalesce(c3 / nullif(raw, 0), 0), 4) AS cross_buy_cnt, round(coalesce(c4 / nullif(raw, 0), 0), 4) AS in_click_seq,
  round(coalesce(c5 / nullif(raw, 0), 0), 4) AS item_click_1h FROM scored"""


def stored_dwd(spark, d):
    """The item-level rows as a table, for plans that read them many times."""
    return tables.store(E.dwd_of(spark, d), work_path(spark, "dwd"))


def tables_of(spark, d, dwd=None) -> serving.FeatureTables:
    dwd = stored_dwd(spark, d) if dwd is None else dwd
    raw = enrich.explode_shows(views.behavior(spark, d, "raw"))
    return serving.build_feature_tables(dwd, views.dim_item(spark, d), raw)


def pool_of(spark, d, t=None):
    if t is None:
        rows = enrich.explode_shows(views.behavior(spark, d))
        seqs = {n: sequences.sequence(rows, n) for n in candidates.SOURCES}
    else:
        seqs = t.sequences
    return candidates.candidate_pool(views.requests(spark, d), seqs, views.dim_item(spark, d))


def ranked_of(spark, d, dwd=None):
    return serving.rule_recommend(views.requests(spark, d), tables_of(spark, d, dwd))


def shares(df, col="feature_contributions"):
    return [F.col(col)[n].alias(n) for n in rule.WEIGHTS]


SHARE_COLUMNS = ", ".join(rule.WEIGHTS)
BUNDLE_COLUMNS = [
    *[f"i_{c}" for c in (*bundle.ITEM_COUNTS, "conversion_rate", "category_id", "brand", "price", *bundle.ITEM_STATS)],
    *[f"u_{c}" for c in (*bundle.USER_COUNTS, "age", "city", "level", *bundle.USER_STATS)],
    *[f"x_{c}" for c in bundle.CROSS],
    *[f"w_{c}_cnt" for c in bundle.WINDOW],
]
ROUNDED = {"i_conversion_rate", *[f"x_{c}" for c in bundle.CROSS]}


@query("candidate_pool", "SELECT req_id, uid, place, item_id FROM pool")
def candidate_pool(spark, d):
    return pool_of(spark, d).select("req_id", "uid", F.col("place").cast("long").alias("place"), "item_id")


@query(
    "assemble_bundle",
    "SELECT req_id, uid, item_id, "
    + ", ".join(f"round({c}, 6) AS {c}" if c in ROUNDED else c for c in BUNDLE_COLUMNS)
    + " FROM bundles",
)
def assemble_bundle(spark, d):
    t = tables_of(spark, d)
    out = serving.with_bundle(pool_of(spark, d, t), t)
    return out.select(
        "req_id", "uid", "item_id", *[F.round(c, 6).alias(c) if c in ROUNDED else F.col(c) for c in BUNDLE_COLUMNS]
    )


@query(
    "cold_item_fallback",
    "SELECT item_id, i_category_id, i_brand, i_price, i_total_buy, round(i_conversion_rate, 6) AS i_conversion_rate FROM item_side",
)
def cold_item_fallback(spark, d):
    dwd, dim = E.dwd_of(spark, d), views.dim_item(spark, d)
    feats = cumulative.item_features(dwd)
    stat = sliding.latest_stat(dwd, ["item_id"])
    ids = dim.select("item_id").union(dwd.where("item_id IS NOT NULL").select("item_id")).distinct()
    out = bundle.cold_item_fallback(ids, feats, stat, dim)
    return out.select(
        "item_id", "i_category_id", "i_brand", "i_price", "i_total_buy", F.round("i_conversion_rate", 6).alias("i_conversion_rate")
    )


@query(
    "user_lookup",
    """SELECT r.req_id, r.uid, u.total_click, u.active_days, coalesce(q.sequence, '') AS sequence
    FROM requests r LEFT JOIN user_feature u ON u.user_id = r.uid
    LEFT JOIN (SELECT uid, string_agg(item, ',' ORDER BY rank) AS sequence FROM seqs WHERE kind = 'click' GROUP BY uid) q
      ON q.uid = r.uid""",
)
def user_lookup(spark, d):
    dwd = E.dwd_of(spark, d)
    out = bundle.user_lookup(views.requests(spark, d), cumulative.user_features(dwd), sequences.sequence(dwd, "click"))
    return out.select("req_id", "uid", "total_click", "active_days", F.array_join("sequence", ",").alias("sequence"))


@query("rule_score", f"SELECT req_id, item_id, round(raw, 6) AS score, {SHARE_COLUMNS} FROM shares")
def rule_score(spark, d):
    t = tables_of(spark, d)
    clicks = t.sequences["click"].select(
        F.col("key").alias("uid"), F.transform(F.slice("members", 1, 20), lambda m: m["member"]).alias("click_seq")
    )
    bundles = serving.with_bundle(pool_of(spark, d, t), t).join(clicks, "uid", "left")
    out = rule.rule_score(bundles.withColumn("in_seq", rule.in_click_seq()))
    return out.select("req_id", "item_id", F.round("score", 6).alias("score"), *shares(out))


@query(
    "rule_recommend",
    f"""SELECT req_id, uid, item_id, rank, round(score, 6) AS score, {SHARE_COLUMNS}, i_brand AS item_brand,
    i_price AS item_price, i_category_id AS category_id FROM shares WHERE rank <= top_k""",
)
def rule_recommend(spark, d):
    out = ranked_of(spark, d).where("rank <= top_k")
    return out.select(
        "req_id", "uid", "item_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), *shares(out),
        F.col("i_brand").alias("item_brand"), F.col("i_price").alias("item_price"), F.col("i_category_id").alias("category_id"),
    )


@query(
    "minmax_normalise",
    """SELECT req_id, uid, item_id, CASE WHEN max(p) OVER r > min(p) OVER r
       THEN round((p - min(p) OVER r) / (max(p) OVER r - min(p) OVER r), 6) ELSE 0.5 END AS score
    FROM (SELECT pool.*, dim_item.price AS p FROM pool JOIN dim_item USING (item_id)) WINDOW r AS (PARTITION BY req_id)""",
)
def minmax_normalise(spark, d):
    priced = pool_of(spark, d).join(views.dim_item(spark, d).select("item_id", "price"), "item_id")
    out = rule.minmax_normalise(priced.withColumn("score", F.col("price")))
    return out.select("req_id", "uid", "item_id", F.round("score", 6).alias("score"))


@query(
    "recommend_rank",
    """SELECT req_id, item_id, row_number() OVER (PARTITION BY req_id ORDER BY category_id DESC, place) AS rank
    FROM pool JOIN dim_item USING (item_id)""",
)
def recommend_rank(spark, d):
    priced = pool_of(spark, d).join(views.dim_item(spark, d).select("item_id", "category_id"), "item_id")
    out = rule.recommend_rank(priced, score="category_id")
    return out.select("req_id", "item_id", F.col("rank").cast("long").alias("rank"))


@query(
    "top_feature",
    """SELECT req_id, item_id, CASE greatest(conversion_rate, cross_click_cnt, cross_buy_cnt, in_click_seq, item_click_1h)
      WHEN conversion_rate THEN 'conversion_rate' WHEN cross_click_cnt THEN 'cross_click_cnt'
      WHEN cross_buy_cnt THEN 'cross_buy_cnt' WHEN in_click_seq THEN 'in_click_seq' ELSE 'item_click_1h' END AS top_feature
    FROM shares WHERE rank <= top_k""",
)
def top_feature(spark, d):
    out = ranked_of(spark, d).where("rank <= top_k")
    return out.select("req_id", "item_id", rule.top_feature().alias("top_feature"))


@query(
    "rank_change",
    """WITH b AS (SELECT uid, item_id, row_number() OVER (PARTITION BY req_id ORDER BY place) AS rank FROM pool
      QUALIFY rank <= 10),
    a AS (SELECT uid, item_id, row_number() OVER (PARTITION BY req_id ORDER BY category_id DESC, place) AS rank
      FROM pool JOIN dim_item USING (item_id) QUALIFY rank <= 10)
    SELECT coalesce(a.uid, b.uid) AS uid, bool_or(a.item_id IS DISTINCT FROM b.item_id) AS changed,
      count(*) FILTER (a.item_id IS DISTINCT FROM b.item_id) AS n_changed
    FROM b FULL JOIN a ON a.uid = b.uid AND a.rank = b.rank GROUP BY 1""",
)
def rank_change(spark, d):
    pool = pool_of(spark, d)
    priced = pool.join(views.dim_item(spark, d).select("item_id", "category_id"), "item_id")
    before = pool.select("uid", (F.col("place") + 1).alias("rank"), "item_id").where("rank <= 10")
    after = rule.recommend_rank(priced, score="category_id").where("rank <= 10").select("uid", "rank", "item_id")
    return rule.rank_change(before, after)


# ---- snapshots, lineage, diagnosis ------------------------------------------

def snapshots_of(spark, d, dwd=None):
    built = snapshots.build_snapshots(ranked_of(spark, d, dwd), views.requests(spark, d))
    return tables.store(built, work_path(spark, "snapshots"))


@query(
    "write_snapshot",
    """SELECT s.req_id, any_value(s.uid) AS uid, any_value(r.ts) AS ts, any_value(r.ts) + 86400000 AS expires_at,
      CAST(CAST(make_timestamp(any_value(r.ts) * 1000) AS DATE) AS VARCHAR) AS day,
      string_agg(item_id, ',' ORDER BY place) AS candidates,
      string_agg(CASE WHEN rank <= s.top_k THEN item_id || '=' || printf('%.6f', round(score, 6)) END, ',' ORDER BY rank) AS served,
      any_value(u_total_pv) AS total_pv
    FROM scored s JOIN requests r ON r.req_id = s.req_id GROUP BY s.req_id""",
)
def write_snapshot(spark, d):
    """Snapshots through their day-partitioned writer and back."""
    path = work_path(spark, "snapshots")
    snapshots.write_snapshots(snapshots.build_snapshots(ranked_of(spark, d), views.requests(spark, d)), path)
    s = spark.read.parquet(path)
    served = F.transform("scores", lambda x: F.concat(x["item_id"], F.lit("="), F.format_string("%.6f", x["score"])))
    return s.select(
        "req_id", "uid", "ts", "expires_at", F.col("day").cast("string").alias("day"),
        F.array_join("candidates", ",").alias("candidates"), F.array_join(served, ",").alias("served"),
        F.col("user_features.total_pv").alias("total_pv"),
    )


@query(
    "snapshot_json",
    """SELECT req_id, any_value(uid) AS uid,
      '["' || string_agg(item_id, '","' ORDER BY place) || '"]' AS candidates_json FROM pool GROUP BY req_id""",
)
def snapshot_json(spark, d):
    out = snapshots.snapshot_json(snapshots_of(spark, d))
    return out.select("req_id", "uid", "candidates_json")


@query(
    "snapshot_lookup",
    f"""SELECT p.req_id, p.item_id, p.uid, r.ts, round(s.score, 6) AS score, s.conversion_rate, s.in_click_seq
    FROM pool p JOIN requests r ON r.req_id = p.req_id
    LEFT JOIN (SELECT * FROM shares WHERE rank <= top_k) s ON s.req_id = p.req_id AND s.item_id = p.item_id""",
)
def snapshot_lookup(spark, d):
    snaps = snapshots_of(spark, d)
    out = snapshots.snapshot_lookup(snaps.select("req_id", F.explode("candidates").alias("item_id")), snaps)
    return out.select(
        "req_id", "item_id", "uid", "ts", "score",
        F.col("feature_contributions")["conversion_rate"].alias("conversion_rate"),
        F.col("feature_contributions")["in_click_seq"].alias("in_click_seq"),
    )


@query(
    "lineage_trace",
    f"""WITH n AS (SELECT uid, string_agg(item, ',' ORDER BY rank) AS seq_items FROM seqs
        WHERE kind = 'click' AND rank <= 10 GROUP BY uid)
    SELECT p.uid, p.item_id, s.req_id, CASE WHEN s.req_id IS NOT NULL THEN r.ts END AS ts,
      s.conversion_rate, s.cross_click_cnt, coalesce(n.seq_items, '') AS seq_items
    FROM pool p JOIN requests r ON r.req_id = p.req_id
    LEFT JOIN (SELECT * FROM shares WHERE rank <= top_k) s ON s.uid = p.uid AND s.item_id = p.item_id
    LEFT JOIN n ON n.uid = p.uid""",
)
def lineage_trace(spark, d):
    snaps = snapshots_of(spark, d)
    # an older copy of every snapshot, which must lose against the newer one
    older = snaps.withColumns({"req_id": F.concat(F.lit("old_"), "req_id"), "ts": F.col("ts") - 3_600_000})
    clicks = sequences.sequence(enrich.explode_shows(views.behavior(spark, d)), "click")
    pairs = snaps.select("uid", F.explode("candidates").alias("item_id"))
    out = snapshots.lineage_trace(pairs, snaps.unionByName(older), clicks, AS_OF_MS)
    return out.select(
        "uid", "item_id", "req_id", "ts",
        F.col("contributing_features")["conversion_rate"].alias("conversion_rate"),
        F.col("contributing_features")["cross_click_cnt"].alias("cross_click_cnt"),
        F.array_join("seq_items", ",").alias("seq_items"),
    )


@query(
    "feature_freshness",
    f"""SELECT r.uid, u.update_ts, ({AS_OF_MS} - u.update_ts) // 1000 AS age_seconds,
      CASE WHEN u.update_ts IS NULL THEN 'unknown' WHEN ({AS_OF_MS} - u.update_ts) // 1000 < 600 THEN 'fresh' ELSE 'stale' END AS status
    FROM requests r LEFT JOIN user_feature u ON u.user_id = r.uid""",
)
def feature_freshness(spark, d):
    return diagnose.feature_freshness(views.requests(spark, d), cumulative.user_features(E.dwd_of(spark, d)), AS_OF_MS)


VIEWS["job_status"] = """
SELECT 'job_' || user_id AS name, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'FAILING' ELSE 'RUNNING' END AS state,
  ts_raw AS ts FROM ev"""
HEALTH_SQL = """SELECT count(*) AS total_jobs, count(*) FILTER (state = 'RUNNING') AS running,
  count(*) FILTER (state IN ('FAILED', 'FAILING')) AS failed FROM (SELECT name, max_by(state, ts) AS state FROM job_status GROUP BY name)"""


def job_status_of(spark, d):
    kind = F.col("event_type")
    return views.table(spark, d, "events").select(
        F.concat(F.lit("job_"), "user_id").alias("name"),
        F.when(kind == "error", "FAILED").when(kind == "signup", "FAILING").otherwise("RUNNING").alias("state"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"),
    )


@query("job_health", HEALTH_SQL)
def job_health(spark, d):
    return diagnose.job_health(job_status_of(spark, d))


@query(
    "health_colour",
    f"""SELECT r.uid, ['green', 'yellow', 'red'][greatest(
        CASE WHEN a.age < 300 THEN 1 WHEN a.age <= 1800 THEN 2 ELSE 3 END,
        CASE WHEN h.n > 10 THEN 1 WHEN h.n >= 1 THEN 2 ELSE 3 END)] AS colour
    FROM requests r LEFT JOIN (SELECT user_id, ({AS_OF_MS} - update_ts) // 1000 AS age FROM user_feature) a ON a.user_id = r.uid
    LEFT JOIN (SELECT uid, count(*) AS n FROM history GROUP BY uid) h ON h.uid = r.uid""",
)
def health_colour(spark, d):
    dwd = E.dwd_of(spark, d)
    req = views.requests(spark, d)
    fresh = diagnose.feature_freshness(req, cumulative.user_features(dwd), AS_OF_MS)
    seqs = {n: sequences.sequence(dwd, n) for n in candidates.SOURCES}
    n = candidates.history_candidates(req, seqs).groupBy("uid").agg(F.count(F.lit(1)).alias("n"))
    return fresh.join(n, "uid", "left").select("uid", diagnose.health_colour("age_seconds", "n").alias("colour"))


@query(
    "feature_sparsity",
    """WITH f AS (SELECT r.uid, u.user_id IS NOT NULL AS known,
      (total_pv <> 0)::INT + (total_click <> 0)::INT + (total_cart <> 0)::INT + (total_fav <> 0)::INT + (total_buy <> 0)::INT
       + (active_days <> 0)::INT + (user_age <> 0)::INT + (user_city <> '')::INT + (user_level <> 0)::INT + (update_ts <> 0)::INT AS nf,
      coalesce(q.n, 0) AS sl FROM requests r LEFT JOIN user_feature u ON u.user_id = r.uid
      LEFT JOIN (SELECT uid, count(*) AS n FROM seqs WHERE kind = 'click' GROUP BY uid) q ON q.uid = r.uid)
    SELECT uid, coalesce(nf, 0) AS n_fields, sl AS seq_length, sl < 5 AS cold,
      CASE WHEN coalesce(nf, 0) < 5 AND sl = 0 THEN 'cold_start' WHEN coalesce(nf, 0) < 5 THEN 'feature_lag' ELSE 'normal' END AS verdict
    FROM f""",
)
def feature_sparsity(spark, d):
    dwd = E.dwd_of(spark, d)
    out = diagnose.feature_sparsity(views.requests(spark, d), cumulative.user_features(dwd), sequences.sequence(dwd, "click"))
    return out


@query(
    "diagnose_chain",
    f"""SELECT r.req_id, r.uid, r.ts AS snapshot_ts, CAST(c.n AS INTEGER) AS n_candidates, c.top_item,
      s.req_id AS lineage_req_id, CAST(coalesce(q.n, 0) AS INTEGER) AS lineage_clicks,
      ({AS_OF_MS} - u.update_ts) // 1000 AS age_seconds,
      CASE WHEN u.update_ts IS NULL THEN 'unknown' WHEN ({AS_OF_MS} - u.update_ts) // 1000 < 600 THEN 'fresh' ELSE 'stale' END AS freshness,
      h.* FROM requests r JOIN (SELECT req_id, count(*) AS n, min_by(item_id, place) AS top_item FROM pool GROUP BY req_id) c
        ON c.req_id = r.req_id
    LEFT JOIN (SELECT * FROM scored WHERE rank <= top_k) s ON s.req_id = r.req_id AND s.item_id = c.top_item
    LEFT JOIN (SELECT uid, count(*) AS n FROM seqs WHERE kind = 'click' AND rank <= 10 GROUP BY uid) q ON q.uid = r.uid
    LEFT JOIN user_feature u ON u.user_id = r.uid, ({HEALTH_SQL}) h""",
)
def diagnose_chain(spark, d):
    dwd = stored_dwd(spark, d)
    return diagnose.diagnose_chain(
        views.requests(spark, d), snapshots_of(spark, d, dwd), sequences.sequence(dwd, "click"),
        cumulative.user_features(dwd), job_status_of(spark, d), AS_OF_MS,
    )


VIEWS["item_trace"] = """
SELECT 'req_' || uid AS req_id, 'I' || printf('%07d', item_id + 1) AS item_id, stage, filter_reason FROM (
  SELECT 'U' || printf('%06d', user_id + 1) AS uid, item_id, ['recall', 'rough', 'fine'][line % 3 + 1] AS stage,
    CASE item_id % 5 WHEN 0 THEN 'low_score' WHEN 1 THEN 'low_diversity' WHEN 2 THEN 'out_of_stock' WHEN 3 THEN 'recall_miss' END AS filter_reason
  FROM interactions)"""


@query(
    "item_not_shown",
    """WITH dropped AS (SELECT req_id, item_id, arg_max({'s': stage, 'r': filter_reason},
        (CASE stage WHEN 'recall' THEN '1' WHEN 'rough' THEN '2' ELSE '3' END) || filter_reason) AS d
      FROM item_trace WHERE filter_reason IS NOT NULL GROUP BY req_id, item_id),
    lookups AS (SELECT req_id, item_id FROM pool UNION SELECT req_id, item_id FROM item_trace)
    SELECT l.req_id, l.item_id, p.item_id IS NOT NULL AS in_candidates, coalesce(s.rank <= s.top_k, false) AS served,
      d.d.s AS dropped_at, d.d.r AS filter_reason,
      CASE WHEN coalesce(s.rank <= s.top_k, false) THEN 'shown' WHEN d.d IS NOT NULL THEN 'filtered_' || d.d.s
           WHEN p.item_id IS NOT NULL THEN 'ranked_out' ELSE 'not_recalled' END AS verdict
    FROM lookups l LEFT JOIN pool p ON p.req_id = l.req_id AND p.item_id = l.item_id
    LEFT JOIN scored s ON s.req_id = l.req_id AND s.item_id = l.item_id
    LEFT JOIN dropped d ON d.req_id = l.req_id AND d.item_id = l.item_id""",
)
def item_not_shown(spark, d):
    seen = views.interactions(spark, d)
    # the trace rows of a user's requests, with the item they are about
    stage = F.element_at(F.array(F.lit("recall"), F.lit("rough"), F.lit("fine")), F.col("line") % 3 + 1)
    reason = F.element_at(
        F.array(F.lit("low_score"), F.lit("low_diversity"), F.lit("out_of_stock"), F.lit("recall_miss"), F.lit(None).cast("string")),
        (F.col("item_id") % 5 + 1).cast("int"),
    )
    item_trace = seen.select(
        F.concat(F.lit("req_"), views.user_code(F.col("user_id") + 1)).alias("req_id"),
        views.item_code(F.col("item_id") + 1).alias("_item"), stage.alias("stage"), reason.alias("filter_reason"),
    ).withColumnRenamed("_item", "item_id")
    snaps = snapshots_of(spark, d)
    pool = snaps.select("req_id", F.explode("candidates").alias("item_id"))
    lookups = pool.union(item_trace.select("req_id", "item_id")).distinct()
    return snapshots.item_not_shown(lookups, snaps, item_trace)


# ---- feedback ---------------------------------------------------------------

VIEWS["injected"] = """
SELECT 'U' || printf('%06d', user_id + 1) AS uid, 'I' || printf('%07d', k + 1) AS item_id, ts_fast AS ts,
  CASE event_type WHEN 'view' THEN 'click' WHEN 'click' THEN 'fav' WHEN 'error' THEN 'cart' WHEN 'purchase' THEN 'buy' ELSE 'share' END AS bhv_type
FROM ev"""


def injected_of(spark, d):
    kind = F.col("event_type")
    ts = F.unix_millis(F.col("ts").cast("timestamp"))
    return views.table(spark, d, "events").select(
        views.user_code(F.col("user_id") + 1).alias("uid"),
        views.item_code(F.get_json_object("props", "$.k").cast("int") + 1).alias("item_id"),
        (F.lit(views.EPOCH_2024_MS) + F.floor((ts - views.EPOCH_2024_MS) / views.CLOCK_SQUEEZE)).cast("long").alias("ts"),
        F.when(kind == "view", "click").when(kind == "click", "fav").when(kind == "error", "cart")
        .when(kind == "purchase", "buy").otherwise("share").alias("bhv_type"),
    )


@query(
    "apply_events_to_items",
    """WITH d AS (SELECT item_id, count(*) FILTER (bhv_type = 'click') AS c, count(*) FILTER (bhv_type = 'fav') AS f,
      count(*) FILTER (bhv_type = 'cart') AS a, count(*) FILTER (bhv_type = 'buy') AS b FROM injected
      WHERE bhv_type <> 'share' GROUP BY item_id),
    m AS (SELECT coalesce(t.item_id, d.item_id) AS item_id, coalesce(total_detail_click, 0) + coalesce(c, 0) AS total_detail_click,
      coalesce(total_buy, 0) + coalesce(b, 0) AS total_buy, coalesce(total_cart, 0) + coalesce(a, 0) AS total_cart,
      coalesce(total_fav, 0) + coalesce(f, 0) AS total_fav, conversion_rate AS old_rate, coalesce(b, 0) AS bought
      FROM item_feature t FULL JOIN d ON d.item_id = t.item_id)
    SELECT item_id, total_detail_click, total_buy, total_cart, total_fav, round(CASE WHEN bought = 0 THEN old_rate
      WHEN total_detail_click = 0 THEN 0.0 ELSE CAST(total_buy AS DOUBLE) / total_detail_click END, 6) AS conversion_rate FROM m""",
)
def apply_events_to_items(spark, d):
    out = feedback.apply_to_items(cumulative.item_features(E.dwd_of(spark, d)), injected_of(spark, d))
    return out.select(
        "item_id", "total_detail_click", "total_buy", "total_cart", "total_fav", F.round("conversion_rate", 6).alias("conversion_rate")
    )


@query(
    "apply_events_to_features",
    """WITH d AS (SELECT uid, count(*) FILTER (bhv_type = 'click') AS c, count(*) FILTER (bhv_type = 'fav') AS f,
      count(*) FILTER (bhv_type = 'cart') AS a, count(*) FILTER (bhv_type = 'buy') AS b FROM injected WHERE bhv_type <> 'share' GROUP BY uid)
    SELECT coalesce(user_id, uid) AS user_id, coalesce(total_click, 0) + coalesce(c, 0) AS total_click,
      coalesce(total_cart, 0) + coalesce(a, 0) AS total_cart, coalesce(total_fav, 0) + coalesce(f, 0) AS total_fav,
      coalesce(total_buy, 0) + coalesce(b, 0) AS total_buy, total_pv
    FROM user_feature FULL JOIN d ON uid = user_id""",
)
def apply_events_to_features(spark, d):
    out = feedback.apply_to_users(cumulative.user_features(E.dwd_of(spark, d)), injected_of(spark, d))
    return out.select("user_id", "total_click", "total_cart", "total_fav", "total_buy", "total_pv")


@query(
    "apply_events_to_clicks",
    """WITH m AS (SELECT uid AS key, item AS member, max(ts) AS ts FROM (
        SELECT uid, item, ts FROM seqs WHERE kind = 'click'
        UNION ALL SELECT uid, item_id, ts FROM injected WHERE bhv_type = 'click') GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, member DESC) AS rank FROM m)
    SELECT key, string_agg(member || '@' || ts, ',' ORDER BY rank) AS members, count(*) AS n FROM r WHERE rank <= 50 GROUP BY key""",
)
def apply_events_to_clicks(spark, d):
    clicks = sequences.sequence(enrich.explode_shows(views.behavior(spark, d)), "click")
    return E.text_members(feedback.apply_to_clicks(clicks, injected_of(spark, d)))


# ---- reports ----------------------------------------------------------------

@query(
    "stage_counts",
    """WITH c AS (SELECT req_id, stage, filter_reason, count(*) AS n FROM ranking_trace GROUP BY ALL)
    SELECT req_id, stage, CAST(sum(n) AS BIGINT) AS item_count,
      coalesce(string_agg(filter_reason || ':' || n, ',' ORDER BY filter_reason), '') AS reasons FROM c GROUP BY req_id, stage""",
)
def stage_counts(spark, d):
    out = olap.stage_counts(views.ranking_trace(spark, d))
    text = F.transform("reasons", lambda r: F.concat(r["reason"], F.lit(":"), r["n"].cast("string")))
    return out.withColumn("reasons", F.array_join(text, ","))


TRACE_START, TRACE_END = 820_454_400, 978_307_200  # 1996-01-01 to 2001-01-01


@query(
    "filter_reason_stats",
    f"""SELECT uid, stage, filter_reason, cnt FROM (SELECT uid, stage, filter_reason, count(*) AS cnt FROM ranking_trace
      WHERE ts BETWEEN {TRACE_START} AND {TRACE_END} GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY uid ORDER BY cnt DESC, stage, filter_reason NULLS LAST) <= 50""",
)
def filter_reason_stats(spark, d):
    return olap.filter_reason_stats(views.ranking_trace(spark, d), TRACE_START, TRACE_END)


@query(
    "rec_quality",
    """SELECT uid, round(avg(click_label), 6) AS ctr, round(avg(engage_label), 6) AS engage_rate, round(avg(buy_label), 6) AS buy_rate,
      count(*) AS total_impressions FROM ranking_trace GROUP BY uid""",
)
def rec_quality(spark, d):
    out = olap.rec_quality(views.ranking_trace(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("ctr", "engage_rate", "buy_rate")})


@query(
    "rec_quality_overall",
    """SELECT round(avg(click_label), 6) AS ctr, round(avg(engage_label), 6) AS engage_rate, round(avg(buy_label), 6) AS buy_rate,
      count(*) AS total_impressions FROM ranking_trace""",
)
def rec_quality_overall(spark, d):
    out = olap.rec_quality(views.ranking_trace(spark, d), by=None)
    return out.withColumns({c: F.round(c, 6) for c in ("ctr", "engage_rate", "buy_rate")})


@query(
    "event_distribution",
    """SELECT bhv_page, bhv_type, coalesce(bhv_value, '-') AS bhv_value, count(*) AS cnt,
      round(count(*) / CAST((SELECT count(*) FROM behavior) AS DOUBLE), 6) AS share FROM behavior GROUP BY ALL""",
)
def event_distribution(spark, d):
    return olap.event_distribution(views.behavior(spark, d)).withColumn("share", F.round("share", 6))


@query(
    "funnel_rates",
    """SELECT round(count(*) FILTER (bhv_page = 'home' AND bhv_type = 'click') / CAST(sum(n_items) FILTER (bhv_page = 'home') AS DOUBLE), 6) AS home_ctr,
      round(count(*) FILTER (bhv_page = 'search' AND bhv_type = 'click') / CAST(sum(n_items) FILTER (bhv_page = 'search') AS DOUBLE), 6) AS search_ctr,
      round(count(*) FILTER (bhv_value = 'buy') / CAST(count(*) FILTER (bhv_value = 'cart') AS DOUBLE), 6) AS buy_cart_ratio,
      CAST(sum(n_items) FILTER (bhv_page = 'home') AS BIGINT) AS home_items,
      CAST(sum(n_items) FILTER (bhv_page = 'search') AS BIGINT) AS search_items FROM behavior""",
)
def funnel_rates(spark, d):
    out = olap.funnel_rates(views.behavior(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("home_ctr", "search_ctr", "buy_cart_ratio")})


@query(
    "hotspot_share",
    """WITH u AS (SELECT uid, count(*) AS n FROM behavior GROUP BY uid),
    i AS (SELECT item_id, count(*) AS n FROM exploded WHERE item_id IS NOT NULL GROUP BY item_id),
    ur AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS r FROM u), ir AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS r FROM i)
    SELECT 'user_top10' AS measure, CAST(sum(n) FILTER (r <= (SELECT count(*) FROM customer) // 10) AS BIGINT) AS top,
      CAST(sum(n) AS BIGINT) AS total,
      round(sum(n) FILTER (r <= (SELECT count(*) FROM customer) // 10) / CAST(sum(n) AS DOUBLE), 6) AS share FROM ur
    UNION ALL SELECT 'item_top20', CAST(sum(n) FILTER (r <= (SELECT count(*) FROM part) // 5) AS BIGINT), CAST(sum(n) AS BIGINT),
      round(sum(n) FILTER (r <= (SELECT count(*) FROM part) // 5) / CAST(sum(n) AS DOUBLE), 6) FROM ir""",
)
def hotspot_share(spark, d):
    n_users = views.table(spark, d, "customer").agg(F.count(F.lit(1))).scalar()
    n_items = views.table(spark, d, "part").agg(F.count(F.lit(1))).scalar()
    out = olap.hotspot_share(views.behavior(spark, d), n_users, n_items)
    return out.withColumn("share", F.round("share", 6))


def _stats_sql(key: str) -> str:
    p = key.removesuffix("_id")
    return f"""SELECT {key}, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {p}_{c}_last3m" for c in ("click", "cart", "buy", "forward"))}
    FROM interactions WHERE create_time > (SELECT max(create_time) FROM interactions) - INTERVAL 3 MONTH GROUP BY {key}"""


def _register_stats(name: str, key: str) -> None:
    @query(name, _stats_sql(key))
    def plan(spark, d):
        seen = views.interactions(spark, d)
        return olap.interaction_stats(seen, key, seen.agg(F.max("create_time")).scalar())


_register_stats("interaction_stats_3m", "item_id")
_register_stats("user_interaction_stats_3m", "user_id")


@query(
    "session_counts",
    """SELECT session_id, count(*) FILTER (role IN ('user', 'human')) AS turn_count,
      count(*) FILTER (role IN ('tool_call', 'function_call')) AS tool_call_count FROM sessions GROUP BY session_id""",
)
def session_counts(spark, d):
    return olap.session_counts(views.sessions(spark, d))


@query(
    "user_item_lists",
    """WITH p AS (SELECT user_id, item_id, count(*) AS n FROM interactions GROUP BY ALL)
    SELECT user_id, item_id // 1024 AS block, string_agg(item_id || 'x' || n, ',' ORDER BY item_id) AS items,
      CAST(sum(n) AS BIGINT) AS n_interactions FROM p GROUP BY 1, 2""",
)
def user_item_lists(spark, d):
    out = olap.user_item_lists(views.interactions(spark, d))
    text = F.transform("items", lambda i: F.concat(i["item_id"].cast("string"), F.lit("x"), i["n"].cast("string")))
    return out.withColumn("items", F.array_join(text, ","))


@query("active_users", "SELECT DISTINCT user_id FROM interactions")
def active_users(spark, d):
    return olap.active_users(views.interactions(spark, d))
