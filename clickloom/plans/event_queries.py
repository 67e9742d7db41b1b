"""Registered queries: enrichment, windows, cumulative, sliding, decay, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions import scalars as S
from clickloom.operators import cumulative, decay, enrich, sequences, sliding, windows
from clickloom.plans.registry import query
from clickloom.sources import views

BASE_COLUMNS = ["uid", "req_id", "bhv_id", "bhv_page", "bhv_src", "bhv_type", "bhv_value", "ts"]


def dwd_of(spark: SparkSession, sf_dir: str, clock: str = "fast") -> DataFrame:
    return enrich.enrich(
        views.behavior(spark, sf_dir, clock), views.dim_user(spark, sf_dir), views.dim_item(spark, sf_dir)
    )


def flat(dwd: DataFrame) -> DataFrame:
    """The item-level row without nested columns."""
    return dwd.select(
        *BASE_COLUMNS, "arrival", "pos",
        F.col("bhv_ext.item_id").alias("ext_item_id"), F.col("bhv_ext.query").alias("query"),
        "user_age", "user_city", "user_level", "item_id", "category_id", "item_brand", "item_price",
    )


FLAT_SQL = """uid, req_id, bhv_id, bhv_page, bhv_src, bhv_type, bhv_value, ts, arrival, pos, ext_item_id, query,
 user_age, user_city, user_level, item_id, category_id, item_brand, item_price"""


# ---- projections and joins --------------------------------------------------

@query("explode_shows", "SELECT uid, arrival, pos, item_id, category_id FROM dwd")
def explode_shows(spark, d):
    return enrich.explode_shows(views.behavior(spark, d)).select("uid", "arrival", "pos", "item_id", "category_id")


@query(
    "slim_ext",
    """SELECT arrival, pos, query, ext_item_id,
       CAST(-1 AS INTEGER) AS n_items FROM dwd WHERE bhv_type = 'show'""",
)
def slim_ext(spark, d):
    rows = enrich.explode_shows(views.behavior(spark, d)).where("bhv_type = 'show'")
    return rows.select(
        "arrival", "pos", F.col("bhv_ext.query").alias("query"), F.col("bhv_ext.item_id").alias("ext_item_id"),
        F.coalesce(F.size("bhv_ext.items"), F.lit(-1)).alias("n_items"),
    )


@query("resolve_click_item", "SELECT arrival, ext_item_id AS item_id FROM behavior WHERE bhv_type <> 'show'")
def resolve_click_item(spark, d):
    rows = views.behavior(spark, d).where("bhv_type <> 'show'")
    return rows.select("arrival", enrich.resolve_click_item().alias("item_id"))


@query(
    "derive_category",
    """SELECT 'I' || printf('%07d', p_partkey) AS item_id,
       CAST((p_partkey - 1) % 50 + 1 AS INTEGER) AS category_id FROM part""",
)
def derive_category(spark, d):
    code = views.item_code(F.col("p_partkey")).alias("item_id")
    return views.table(spark, d, "part").select(code).withColumn("category_id", S.derive_category("item_id"))


@query(
    "passthrough_base",
    "SELECT uid, req_id, bhv_id, bhv_page, bhv_src, bhv_type, bhv_value, ts, arrival FROM behavior",
)
def passthrough_base(spark, d):
    return enrich.passthrough_base(views.behavior(spark, d)).drop("bhv_ext")


@query("dedup_logid", "SELECT DISTINCT logid, uid, ts FROM behavior")
def dedup_logid(spark, d):
    return enrich.dedup_logid(views.behavior(spark, d)).select("logid", "uid", "ts")


@query(
    "home_funnel_filter",
    """SELECT uid, arrival, bhv_page, bhv_src FROM behavior
       WHERE bhv_page = 'home' OR (bhv_page = 'pdp' AND bhv_src = 'home')""",
)
def home_funnel_filter(spark, d):
    return enrich.home_funnel_filter(views.behavior(spark, d)).select("uid", "arrival", "bhv_page", "bhv_src")


@query("event_kind", "SELECT arrival, pos, kind FROM dwd")
def event_kind(spark, d):
    rows = enrich.explode_shows(views.behavior(spark, d))
    return rows.select("arrival", "pos", S.event_kind().alias("kind"))


@query("search_query_filter", "SELECT uid, arrival, pos, query FROM dwd WHERE bhv_page = 'search' AND query <> ''")
def search_query_filter(spark, d):
    rows = enrich.search_query_filter(enrich.explode_shows(views.behavior(spark, d)))
    return rows.select("uid", "arrival", "pos", F.col("bhv_ext.query").alias("query"))


@query(
    "join_user_dim",
    """SELECT arrival, uid, coalesce(age, 0) AS user_age, coalesce(city, 'unknown') AS user_city,
       coalesce(level, 1) AS user_level FROM behavior LEFT JOIN dim_user u ON uid = u.user_id""",
)
def join_user_dim(spark, d):
    out = enrich.join_user_dim(views.behavior(spark, d), views.dim_user(spark, d))
    return out.select("arrival", "uid", "user_age", "user_city", "user_level")


@query("join_item_dim", "SELECT arrival, pos, item_id, item_brand, item_price FROM dwd")
def join_item_dim(spark, d):
    rows = enrich.explode_shows(views.behavior(spark, d))
    out = enrich.join_item_dim(rows, views.dim_item(spark, d))
    return out.select("arrival", "pos", "item_id", "item_brand", "item_price")


@query(
    "dim_join_fallback",
    """SELECT arrival, pos, item_id, category_id, 0 AS user_age, 'unknown' AS user_city, 1 AS user_level,
       CASE WHEN bhv_type <> 'show' THEN 'unknown' END AS item_brand, CAST(0 AS DOUBLE) AS item_price FROM dwd""",
)
def dim_join_fallback(spark, d):
    return enrich.enrich(views.behavior(spark, d)).select(
        "arrival", "pos", "item_id", "category_id", "user_age", "user_city", "user_level", "item_brand", "item_price"
    )


@query("enrich", f"SELECT {FLAT_SQL} FROM dwd")
def enrich_all(spark, d):
    return flat(dwd_of(spark, d))


# ---- windows ----------------------------------------------------------------

FUNNEL_SQL = """
SELECT uid AS user_id, category_id, minute * 60000 AS window_start, minute * 60000 + 60000 AS window_end,
  count(*) FILTER (bhv_type = 'show' AND bhv_page = 'home') AS show_count,
  count(*) FILTER (bhv_type = 'click' AND bhv_value IS NULL AND bhv_page = 'home') AS click_count,
  count(*) FILTER (bhv_type = 'click' AND bhv_value = 'cart') AS cart_count,
  count(*) FILTER (bhv_type = 'click' AND bhv_value = 'fav') AS fav_count,
  count(*) FILTER (bhv_type = 'click' AND bhv_value = 'buy') AS buy_count
FROM dwd WHERE bhv_page = 'home' OR (bhv_page = 'pdp' AND bhv_src = 'home')
GROUP BY ALL"""


@query("home_funnel_window", FUNNEL_SQL)
def home_funnel_window(spark, d):
    return windows.home_funnel_window(dwd_of(spark, d))


@query(
    "home_funnel_rates",
    f"""WITH f AS ({FUNNEL_SQL})
    SELECT user_id, category_id, window_start,
      round(CASE WHEN show_count = 0 THEN 0.0 ELSE CAST(click_count AS DOUBLE) / show_count END, 6) AS ctr,
      round(CASE WHEN click_count = 0 THEN 0.0 ELSE CAST(buy_count AS DOUBLE) / click_count END, 6) AS ctb,
      round(CASE WHEN show_count = 0 THEN 0.0 ELSE CAST(buy_count AS DOUBLE) / show_count END, 6) AS cvr FROM f""",
)
def home_funnel_rates(spark, d):
    out = windows.home_funnel_window(dwd_of(spark, d), rates=True)
    return out.select(
        "user_id", "category_id", "window_start", *[F.round(c, 6).alias(c) for c in ("ctr", "ctb", "cvr")]
    )


@query(
    "latest_window_feature",
    f"""WITH f AS ({FUNNEL_SQL}) SELECT * FROM f
    QUALIFY row_number() OVER (PARTITION BY user_id, category_id ORDER BY window_start DESC) = 1""",
)
def latest_window_feature(spark, d):
    return windows.latest_window_feature(windows.home_funnel_window(dwd_of(spark, d)))


# ---- cumulative -------------------------------------------------------------

PV_SQL = """SELECT uid, count(*) FILTER (req_id IS DISTINCT FROM prev) AS total_pv FROM (
  SELECT uid, req_id, lag(req_id) OVER (PARTITION BY uid ORDER BY ts, arrival, pos) AS prev
  FROM dwd WHERE kind = 'pv' AND req_id IS NOT NULL) GROUP BY uid"""
TOTALS_SQL = """SELECT uid, count(*) FILTER (kind = 'click') AS total_click, count(*) FILTER (kind = 'cart') AS total_cart,
  count(*) FILTER (kind = 'fav') AS total_fav, count(*) FILTER (kind = 'buy') AS total_buy FROM dwd GROUP BY uid"""
DAYS_SQL = "SELECT uid, count(DISTINCT (ts_raw + 28800000) // 86400000) AS active_days FROM dwd GROUP BY uid"
LATCH_USER_SQL = """SELECT uid, user_age, user_city, user_level FROM (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY (user_age <> 0) DESC,
    CASE WHEN user_age <> 0 THEN ts ELSE -ts END, CASE WHEN user_age <> 0 THEN arrival ELSE -arrival END,
    CASE WHEN user_age <> 0 THEN pos ELSE -pos END) AS rn FROM dwd) WHERE rn = 1"""
LATCH_ITEM_SQL = """SELECT item_id, category_id, coalesce(item_brand, 'unknown') AS item_brand, item_price FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY good DESC,
    CASE WHEN good THEN ts ELSE -ts END, CASE WHEN good THEN arrival ELSE -arrival END,
    CASE WHEN good THEN pos ELSE -pos END) AS rn FROM (
  SELECT *, coalesce(item_brand, 'unknown') <> 'unknown' AS good FROM dwd
  WHERE item_id IS NOT NULL AND kind <> 'pv')) WHERE rn = 1"""
ITEM_TOTALS_SQL = """SELECT item_id, count(*) FILTER (kind = 'click') AS total_detail_click,
  count(*) FILTER (kind = 'buy') AS total_buy, count(*) FILTER (kind = 'cart') AS total_cart,
  count(*) FILTER (kind = 'fav') AS total_fav FROM dwd WHERE item_id IS NOT NULL AND kind <> 'pv' GROUP BY item_id"""
UV_SQL = """SELECT item_id, count(DISTINCT uid) AS uv FROM dwd
  WHERE item_id IS NOT NULL AND kind <> 'pv' GROUP BY item_id"""


@query("user_totals", TOTALS_SQL)
def user_totals(spark, d):
    return cumulative.user_totals(dwd_of(spark, d))


@query("user_total_pv", PV_SQL)
def user_total_pv(spark, d):
    return cumulative.user_total_pv(enrich.explode_shows(views.behavior(spark, d)))


@query(
    "user_total_pv_distinct",
    "SELECT uid, count(DISTINCT req_id) AS total_pv FROM dwd WHERE kind = 'pv' AND req_id IS NOT NULL GROUP BY uid",
)
def user_total_pv_distinct(spark, d):
    return cumulative.user_total_pv(enrich.explode_shows(views.behavior(spark, d)), mode="distinct")


@query("user_active_days", DAYS_SQL)
def user_active_days(spark, d):
    return cumulative.user_active_days(views.behavior(spark, d, "raw"))


@query(
    "user_last_active",
    """SELECT uid, ts_late AS last_active_ts FROM behavior
       QUALIFY row_number() OVER (PARTITION BY uid ORDER BY arrival DESC) = 1""",
)
def user_last_active(spark, d):
    return cumulative.user_last_active(views.behavior(spark, d, "late"))


@query("latch_user_dim", LATCH_USER_SQL)
def latch_user_dim(spark, d):
    return cumulative.latch_user_dim(dwd_of(spark, d))


@query("item_totals", ITEM_TOTALS_SQL)
def item_totals(spark, d):
    return cumulative.item_totals(dwd_of(spark, d))


@query("item_uv", UV_SQL)
def item_uv(spark, d):
    return cumulative.item_uv(dwd_of(spark, d))


@query("latch_item_dim", LATCH_ITEM_SQL)
def latch_item_dim(spark, d):
    return cumulative.latch_item_dim(dwd_of(spark, d))


CVR_SQL = "CASE WHEN total_detail_click = 0 THEN 0.0 ELSE CAST(total_buy AS DOUBLE) / total_detail_click END"


@query(
    "conversion_rate",
    f"WITH t AS ({ITEM_TOTALS_SQL}) SELECT item_id, round({CVR_SQL}, 6) AS conversion_rate FROM t",
)
def conversion_rate(spark, d):
    totals = cumulative.item_totals(dwd_of(spark, d))
    return totals.select("item_id", F.round(cumulative.conversion_rate(), 6).alias("conversion_rate"))


USER_FEATURES_SQL = f"""SELECT t.uid AS user_id, l.user_age, l.user_city, l.user_level,
  coalesce(p.total_pv, 0) AS total_pv, t.total_click, t.total_cart, t.total_fav, t.total_buy,
  a.last_active_ts, a.active_days, a.update_ts
FROM ({TOTALS_SQL}) t JOIN ({LATCH_USER_SQL}) l USING (uid) LEFT JOIN ({PV_SQL}) p USING (uid)
JOIN (SELECT uid, max_by(ts, arrival) AS last_active_ts, max(ts) AS update_ts,
      count(DISTINCT (ts + 28800000) // 86400000) AS active_days FROM dwd GROUP BY uid) a USING (uid)"""
ITEM_FEATURES_SQL = f"""SELECT t.item_id, l.category_id, l.item_brand, l.item_price, t.total_detail_click, t.total_buy,
  t.total_cart, t.total_fav, u.uv, {CVR_SQL} AS conversion_rate, a.update_ts
FROM ({ITEM_TOTALS_SQL}) t JOIN ({LATCH_ITEM_SQL}) l USING (item_id) JOIN ({UV_SQL}) u USING (item_id)
JOIN (SELECT item_id, max(ts) AS update_ts FROM dwd WHERE kind <> 'pv' GROUP BY item_id) a USING (item_id)"""


@query("user_features", USER_FEATURES_SQL)
def user_features(spark, d):
    return cumulative.user_features(dwd_of(spark, d))


@query("item_features", f"SELECT * REPLACE (round(conversion_rate, 6) AS conversion_rate) FROM ({ITEM_FEATURES_SQL})")
def item_features(spark, d):
    out = cumulative.item_features(dwd_of(spark, d))
    return out.withColumn("conversion_rate", F.round("conversion_rate", 6))


RUN = "OVER (PARTITION BY {k} ORDER BY ts, arrival, pos ROWS UNBOUNDED PRECEDING)"
RU = RUN.format(k="uid")
RI = RUN.format(k="item_id")


@query(
    "running_user_features",
    f"""WITH r AS (SELECT *, lag(req_id) OVER (PARTITION BY uid, kind = 'pv' AND req_id IS NOT NULL ORDER BY ts, arrival, pos) AS prev,
      row_number() OVER (PARTITION BY uid, (ts + 28800000) // 86400000 ORDER BY ts, arrival, pos) = 1 AS new_day,
      CASE WHEN user_age <> 0 THEN {{'age': user_age, 'city': user_city, 'level': user_level}} END AS good FROM dwd),
    g AS (SELECT *, coalesce(first_value(good IGNORE NULLS) {RU},
        {{'age': user_age, 'city': user_city, 'level': user_level}}) AS dim FROM r)
    SELECT uid AS user_id, ts, arrival, pos, dim.age AS user_age, dim.city AS user_city, dim.level AS user_level,
      count(*) FILTER (kind = 'pv' AND req_id IS NOT NULL AND req_id IS DISTINCT FROM prev) {RU} AS total_pv,
      count(*) FILTER (new_day) {RU} AS active_days,
      count(*) FILTER (kind = 'click') {RU} AS total_click, count(*) FILTER (kind = 'cart') {RU} AS total_cart,
      count(*) FILTER (kind = 'fav') {RU} AS total_fav, count(*) FILTER (kind = 'buy') {RU} AS total_buy,
      ts AS last_active_ts FROM g""",
)
def running_user_features(spark, d):
    return cumulative.user_feature_changes(dwd_of(spark, d))


@query(
    "running_item_features",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY item_id, uid ORDER BY ts, arrival, pos) = 1 AS new_user,
      CASE WHEN coalesce(item_brand, 'unknown') <> 'unknown'
           THEN {{'c': category_id, 'b': item_brand, 'p': item_price}} END AS good
      FROM dwd WHERE item_id IS NOT NULL AND kind <> 'pv'),
    g AS (SELECT *, coalesce(first_value(good IGNORE NULLS) {RI},
        {{'c': category_id, 'b': item_brand, 'p': item_price}}) AS dim,
      count(*) FILTER (kind = 'click') {RI} AS total_detail_click, count(*) FILTER (kind = 'buy') {RI} AS total_buy,
      count(*) FILTER (kind = 'cart') {RI} AS total_cart, count(*) FILTER (kind = 'fav') {RI} AS total_fav,
      count(*) FILTER (new_user) {RI} AS uv FROM r)
    SELECT item_id, ts, arrival, pos, dim.c AS category_id, coalesce(dim.b, 'unknown') AS item_brand, dim.p AS item_price,
      total_detail_click, total_buy, total_cart, total_fav, uv, round({CVR_SQL}, 6) AS conversion_rate FROM g""",
)
def running_item_features(spark, d):
    out = cumulative.item_feature_changes(dwd_of(spark, d))
    return out.withColumn("conversion_rate", F.round("conversion_rate", 6))


# ---- sliding ----------------------------------------------------------------

def _sliding_sql(keys: str, measures=(("pv", "pv"), ("click", "click")), names=("{m}_{s}",)) -> str:
    parts = []
    for m, alias in measures:
        for span, n in (("5min", 5), ("1h", 60)):
            parts.append(
                f"""CAST(sum({m}) OVER (PARTITION BY {keys} ORDER BY minute RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING) AS BIGINT) AS e_{m}_{span},
                CAST(sum({m}) OVER (PARTITION BY {keys} ORDER BY minute RANGE BETWEEN {n - 1} PRECEDING AND 1 PRECEDING) AS BIGINT) AS o_{m}_{span}"""
            )
    outs = [
        f"coalesce(CASE WHEN ts % 60000 = 0 THEN e_{m}_{s} ELSE o_{m}_{s} END, 0) + h_{m} AS {a}_{s}"
        for m, a in measures
        for s in ("5min", "1h")
    ]
    here = ", ".join(
        f"CAST(sum({m}) OVER (PARTITION BY {keys}, minute ORDER BY ts, arrival, pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS h_{m}"
        for m, _ in measures
    )
    return f"""WITH q AS (SELECT *, CAST(kind = 'pv' AS INTEGER) AS pv, CAST(kind = 'click' AS INTEGER) AS click
      FROM dwd WHERE kind IN ('pv', 'click') AND item_id IS NOT NULL OR kind IN ('pv', 'click') AND '{keys}' NOT LIKE 'item%'),
    r AS (SELECT *, {", ".join(parts)}, {here} FROM q)
    SELECT {keys}, ts, arrival, pos, {", ".join(outs)} FROM r"""


@query("user_sliding_stat", _sliding_sql("uid"))
def user_sliding_stat(spark, d):
    return sliding.user_sliding_stat(enrich.explode_shows(views.behavior(spark, d)))


@query("user_category_click_stat", _sliding_sql("uid, category_id", (("click", "cat_click"),)))
def user_category_click_stat(spark, d):
    return sliding.user_category_click_stat(enrich.explode_shows(views.behavior(spark, d)))


@query("item_sliding_stat", _sliding_sql("item_id"))
def item_sliding_stat(spark, d):
    return sliding.item_sliding_stat(enrich.explode_shows(views.behavior(spark, d)))


def _latest_sql(keys: str) -> str:
    return f"""SELECT {keys}, ts AS last_ts, pv_5min, pv_1h, click_5min, click_1h FROM ({_sliding_sql(keys)})
    QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY ts DESC, arrival DESC, pos DESC) = 1"""


@query("latest_stat", _latest_sql("uid"))
def latest_stat(spark, d):
    return sliding.latest_stat(enrich.explode_shows(views.behavior(spark, d)), ["uid"])


@query("latest_item_stat", _latest_sql("item_id"))
def latest_item_stat(spark, d):
    return sliding.latest_stat(enrich.explode_shows(views.behavior(spark, d)), ["item_id"])


# ---- decay ------------------------------------------------------------------

def _decay_sql(entity: str, kinds: tuple[str, ...], clock: str = "shared", digits: int = 6) -> str:
    clock_keys = "uid, ent" if clock == "shared" else "uid, ent, kind"
    listed = ", ".join(f"'{k}'" for k in kinds)
    outs = ", ".join(
        f"round(coalesce(sum(exp(s - e)) FILTER (kind = '{k}'), 0.0), {digits}) AS {k}_cnt" for k in kinds
    )
    name = "category_id" if entity == "category_id" else "brand"
    return f"""WITH q AS (SELECT uid, {entity} AS ent, kind, ts_raw AS ts, arrival, pos FROM dwd WHERE kind IN ({listed})),
    l AS (SELECT *, coalesce(ln(2.0) * greatest(0, ts - lag(ts) OVER (PARTITION BY {clock_keys} ORDER BY ts, arrival, pos))
          / (7 * 86400000.0), 0.0) AS g FROM q),
    c AS (SELECT *, sum(g) OVER (PARTITION BY uid, ent, kind ORDER BY ts, arrival, pos ROWS UNBOUNDED PRECEDING) AS s,
          sum(g) OVER (PARTITION BY uid, ent, kind) AS e FROM l)
    SELECT uid, ent AS {name}, {outs}, max(ts) AS last_ts FROM c GROUP BY uid, ent"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c.endswith("_cnt")})


@query("decayed_cross_category", _decay_sql("category_id", decay.CATEGORY_KINDS))
def decayed_cross_category(spark, d):
    return _rounded(decay.decayed_cross_category(enrich.explode_shows(views.behavior(spark, d, "raw"))))


@query("decayed_cross_category_own_clock", _decay_sql("category_id", decay.CATEGORY_KINDS, "per_counter"))
def decayed_cross_category_own_clock(spark, d):
    rows = enrich.explode_shows(views.behavior(spark, d, "raw"))
    return _rounded(decay.decayed_cross_category(rows, clock="per_counter"))


@query("decayed_cross_brand", _decay_sql("coalesce(item_brand, 'unknown')", decay.BRAND_KINDS))
def decayed_cross_brand(spark, d):
    return _rounded(decay.decayed_cross_brand(dwd_of(spark, d, "raw")))


@query(
    "format_counter",
    f"""WITH x AS ({_decay_sql("category_id", decay.CATEGORY_KINDS, digits=12)})
    SELECT uid, category_id, {", ".join(f"printf('%.4f', {k}_cnt) AS {k}_cnt" for k in decay.CATEGORY_KINDS)}, last_ts FROM x""",
)
def format_counter(spark, d):
    rows = enrich.explode_shows(views.behavior(spark, d, "raw"))
    return decay.format_counters(decay.decayed_cross_category(rows))


# ---- sequences --------------------------------------------------------------

def text_members(seq: DataFrame) -> DataFrame:
    """Sequences as 'member@ts' text, for row-wise comparison."""
    joined = F.transform("members", lambda m: F.concat(m["member"], F.lit("@"), m["ts"].cast("string")))
    return seq.select("key", F.array_join(joined, ",").alias("members"), F.size("members").cast("long").alias("n"))


def _seq_sql(name: str) -> str:
    key, member, n, _ = sequences.SEQUENCES[name]
    kind = name.removeprefix("item_")
    item = "item_id" if kind == "pv" else "ext_item_id"
    key, member = (item if c == "item_id" else c for c in (key, member))
    return f"""WITH m AS (SELECT {key} AS key, {member} AS member, max(ts) AS ts FROM dwd
      WHERE kind = '{kind}' AND {item} IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, member DESC) AS rank FROM m)
    SELECT key, string_agg(member || '@' || ts, ',' ORDER BY rank) AS members, count(*) AS n
    FROM r WHERE rank <= {n} GROUP BY key"""


def _register_sequence(name: str) -> None:
    @query(f"seq_{name}", _seq_sql(name))
    def plan(spark, d):
        return text_members(sequences.sequence(enrich.explode_shows(views.behavior(spark, d)), name))


for _name in sequences.SEQUENCES:
    _register_sequence(_name)


def _seq_query_sql(extra: str = "") -> str:
    return f"""WITH r AS (SELECT uid AS key, query, ts,
        row_number() OVER (PARTITION BY uid ORDER BY ts DESC, arrival DESC, pos DESC) AS rank
      FROM dwd WHERE bhv_page = 'search' AND query <> '' {extra})
    SELECT key, string_agg(query || '@' || ts, ',' ORDER BY rank) AS members, count(*) AS n
    FROM r WHERE rank <= 20 GROUP BY key"""


@query("seq_query", _seq_query_sql())
def seq_query(spark, d):
    return text_members(sequences.seq_query(enrich.explode_shows(views.behavior(spark, d))))


@query("seq_query_per_request", _seq_query_sql("AND pos = 0"))
def seq_query_per_request(spark, d):
    return text_members(sequences.seq_query(enrich.explode_shows(views.behavior(spark, d)), dedup="request"))


def _read_sql(n: int | None) -> str:
    cond = f"AND rank <= {n}" if n else ""
    return f"""WITH m AS (SELECT uid AS key, ext_item_id AS member, max(ts) AS ts FROM dwd
      WHERE kind = 'click' AND ext_item_id IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, member DESC) AS rank FROM m)
    SELECT key, string_agg(member, ',' ORDER BY rank) AS items FROM r WHERE rank <= 50 {cond} GROUP BY key"""


@query("seq_read", _read_sql(20))
def seq_read(spark, d):
    clicks = sequences.sequence(enrich.explode_shows(views.behavior(spark, d)), "click")
    return sequences.seq_read(clicks, sequences.READ_RANKING).withColumn("items", F.array_join("items", ","))


@query(
    "last_n_interactions",
    """WITH r AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id
        ORDER BY create_time DESC, order_key DESC, line DESC, item_id DESC) AS rank FROM interactions)
    SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY rank DESC) AS items
    FROM r WHERE rank <= 20 GROUP BY user_id""",
)
def last_n_interactions(spark, d):
    out = sequences.last_n_interactions(views.interactions(spark, d))
    return out.withColumn("items", F.array_join(F.transform("items", lambda i: i.cast("string")), ","))
