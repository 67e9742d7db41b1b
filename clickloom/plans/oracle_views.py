"""The adapter views as SQL, for the side-by-side check."""

from __future__ import annotations

import re

# view name -> SELECT text; a view may use the ones above it
VIEWS: dict[str, str] = {}

VIEWS["ev"] = """
SELECT event_id, user_id, event_type, CAST(props::JSON->>'k' AS INTEGER) AS k,
       epoch_us(ts) // 1000 AS ts_raw,
       1704067200000 + (epoch_us(ts) // 1000 - 1704067200000) // 96 AS ts_fast
FROM events"""

VIEWS["behavior_all"] = """
SELECT *, CASE WHEN event_id % 17 = 0 THEN ts_fast - 30000 ELSE ts_fast END AS ts_late,
       'U' || printf('%06d', user_id + 1) AS uid,
       'log_' || event_id AS logid,
       CASE WHEN event_id % 97 <> 0
            THEN 'req_' || user_id || '_' || (ts_fast // 3600000 - event_id % 2) END AS req_id,
       CASE WHEN event_type IN ('view', 'error') THEN 'show' ELSE 'click' END AS bhv_type,
       CASE WHEN event_type = 'purchase' THEN 'buy'
            WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'fav'
            WHEN event_type = 'signup' THEN 'cart' END AS bhv_value
FROM ev"""

VIEWS["behavior_base"] = """
SELECT *, CASE WHEN bhv_value IS NOT NULL THEN 'pdp'
               WHEN event_id % 3 <> 0 THEN 'home' ELSE 'search' END AS bhv_page,
       CASE WHEN bhv_value IS NULL THEN 'direct'
            WHEN event_id % 2 = 0 THEN 'home' ELSE 'search' END AS bhv_src,
       CASE WHEN bhv_type = 'show' THEN '1001' WHEN bhv_value IS NULL THEN '2001' ELSE '3001' END AS bhv_id,
       CASE WHEN bhv_type = 'show' THEN event_id % 5 END AS n_items,
       CASE WHEN bhv_type = 'click' AND event_id % 101 <> 0
            THEN 'I' || printf('%07d', k + 1) END AS ext_item_id
FROM behavior_all"""

VIEWS["behavior"] = """
SELECT *, ts_fast AS ts, event_id AS arrival,
       CASE WHEN bhv_page = 'search' THEN 'q' || (k % 12) END AS query
FROM behavior_base"""

VIEWS["dim_user"] = """
SELECT 'U' || printf('%06d', c_custkey + 1) AS user_id,
       CAST(CASE WHEN c_custkey % 29 = 0 THEN 0 ELSE 18 + c_custkey % 48 END AS INTEGER) AS age,
       n_name AS city, CAST(1 + c_custkey % 5 AS INTEGER) AS level
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
WHERE c_custkey % 23 <> 0"""

VIEWS["dim_item"] = """
SELECT 'I' || printf('%07d', p_partkey + 1) AS item_id,
       CAST(p_size AS INTEGER) AS category_id, p_brand AS brand, p_retailprice AS price
FROM part WHERE p_partkey % 19 <> 0"""

VIEWS["exploded"] = """
SELECT b.* , CAST(0 AS INTEGER) AS pos, ext_item_id AS item_id
FROM behavior b WHERE bhv_type <> 'show' OR n_items = 0
UNION ALL
SELECT b.*, CAST(j AS INTEGER) AS pos, 'I' || printf('%07d', (k + 7 * j) % 100 + 1)
FROM behavior b, range(4) r(j) WHERE bhv_type = 'show' AND j < n_items"""

VIEWS["dwd"] = """
SELECT e.uid, e.req_id, e.bhv_id, e.bhv_page, e.bhv_src, e.bhv_type, e.bhv_value, e.ts, e.ts_raw, e.ts_late,
       e.arrival, e.pos, e.query,
       CASE WHEN e.bhv_type = 'click' THEN e.ext_item_id END AS ext_item_id,
       coalesce(u.age, 0) AS user_age, coalesce(u.city, 'unknown') AS user_city,
       coalesce(u.level, 1) AS user_level, e.item_id,
       coalesce((CAST(substr(e.item_id, 2) AS INTEGER) - 1) % 50 + 1, 0) AS category_id,
       CASE WHEN e.item_id IS NOT NULL AND (e.bhv_type <> 'show' OR e.bhv_page = 'home')
            THEN coalesce(i.brand, 'unknown') END AS item_brand,
       CASE WHEN e.item_id IS NOT NULL AND (e.bhv_type <> 'show' OR e.bhv_page = 'home')
            THEN coalesce(i.price, 0.0) ELSE 0.0 END AS item_price,
       CASE WHEN e.bhv_type = 'show' THEN 'pv' WHEN e.bhv_value IS NULL THEN 'click'
            ELSE e.bhv_value END AS kind,
       e.ts // 60000 AS minute
FROM exploded e LEFT JOIN dim_user u ON e.uid = u.user_id LEFT JOIN dim_item i ON e.item_id = i.item_id"""

VIEWS["items"] = """
SELECT p_partkey AS item_id, p_name AS name, p_brand AS author, 'C' || (p_partkey % 10) AS city,
       p_type AS item_categories, replace(p_name, ' ', ';') AS item_keywords, p_retailprice AS price,
       TIMESTAMP '2024-01-01' + to_minutes(CAST(p_partkey AS INTEGER)) AS create_time
FROM part"""

VIEWS["users"] = """
SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN 'f' ELSE 'm' END AS gender,
       CAST(18 + c_custkey % 48 AS INTEGER) AS age,
       CASE WHEN c_custkey % 31 = 0 THEN '' ELSE
         ['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'][(c_custkey + 1) % 6 + 1] || ';' ||
         ['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'][(c_custkey * 5 + 5) % 6 + 1] END AS user_categories,
       CASE WHEN c_custkey % 31 = 0 THEN '' ELSE
         ['anvil','blue','bolt','gear','gizmo','plate','red','ring','widget'][(c_custkey + 1) % 9 + 1] || ';' ||
         ['anvil','blue','bolt','gear','gizmo','plate','red','ring','widget'][(c_custkey * 2 + 2) % 9 + 1] END AS user_keywords
FROM customer"""

VIEWS["interactions"] = """
SELECT o_custkey AS user_id, l_partkey AS item_id, o_orderdate AS create_time, l_orderkey AS order_key,
       l_linenumber AS line, CAST(l_orderkey % 24 AS INTEGER) AS hour,
       CAST(dayofweek(o_orderdate) IN (0, 6) AS INTEGER) AS is_weekend,
       1 AS click, CAST(l_quantity > 15 AS INTEGER) AS cart, CAST(l_returnflag = 'R' AS INTEGER) AS forward,
       CAST(l_linestatus = 'F' AS INTEGER) AS buy,
       1 + CAST(l_quantity > 15 AS INTEGER) + CAST(l_returnflag = 'R' AS INTEGER)
         + CAST(l_linestatus = 'F' AS INTEGER) AS rating
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

VIEWS["content_vectors"] = "SELECT vec_id AS item_id, embedding AS vector FROM embeddings"

VIEWS["ranking_trace"] = """
SELECT 'req_' || order_key AS req_id, 'U' || printf('%06d', user_id + 1) AS uid,
       epoch_ms(create_time) // 1000 AS ts,
       ['recall', 'rough', 'fine'][line % 3 + 1] AS stage,
       CASE item_id % 5 WHEN 0 THEN 'low_score' WHEN 1 THEN 'low_diversity' WHEN 2 THEN 'out_of_stock'
                        WHEN 3 THEN 'recall_miss' END AS filter_reason,
       click AS click_label, greatest(cart, forward) AS engage_label, buy AS buy_label
FROM interactions"""

VIEWS["requests"] = """
SELECT 'req_' || user_id AS req_id, user_id AS uid, 10 AS top_k, 1704067200000 + 9 * 3600000 AS ts
FROM dim_user"""

VIEWS["sessions"] = "SELECT conv_id AS session_id, turn, role, text FROM conversations"


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it uses, directly or through other views."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for word in set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text)):
            if word in VIEWS and word not in needed:
                needed.add(word)
                visit(VIEWS[word])

    visit(sql)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in VIEWS if n in needed)
    sql = sql.strip()
    if not ctes:
        return sql
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{sql[15:]}"
    if sql.upper().startswith("WITH "):
        return f"WITH {ctes},\n{sql[5:]}"
    return f"WITH {ctes}\n{sql}"
