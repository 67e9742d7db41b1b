"""Registered queries: recall, vectors, graph, sampling, encoding, ranking, trajectories, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom import schemas
from clickloom.functions import scalars as S
from clickloom.operators import cf, codes, content, encode, graph, mmr, negatives, slices, trajectories, vectors
from clickloom.operators import sequences
from clickloom.plans import cascade
from clickloom.plans.oracle_views import VIEWS
from clickloom.plans.registry import query
from clickloom.sources import feature_store, tables, views
from clickloom.session import materialise, release, work_path

DIM = 64


def tables_of(spark, d) -> cascade.Tables:
    """The four tables; interactions, a join that every plan reads several times, are stored."""
    return cascade.Tables(
        views.users(spark, d), views.items(spark, d), materialise(views.interactions(spark, d)), views.content_vectors(spark, d)
    )


# ---- collaborative filtering ------------------------------------------------

VIEWS["ratings"] = """
SELECT user_id, item_id, rating FROM interactions QUALIFY row_number() OVER (PARTITION BY user_id, item_id
  ORDER BY create_time DESC, order_key DESC, line DESC, rating DESC) = 1"""
VIEWS["item_pairs"] = """
SELECT a.item_id AS i, b.item_id AS j, sum(a.rating * b.rating) AS dot
FROM ratings a JOIN ratings b ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY ALL"""
VIEWS["item_sims"] = """
SELECT i AS item_id, j AS similar_item, dot / sqrt(ni.n * nj.n) AS sim,
  row_number() OVER (PARTITION BY i ORDER BY round(dot / sqrt(ni.n * nj.n), 12) DESC, j) AS rank
FROM item_pairs JOIN (SELECT item_id, CAST(sum(rating * rating) AS DOUBLE) AS n FROM interactions GROUP BY item_id) ni ON ni.item_id = i
JOIN (SELECT item_id, CAST(sum(rating * rating) AS DOUBLE) AS n FROM interactions GROUP BY item_id) nj ON nj.item_id = j
QUALIFY rank <= 10"""
VIEWS["user_sims"] = """
SELECT u AS user_id, v AS similar_user, c / sqrt(CAST(nu.n * nv.n AS DOUBLE)) AS sim,
  row_number() OVER (PARTITION BY u ORDER BY round(c / sqrt(CAST(nu.n * nv.n AS DOUBLE)), 12) DESC, v) AS rank
FROM (SELECT a.user_id AS u, b.user_id AS v, count(*) AS c FROM ratings a JOIN ratings b
      ON a.item_id = b.item_id AND a.user_id <> b.user_id GROUP BY ALL)
JOIN (SELECT user_id, count(*) AS n FROM ratings GROUP BY user_id) nu ON nu.user_id = u
JOIN (SELECT user_id, count(*) AS n FROM ratings GROUP BY user_id) nv ON nv.user_id = v
QUALIFY rank <= 10"""
VIEWS["item_cf_recs"] = """
SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM (
  SELECT r.user_id, s.similar_item AS item_id, sum(r.rating * s.sim) AS score
  FROM ratings r JOIN item_sims s ON s.item_id = r.item_id GROUP BY ALL) x
WHERE NOT EXISTS (SELECT 1 FROM ratings h WHERE h.user_id = x.user_id AND h.item_id = x.item_id) QUALIFY rank <= 100"""
VIEWS["user_cf_recs"] = """
SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM (
  SELECT s.user_id, r.item_id, sum(r.rating * s.sim) AS score
  FROM user_sims s JOIN ratings r ON r.user_id = s.similar_user GROUP BY ALL) x
WHERE NOT EXISTS (SELECT 1 FROM ratings h WHERE h.user_id = x.user_id AND h.item_id = x.item_id) QUALIFY rank <= 100"""


def _rank_long(df):
    return df.withColumn("rank", F.col("rank").cast("long"))


@query("co_occurrence", "SELECT i AS item_a, j AS item_b, CAST(dot AS DOUBLE) AS weight FROM item_pairs WHERE i < j")
def co_occurrence(spark, d):
    return cf.co_occurrence(views.interactions(spark, d))


@query("item_cf_similarity", "SELECT item_id, similar_item, round(sim, 6) AS sim, rank FROM item_sims")
def item_cf_similarity(spark, d):
    return _rank_long(cf.item_cf_similarity(views.interactions(spark, d))).withColumn("sim", F.round("sim", 6))


@query("item_cf_recommend", "SELECT user_id, item_id, round(score, 6) AS score, rank FROM item_cf_recs")
def item_cf_recommend(spark, d):
    return _rank_long(cf.item_cf_recommend(views.interactions(spark, d))).withColumn("score", F.round("score", 6))


@query("user_cf_similarity", "SELECT user_id, similar_user, round(sim, 6) AS sim, rank FROM user_sims")
def user_cf_similarity(spark, d):
    return _rank_long(cf.user_cf_similarity(views.interactions(spark, d))).withColumn("sim", F.round("sim", 6))


@query("user_cf_recommend", "SELECT user_id, item_id, round(score, 6) AS score, rank FROM user_cf_recs")
def user_cf_recommend(spark, d):
    return _rank_long(cf.user_cf_recommend(views.interactions(spark, d))).withColumn("score", F.round("score", 6))


@query("top_neighbours", "SELECT user_id, similar_user, rank FROM user_sims")
def top_neighbours(spark, d):
    sims = cf.user_cf_similarity(views.interactions(spark, d))
    return _rank_long(sims.select("user_id", "similar_user", "rank"))


VIEWS["unseen"] = """
SELECT s.user_id, r.item_id FROM user_sims s JOIN ratings r ON r.user_id = s.similar_user"""


@query(
    "exclude_history",
    """SELECT DISTINCT user_id, item_id FROM unseen u WHERE NOT EXISTS
    (SELECT 1 FROM ratings h WHERE h.user_id = u.user_id AND h.item_id = u.item_id)""",
)
def exclude_history(spark, d):
    seen = views.interactions(spark, d)
    ratings = cf.stored_ratings(seen)
    sims = cf.user_cf_similarity(seen, ratings=ratings)
    return cf.exclude_history(cf.lists_of_similar(sims, ratings), ratings).select("user_id", "item_id")


# ---- content ----------------------------------------------------------------

VIEWS["by_category"] = """
SELECT e AS entry, item_id, row_number() OVER (PARTITION BY e ORDER BY create_time DESC, item_id DESC) AS rank
FROM (SELECT DISTINCT unnest(string_split(item_categories, ';')) AS e, item_id, create_time FROM items) WHERE e <> '' QUALIFY rank <= 50"""
VIEWS["by_keyword"] = """
SELECT e AS entry, item_id, row_number() OVER (PARTITION BY e ORDER BY create_time DESC, item_id DESC) AS rank
FROM (SELECT DISTINCT unnest(string_split(item_keywords, ';')) AS e, item_id, create_time FROM items) WHERE e <> '' QUALIFY rank <= 50"""
VIEWS["category_recs"] = """
SELECT DISTINCT u.user_id, c.item_id FROM (SELECT user_id, unnest(string_split(user_categories, ';')) AS e FROM users) u
JOIN by_category c ON c.entry = u.e"""
VIEWS["keyword_recs"] = """
SELECT DISTINCT u.user_id, c.item_id FROM (SELECT user_id, unnest(string_split(user_keywords, ';')) AS e FROM users) u
JOIN by_keyword c ON c.entry = u.e"""


@query("newest_per_category", "SELECT entry, item_id, rank FROM by_category")
def newest_per_category(spark, d):
    return _rank_long(content.newest_per_category(views.items(spark, d)))


@query("newest_per_keyword", "SELECT entry, item_id, rank FROM by_keyword")
def newest_per_keyword(spark, d):
    return _rank_long(content.newest_per_keyword(views.items(spark, d)))


@query("category_recall", "SELECT user_id, item_id FROM category_recs")
def category_recall(spark, d):
    return content.category_recall(views.users(spark, d), views.items(spark, d))


@query("keyword_recall", "SELECT user_id, item_id FROM keyword_recs")
def keyword_recall(spark, d):
    return content.keyword_recall(views.users(spark, d), views.items(spark, d))


@query("filter_recalled_items", "SELECT item_id, name, price FROM items WHERE item_id IN (SELECT item_id FROM category_recs)")
def filter_recalled_items(spark, d):
    recalled = content.category_recall(views.users(spark, d), views.items(spark, d))
    asked = recalled.select("item_id").distinct()  # few items, recalled by many users
    return views.items(spark, d).join(asked, "item_id", "left_semi").select("item_id", "name", "price")


# ---- vectors ----------------------------------------------------------------

@query(
    "exact_topk_cosine",
    """SELECT a.item_id AS query_id, b.item_id AS item_id, round(list_cosine_similarity(a.v, b.v), 6) AS score,
      row_number() OVER (PARTITION BY a.item_id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.item_id) AS rank
    FROM (SELECT item_id, vector::DOUBLE[] AS v FROM content_vectors) a, (SELECT item_id, vector::DOUBLE[] AS v FROM content_vectors) b
    WHERE a.item_id <> b.item_id QUALIFY rank <= 10""",
)
def exact_topk_cosine(spark, d):
    v = views.content_vectors(spark, d)
    out = vectors.exact_topk_cosine(v.withColumnRenamed("item_id", "query_id"), v, 10, skip_self=True)
    return _rank_long(out).withColumn("score", F.round("score", 6))


@query(
    "bounded_topk_cosine",
    """SELECT a.item_id AS query_id, b.item_id AS item_id, round(list_cosine_similarity(a.v, b.v), 6) AS score,
      row_number() OVER (PARTITION BY a.item_id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.item_id) AS rank
    FROM (SELECT item_id, vector::DOUBLE[] AS v FROM content_vectors) a, (SELECT item_id, vector::DOUBLE[] AS v FROM content_vectors) b
    QUALIFY rank <= 5""",
)
def bounded_topk_cosine(spark, d):
    v = views.content_vectors(spark, d)
    out = vectors.ivf_topk(v.withColumnRenamed("item_id", "query_id"), v, 5, exact=True)
    return _rank_long(out).withColumn("score", F.round("score", 6))


VIEWS["label_centres"] = """
SELECT label, list(m ORDER BY p) AS c FROM (
  SELECT label, p, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS p FROM embeddings) GROUP BY label, p)
GROUP BY label"""
VIEWS["label_members"] = """
SELECT item_id, v, label FROM (SELECT vec_id AS item_id, embedding::DOUBLE[] AS v FROM embeddings) e, label_centres
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY list_cosine_similarity(v, c) DESC, label) = 1"""


def _label_centres(spark, d):
    """One centre per label of the given vectors."""
    import numpy as np

    labelled = views.table(spark, d, "embeddings").select("label", F.col("embedding").alias("vector"))
    rows = vectors.label_centroids(labelled, "label", DIM).orderBy("label").collect()
    return np.array([r["vector"] for r in rows])


NEAR_SQL = """SELECT a.item_id AS query_id, b.item_id, round(list_cosine_similarity(a.v, b.v), 6) AS score,
      row_number() OVER (PARTITION BY a.item_id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.item_id) AS rank
    FROM label_members a JOIN label_members b ON a.label = b.label AND a.item_id <> b.item_id QUALIFY rank <= 10"""


@query("similar_in_cluster", NEAR_SQL)
def similar_in_cluster(spark, d):
    out = vectors.similar_in_cluster(views.content_vectors(spark, d), _label_centres(spark, d))
    return _rank_long(out).withColumn("score", F.round("score", 6))


@query(
    "ivf_topk",
    """WITH probed AS (SELECT vec_id AS item_id, embedding::DOUBLE[] AS v, label FROM (SELECT vec_id, embedding FROM embeddings) e, label_centres
      QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(embedding::DOUBLE[], c) DESC, label) <= 2)
    SELECT a.item_id AS query_id, b.item_id, round(list_cosine_similarity(a.v, b.v), 6) AS score,
      row_number() OVER (PARTITION BY a.item_id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.item_id) AS rank
    FROM probed a JOIN label_members b ON a.label = b.label QUALIFY rank <= 10""",
)
def ivf_topk(spark, d):
    v = views.content_vectors(spark, d)
    out = vectors.ivf_topk(v.withColumnRenamed("item_id", "query_id"), v, 10, probes=2, centres=_label_centres(spark, d))
    return _rank_long(out).withColumn("score", F.round("score", 6))


@query(
    "code_topk",
    """WITH cen AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM label_centres),
    e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
    near AS (SELECT vec_id, v, label, c, row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(v, c) DESC, label) AS n FROM e, cen),
    rest AS (SELECT vec_id, label, p, list_transform(range(1, 5), lambda i: v[4 * p + i] - c[4 * p + i]) AS x FROM near, range(16) AS r(p) WHERE n = 1),
    word AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS w, x AS word FROM rest QUALIFY w <= 16),
    code AS (SELECT vec_id, label, rest.p, word FROM rest JOIN word ON word.p = rest.p QUALIFY row_number() OVER (PARTITION BY vec_id, rest.p
      ORDER BY round(list_dot_product(x, x) - 2 * list_dot_product(x, word) + list_dot_product(word, word), 9), w) = 1),
    rough AS (SELECT q.vec_id AS query_id, code.vec_id AS item_id, q.label,
        round(any_value(list_dot_product(q.v, q.c)) + sum(list_dot_product(q.v[4 * p + 1:4 * p + 4], word)), 9) AS score
      FROM near q JOIN code ON code.label = q.label WHERE q.n <= 2 AND q.vec_id <> code.vec_id GROUP BY ALL),
    kept AS (SELECT query_id, item_id FROM rough QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) <= 50)
    SELECT query_id, item_id, round(list_dot_product(a.v, b.v), 6) AS score,
      row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(a.v, b.v), 12) DESC, item_id) AS rank
    FROM kept JOIN e a ON a.vec_id = query_id JOIN e b ON b.vec_id = item_id QUALIFY rank <= 10""",
)
def code_topk(spark, d):
    """Codes over given centres; the first sixteen vectors give the codewords."""
    import numpy as np

    v = views.content_vectors(spark, d)
    cells = vectors.given_cells(spark, _label_centres(spark, d))
    rests = codes.residuals(vectors.unit_vectors(v, "item_id", "item_id"), cells, "item_id")
    first = [r["rest"] for r in rests.orderBy("item_id").limit(16).collect()]
    books = np.array(first).reshape(len(first), codes.PARTS, -1).swapaxes(0, 1)
    queries = v.withColumnRenamed("item_id", "query_id")
    out = codes.code_topk(queries, v, 10, 2, skip_self=True, rerank=5, cells=cells, books=books)
    return _rank_long(out).withColumn("score", F.round("score", 6))


@query(
    "cluster_recall",
    f"""WITH near AS ({NEAR_SQL}), seeds AS (SELECT user_id, item_id FROM interactions
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY create_time DESC, order_key DESC, line DESC, item_id DESC) <= 20)
    SELECT DISTINCT user_id, near.item_id FROM seeds JOIN near ON seeds.item_id = near.query_id""",
)
def cluster_recall(spark, d):
    last = sequences.last_n_interactions(views.interactions(spark, d))
    return vectors.cluster_recall(last, views.content_vectors(spark, d), centres=_label_centres(spark, d))


VIEWS["cluster_recs"] = f"""
WITH near AS ({NEAR_SQL}), seeds AS (SELECT user_id, item_id FROM interactions
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY create_time DESC, order_key DESC, line DESC, item_id DESC) <= 20)
SELECT DISTINCT user_id, near.item_id FROM seeds JOIN near ON seeds.item_id = near.query_id"""
VIEWS["factor_recs"] = """
SELECT user_id, item_id FROM (SELECT u.user_id, e.embedding::DOUBLE[] AS v FROM users u JOIN embeddings e ON e.vec_id = u.user_id % 400) q,
  (SELECT item_id, vector::DOUBLE[] AS w FROM content_vectors) c
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(list_cosine_similarity(v, w), 12) DESC, item_id) <= 50"""


def _given_factors(spark, d):
    """User factors as given vectors, so that the union can be compared."""
    v = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("_v"), F.col("embedding").alias("vector"))
    people = views.users(spark, d).select(F.col("user_id").alias("query_id"), (F.col("user_id") % 400).alias("_v"))
    return people.join(v, "_v").select("query_id", "vector")


@query(
    "recall_union",
    """WITH c AS (SELECT user_id, item_id, 'item_cf' AS ch FROM item_cf_recs UNION ALL SELECT user_id, item_id, 'user_cf' FROM user_cf_recs
      UNION ALL SELECT user_id, item_id, 'category' FROM category_recs UNION ALL SELECT user_id, item_id, 'keyword' FROM keyword_recs
      UNION ALL SELECT user_id, item_id, 'cluster' FROM cluster_recs UNION ALL SELECT user_id, item_id, 'factor' FROM factor_recs)
    SELECT user_id, item_id, string_agg(ch, ',' ORDER BY ch) AS channels FROM c GROUP BY user_id, item_id""",
)
def recall_union(spark, d):
    """All six channels; clusters and factors are given, the others come from the tables."""
    t = tables_of(spark, d)
    last = sequences.last_n_interactions(t.interactions)
    channels = {
        **cascade.cf_channels(t),
        "category": content.category_recall(t.users, t.items),
        "keyword": content.keyword_recall(t.users, t.items),
        "cluster": vectors.cluster_recall(last, t.content_vectors, centres=_label_centres(spark, d)),
        "factor": cascade.factor_channel(_given_factors(spark, d), t.content_vectors, method="flat"),
    }
    return content.recall_union(channels).withColumn("channels", F.array_join("channels", ","))


@query(
    "case_search",
    """SELECT a.item_id AS query_id, b.item_id, round(list_cosine_similarity(a.v, b.v), 6) AS score,
      row_number() OVER (PARTITION BY a.item_id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.item_id) AS rank
    FROM (SELECT item_id, vector::DOUBLE[] AS v FROM content_vectors) a, (SELECT item_id, vector::DOUBLE[] AS v FROM content_vectors) b
    WHERE a.item_id <> b.item_id QUALIFY rank <= 3""",
)
def case_search(spark, d):
    v = views.content_vectors(spark, d)
    out = vectors.case_search(v.withColumnRenamed("item_id", "query_id"), v)
    return _rank_long(out).withColumn("score", F.round("score", 6))


@query("missing_vectors", "SELECT item_id FROM items WHERE item_id NOT IN (SELECT item_id FROM content_vectors)")
def missing_vectors(spark, d):
    return vectors.missing_vectors(views.items(spark, d), views.content_vectors(spark, d))


@query("vector_functions",
       """SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot,
       round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vector_functions(spark, d):
    v = views.table(spark, d, "embeddings")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(nxt, "vec_id").select(
        "vec_id", F.round(S.dot("embedding", "other"), 6).alias("dot"), F.round(S.cosine("embedding", "other"), 6).alias("cosine")
    )


@query("factor_recall")
def factor_recall(spark, d):
    return cascade.factor_recall(views.interactions(spark, d))


# ---- graph ------------------------------------------------------------------

VIEWS["edges"] = """
WITH p AS (SELECT DISTINCT user_id, item_id FROM interactions), du AS (SELECT user_id, count(*) AS n FROM p GROUP BY user_id),
  di AS (SELECT item_id, count(*) AS n FROM p GROUP BY item_id),
  e AS (SELECT 'u' || p.user_id AS u, 'i' || p.item_id AS i, 1.0 / sqrt(CAST(du.n AS DOUBLE) * di.n) AS weight
        FROM p JOIN du ON du.user_id = p.user_id JOIN di ON di.item_id = p.item_id)
SELECT u AS src, i AS dst, weight FROM e UNION ALL SELECT i, u, weight FROM e"""


@query("adjacency", "SELECT src, dst, round(weight, 6) AS weight FROM edges")
def adjacency(spark, d):
    lines = views.table(spark, d, "lineitem").count()
    return graph.adjacency(views.interactions(spark, d), lines).withColumn("weight", F.round("weight", 6))


VIEWS["layer0"] = "SELECT 'i' || vec_id AS node, unnest(range(64)) AS p, unnest(embedding)::DOUBLE AS x FROM embeddings"
VIEWS["layer1"] = "SELECT e.dst AS node, l.p, sum(e.weight * l.x) AS x FROM edges e JOIN layer0 l ON l.node = e.src GROUP BY ALL"
VIEWS["layer2"] = "SELECT e.dst AS node, l.p, sum(e.weight * l.x) AS x FROM edges e JOIN layer1 l ON l.node = e.src GROUP BY ALL"


@query(
    "graph_propagate",
    """WITH a AS (SELECT node, p, sum(x) / 3.0 AS x FROM (SELECT * FROM layer0 UNION ALL SELECT * FROM layer1 UNION ALL SELECT * FROM layer2) GROUP BY ALL)
    SELECT node, p AS dim, round(x, 6) + 0.0::DOUBLE AS value, round(sqrt(sum(x * x) OVER (PARTITION BY node)), 6) AS norm FROM a""",
)
def graph_propagate(spark, d):
    edges = graph.adjacency(views.interactions(spark, d), packed=True)
    vecs = views.content_vectors(spark, d).select(graph.item_node(F.col("item_id")).alias("node"), "vector")
    nodes, dims = graph.spread(vecs, "node", DIM)
    out = graph.propagate(edges, nodes, dims).withColumn("node", graph.node_name(F.col("node")))
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in dims), F.lit(0.0)))
    rows = out.select("node", F.round(norm, 6).alias("norm"), F.posexplode(F.array(*dims)).alias("dim", "x"))
    # adding 0.0 turns a rounded -0.0 into 0.0
    return rows.select("node", F.col("dim").cast("long").alias("dim"), (F.round("x", 6) + F.lit(0.0)).alias("value"), "norm")


# ---- sampling ---------------------------------------------------------------

VIEWS["item_idx"] = "SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM items"


@query(
    "sample_negatives",
    """WITH pos AS (SELECT DISTINCT user_id, item_id, order_key, line, price FROM interactions JOIN items USING (item_id)),
    neg AS (SELECT p.*, n AS draw, ('0x' || substr(md5('neg|' || user_id || '|' || item_id || '|' || order_key || '|' || line || '|' || n), 1, 15))::BIGINT
      % (SELECT count(*) FROM items) AS idx FROM pos p, range(1, 3) r(n))
    SELECT user_id, item_id, order_key, line, price, 1 AS label, 0 AS draw FROM pos
    UNION ALL SELECT user_id, i.item_id, order_key, line, price, -1, draw FROM neg JOIN item_idx i ON i.idx = neg.idx""",
)
def sample_negatives(spark, d):
    its = views.items(spark, d)
    lines = views.table(spark, d, "lineitem").count()
    pos = slices.distinct_rows(views.interactions(spark, d).select("user_id", "item_id", "order_key", "line"), lines)
    pos = pos.join(its.select("item_id", "price"), "item_id")
    return negatives.sample_negatives(pos, its, 2)


@query(
    "bpr_triples",
    """WITH h AS (SELECT user_id, min_by(item_id, md5('bpr|' || user_id || '|' || item_id || '|' || order_key || '|' || line) || lpad(item_id::VARCHAR, 12, '0')) AS pos_item
      FROM interactions GROUP BY user_id)
    SELECT h.user_id, pos_item, i.item_id AS neg_item FROM h JOIN item_idx i
      ON i.idx = ('0x' || substr(md5('bpr|n|' || h.user_id), 1, 15))::BIGINT % (SELECT count(*) FROM items)""",
)
def bpr_triples(spark, d):
    return negatives.bpr_triples(views.interactions(spark, d), views.items(spark, d))


# ---- encoding ---------------------------------------------------------------

@query("vocabulary", "SELECT name AS token, row_number() OVER (ORDER BY name) - 1 AS idx FROM (SELECT DISTINCT name FROM items)")
def vocabulary(spark, d):
    return encode.vocabulary(views.items(spark, d), "name")


@query(
    "vocab_union",
    """SELECT t AS token, row_number() OVER (ORDER BY t) - 1 AS idx FROM (SELECT author AS t FROM items UNION SELECT item_categories FROM items)""",
)
def vocab_union(spark, d):
    its = views.items(spark, d)
    return encode.vocab_union(encode.vocabulary(its, "author"), encode.vocabulary(its, "item_categories"))


@query(
    "encode_vocabulary",
    """WITH v AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS idx FROM (SELECT DISTINCT item_categories AS t FROM items WHERE price < 1000))
    SELECT item_id, coalesce(v.idx, 0) AS category_idx FROM items LEFT JOIN v ON v.t = item_categories""",
)
def encode_vocabulary(spark, d):
    its = views.items(spark, d)
    vocab = encode.vocabulary(its.where("price < 1000"), "item_categories")
    return encode.encode(its, "item_categories", vocab, "category_idx").select("item_id", "category_idx")


@query(
    "standard_scale",
    """SELECT item_id, round((price - (SELECT avg(price) FROM items)) / (SELECT stddev_pop(price) FROM items), 6) AS price_scaled FROM items""",
)
def standard_scale(spark, d):
    its = views.items(spark, d)
    out = encode.scale(its, ["price"], encode.scaler_stats(its, ["price"]))
    return out.select("item_id", F.round("price_scaled", 6).alias("price_scaled"))


def _partial_fit(spark, d, mode):
    its = views.items(spark, d)
    old, new = its.where("price < 1500"), its.where("price >= 1500")
    st = encode.partial_fit(old, new, ["price"], mode)
    return st.select(
        F.col("price.n").cast("long").alias("n"), F.round("price.mean", 6).alias("mean"),
        F.round(F.sqrt(F.col("price.m2") / F.col("price.n")), 6).alias("sigma"),
    )


@query("partial_fit", "SELECT count(*) AS n, round(avg(price), 6) AS mean, round(stddev_pop(price), 6) AS sigma FROM items")
def partial_fit(spark, d):
    return _partial_fit(spark, d, "merge")


@query(
    "partial_fit_refeed",
    """SELECT count(*) AS n, round(avg(price), 6) AS mean, round(stddev_pop(price), 6) AS sigma
    FROM (SELECT price FROM items WHERE price < 1500 UNION ALL SELECT price FROM items)""",
)
def partial_fit_refeed(spark, d):
    return _partial_fit(spark, d, "ref")


@query(
    "scene_columns",
    """SELECT user_id, item_id, order_key, line, CAST(hour(create_time) AS INTEGER) AS hour, is_weekend,
      CAST(create_time::DATE IN (SELECT o_orderdate::DATE FROM orders WHERE o_orderpriority LIKE '1%' AND o_totalprice > 490000) AS INTEGER) AS is_holiday
    FROM interactions""",
)
def scene_columns(spark, d):
    busy = views.table(spark, d, "orders").where("o_orderpriority LIKE '1%' AND o_totalprice > 490000")
    days = busy.select(F.col("o_orderdate").cast("date").alias("day"))
    out = encode.scene_columns(views.interactions(spark, d), days)
    return out.select("user_id", "item_id", "order_key", "line", "hour", "is_weekend", "is_holiday")


@query("rating", "SELECT user_id, item_id, order_key, line, click + cart + forward + buy AS rating FROM interactions")
def rating(spark, d):
    return views.interactions(spark, d).select("user_id", "item_id", "order_key", "line", S.rating().alias("rating"))


@query(
    "training_frame",
    """SELECT n.user_id, n.item_id, n.order_key, n.line, n.rating, u.gender, u.age, u.user_keywords, i.author, i.price, i.item_keywords
    FROM interactions n LEFT JOIN users u ON u.user_id = n.user_id LEFT JOIN items i ON i.item_id = n.item_id""",
)
def training_frame(spark, d):
    out = encode.training_frame(views.interactions(spark, d), views.users(spark, d), views.items(spark, d))
    return out.select(
        "user_id", "item_id", "order_key", "line", "rating", "gender", "age", "user_keywords", "author", "price", "item_keywords"
    )


VIEWS["item_3m"] = """SELECT item_id, sum(click) AS ic, sum(buy) AS ib FROM interactions
WHERE create_time > (SELECT max(create_time) FROM interactions) - INTERVAL 3 MONTH GROUP BY item_id"""
VIEWS["user_3m"] = """SELECT user_id, sum(click) AS uc, sum(buy) AS ub FROM interactions
WHERE create_time > (SELECT max(create_time) FROM interactions) - INTERVAL 3 MONTH GROUP BY user_id"""


def _with_stats(how: str) -> str:
    return f"""SELECT i.item_id, i.name, CAST(ic AS BIGINT) AS item_click_last3m, CAST(ib AS BIGINT) AS item_buy_last3m
    FROM items i {how} JOIN item_3m s ON s.item_id = i.item_id"""


def _items_with_stats(spark, d, how):
    t = tables_of(spark, d)
    out = tables.items_with_stats(t.items, cascade.last_stats(t)[1], how)
    return out.select("item_id", "name", "item_click_last3m", "item_buy_last3m")


@query("items_with_stats", _with_stats("LEFT"))
def items_with_stats(spark, d):
    return _items_with_stats(spark, d, "left")


@query("items_with_stats_inner", _with_stats("INNER"))
def items_with_stats_inner(spark, d):
    return _items_with_stats(spark, d, "inner")


@query(
    "user_x_candidates",
    """SELECT c.user_id, c.item_id, u.gender, u.age, 9 AS hour, 1 AS is_weekend, 0 AS is_holiday
    FROM category_recs c JOIN users u ON u.user_id = c.user_id""",
)
def user_x_candidates(spark, d):
    people = views.users(spark, d)
    pairs = content.category_recall(people, views.items(spark, d))
    # the users of a task are a small table; the pairs, many times as long, need no sort
    out = pairs.join(people.select("user_id", "gender", "age").hint("shuffle_hash"), "user_id")
    return encode.scene_for(out, 9, True, False)


def _idx_sql(column: str, source: str) -> str:
    return f"(SELECT {column} AS t, row_number() OVER (ORDER BY {column}) - 1 AS idx FROM (SELECT DISTINCT {column} FROM {source}))"


def _rank_features_sql() -> str:
    sources = {c: ("users", c) for c in encode.DISCRETE["user"]}
    sources |= {c: ("items", c.replace("item_city", "city")) for c in encode.DISCRETE["item"]}
    numbers = [*encode.CONTINUOUS, *encode.STATS]
    kinds = ("click", "cart", "buy", "forward")
    last = """SELECT {p}_id, {sums} FROM interactions
      WHERE create_time > (SELECT max(create_time) FROM interactions) - INTERVAL 3 MONTH GROUP BY {p}_id"""
    stats = {p: last.format(p=p, sums=", ".join(f"sum({k}) AS {p}_{k}_last3m" for k in kinds)) for p in ("user", "item")}
    tokens = ", ".join(f"{t[0]}.{column} AS {c}" for c, (t, column) in sources.items())
    counts = ", ".join(f"coalesce({c}, 0) AS {c}" for c in encode.STATS)
    moments = ", ".join(f"avg({c}) AS {c}_m, coalesce(nullif(stddev_pop({c}), 0), 1) AS {c}_s" for c in numbers)
    scaled = ", ".join(f"round(({c} - {c}_m) / {c}_s, 6) AS {c}_scaled" for c in numbers)
    vocabularies = " ".join(f"JOIN {_idx_sql(column, t)} v_{c} ON v_{c}.t = f.{c}" for c, (t, column) in sources.items())
    return f"""WITH us AS ({stats["user"]}), ns AS ({stats["item"]}),
    f AS (SELECT n.user_id, n.item_id, n.order_key, n.line, u.age, i.price, n.hour, n.is_weekend, 0 AS is_holiday, {tokens}, {counts}
      FROM interactions n LEFT JOIN users u ON u.user_id = n.user_id LEFT JOIN items i ON i.item_id = n.item_id
      LEFT JOIN us ON us.user_id = n.user_id LEFT JOIN ns ON ns.item_id = n.item_id),
    m AS (SELECT {moments} FROM f)
    SELECT f.user_id, f.item_id, order_key, line, {", ".join(f"v_{c}.idx AS {c}_idx" for c in sources)}, {scaled}
    FROM f {vocabularies}, m"""


@query("prepare_rank_features", _rank_features_sql())
def prepare_rank_features(spark, d):
    t = tables_of(spark, d)
    # whole texts in every row: stored by column they take a fraction
    frame = tables.store(cascade.raw_features(t, t.interactions.drop("create_time")), work_path(spark, "frame"))
    numbers = [*encode.CONTINUOUS, *encode.STATS]
    vocabularies = encode.feature_vocabularies(t.users, t.items)
    out = encode.prepare_rank_features(frame, vocabularies, encode.scaler_stats(frame, numbers))
    return out.select(
        "user_id", "item_id", "order_key", "line", *[f"{c}_idx" for c in vocabularies],
        *[F.round(f"{c}_scaled", 6).alias(f"{c}_scaled") for c in numbers],
    )


@query(
    "fusion",
    """SELECT user_id, item_id, order_key, line, round(pow(0.5 + 0.1 * click, 0.7) * pow(0.1 + 0.2 * cart, 0.6)
       * pow(0.1 + 0.3 * buy, 0.5) * pow(0.1 + 0.4 * forward, 0.5), 6) AS score FROM interactions""",
)
def fusion(spark, d):
    f = F.col
    score = S.fusion(0.5 + 0.1 * f("click"), 0.1 + 0.2 * f("cart"), 0.1 + 0.3 * f("buy"), 0.1 + 0.4 * f("forward"))
    return views.interactions(spark, d).select("user_id", "item_id", "order_key", "line", F.round(score, 6).alias("score"))


# ---- ranking ----------------------------------------------------------------

@query(
    "truncate_rough",
    """WITH s AS (SELECT user_id % 7 AS request_id, item_id, max(rating * 1000 + order_key % 1000) AS score FROM interactions GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, item_id) AS rank,
      count(*) OVER (PARTITION BY request_id) AS n FROM s)
    SELECT request_id, item_id, rank FROM r WHERE rank <= greatest(floor(sqrt(n)), 100)""",
)
def truncate_rough(spark, d):
    scored = views.interactions(spark, d).groupBy((F.col("user_id") % 7).alias("request_id"), "item_id").agg(
        F.max(F.col("rating") * 1000 + F.col("order_key") % 1000).alias("score")
    )
    return _rank_long(mmr.truncate_rough(scored)).select("request_id", "item_id", "rank")


VIEWS["mmr_pool"] = """
SELECT r.user_id AS request_id, r.item_id, CAST(r.score AS DOUBLE) AS relevance FROM item_cf_recs r"""


def _mmr_candidates(spark, d):
    recs = cf.item_cf_recommend(views.interactions(spark, d))
    return recs.join(views.content_vectors(spark, d), "item_id", "left").select(
        F.col("user_id").alias("request_id"), "item_id", F.round("score", 9).alias("relevance"), "vector"
    )


@query(
    "mmr_rerank",
    """WITH RECURSIVE v AS (SELECT item_id, list_transform(vector::DOUBLE[], lambda x: x / sqrt(list_dot_product(vector::DOUBLE[], vector::DOUBLE[]))) AS v FROM content_vectors),
    pool AS (SELECT user_id AS request_id, r.item_id, round(score, 9) AS relevance, v,
        row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, r.item_id) AS i FROM item_cf_recs r LEFT JOIN v ON v.item_id = r.item_id),
    alike AS (SELECT a.request_id, a.i, a.item_id, a.relevance,
        list(CASE WHEN a.v IS NULL OR b.v IS NULL THEN 0.0 ELSE list_dot_product(a.v, b.v) END ORDER BY b.i) AS sims
      FROM pool a JOIN pool b ON a.request_id = b.request_id GROUP BY ALL),
    step AS (SELECT request_id, 1 AS position, [CAST(1 AS BIGINT)] AS picks, 0.7 * relevance AS mmr FROM alike WHERE i = 1
      UNION ALL
      SELECT request_id, position + 1, list_append(any_value(picks), arg_max(i, (value, -i))), max(value) FROM (
        SELECT s.request_id, s.position, s.picks, c.i,
          round(0.7 * c.relevance - 0.3 * list_max(list_transform(s.picks[-30:], lambda p: c.sims[p])), 9) AS value
        FROM step s JOIN alike c ON c.request_id = s.request_id WHERE s.position < 50 AND NOT list_contains(s.picks, c.i))
      GROUP BY request_id, position)
    SELECT s.request_id, item_id, CAST(position AS INTEGER) AS position, floor(s.mmr * 1000000 + 0.0005) / 1000000 AS mmr
    FROM step s JOIN alike ON alike.request_id = s.request_id AND i = picks[position]""",
)
def mmr_rerank(spark, d):
    # values have nine decimals: cut to six, so that no rounding is halfway
    return mmr.mmr_rerank(_mmr_candidates(spark, d)).withColumn("mmr", F.floor(F.col("mmr") * 1_000_000 + 0.0005) / 1_000_000)


def _requests(t: cascade.Tables):
    people = t.users.select(F.col("user_id").alias("request_id"), "user_id")
    return encode.scene_for(people, 20, False, False)


def _ranked(spark, d, stages):
    """The stages over all six recall channels of all users."""
    t = tables_of(spark, d)
    a = cascade.fit(t, stages=stages)
    pool = content.recall_union(a.channels).select("user_id", "item_id")
    return cascade.rank_candidates(t, a, _requests(t).join(pool, "user_id"))


@query("rough_rank")
def rough_rank(spark, d):
    return _ranked(spark, d, ("rough",))[0]


@query("fine_rank")
def fine_rank(spark, d):
    return _ranked(spark, d, ("rough", "fine"))[1]


@query("cascade_recommend")
def cascade_recommend(spark, d):
    t = tables_of(spark, d)
    return cascade.cascade_recommend(t, cascade.fit(t), _requests(t))


@query("refit_on_new_data")
def refit_on_new_data(spark, d):
    """Fit on the older part, append the rest, rebuild what changed, recommend."""
    t = tables_of(spark, d)
    is_new = F.col("create_time") >= F.lit("2000-01-01").cast("timestamp_ntz")
    old = cascade.Tables(t.users, t.items, t.interactions.where(~is_new), t.content_vectors)
    merged, a = cascade.refit(old, cascade.fit(old), new_interactions=t.interactions.where(is_new))
    return cascade.cascade_recommend(merged, a, _requests(merged))


def _refitted(spark, d):
    """Neighbourhoods fitted on the older part, then brought up to date with the rest."""
    seen = materialise(views.interactions(spark, d).select("user_id", "item_id", "create_time", "order_key", "line", "rating"))
    old = seen.where(F.col("create_time") < F.lit("2000-01-01").cast("timestamp_ntz"))
    fitted = cascade.fit_sides(old)
    found = cascade.update_sides(fitted, seen)
    release(seen, *[table for side in fitted.values() for table in (side.cells, side.norms, side.partners)])
    return found


@query("refit_item_cf", "SELECT item_id, similar_item, round(sim, 6) AS sim, rank FROM item_sims")
def refit_item_cf(spark, d):
    return _rank_long(cf.as_item_sims(_refitted(spark, d)["item"].partners)).withColumn("sim", F.round("sim", 6))


@query("refit_user_cf", "SELECT user_id, similar_user, round(sim, 6) AS sim, rank FROM user_sims")
def refit_user_cf(spark, d):
    return _rank_long(cf.as_user_sims(_refitted(spark, d)["user"].partners)).withColumn("sim", F.round("sim", 6))


@query(
    "append_new_rows",
    """SELECT user_id, item_id, order_key, line, rating FROM interactions WHERE create_time < '2000-01-01'
    UNION ALL SELECT user_id, item_id, order_key, line, rating FROM interactions WHERE create_time >= '2000-01-01'""",
)
def append_new_rows(spark, d):
    seen = views.interactions(spark, d)
    cut = F.lit("2000-01-01").cast("timestamp_ntz")
    out = cascade.append_rows(seen.where(F.col("create_time") < cut), seen.where(F.col("create_time") >= cut))
    return out.select("user_id", "item_id", "order_key", "line", "rating")


# ---- trajectories -----------------------------------------------------------

T = trajectories
# the texts of summaries and case documents come from the operator's constants
TRAJECTORY_SQL = f"""q AS (SELECT session_id, min_by(substr(text, 1, {T.QUESTION_CHARS}), turn) FILTER (role = 'user') AS q,
        max_by(substr(text, 1, {T.ANSWER_CHARS}), turn) FILTER (role = 'assistant') AS a FROM sessions GROUP BY session_id),
    s AS (SELECT session_id, concat_ws('{T.SEPARATOR}', '{T.QUESTION}' || q, '{T.ANSWER}' || a) AS summary FROM q),
    c AS (SELECT session_id, turn // {T.CHUNK} AS chunk, count(*) AS n_turns,
        string_agg((CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END) || '=' || text, chr(10) ORDER BY turn) AS conversations
      FROM sessions GROUP BY 1, 2),
    t AS (SELECT c.*, s.summary, '{T.CASE_HEAD}' || summary || '{T.CASE_TOOLS}{T.NO_TOOLS}{T.CASE_SESSION}' || c.session_id || chr(10) AS case_document
      FROM c JOIN s ON s.session_id = c.session_id)"""


def _flat_trajectories(rows, *more: str):
    text = F.transform("conversations", lambda c: F.concat(c["from"], F.lit("="), c["value"]))
    return rows.select(
        *more, "session_id", "chunk", F.size("conversations").cast("long").alias("n_turns"),
        F.array_join(text, "\n").alias("conversations"), "summary", "case_document",
    )


@query("build_trajectories", f"WITH {TRAJECTORY_SQL} SELECT * FROM t")
def build_trajectories(spark, d):
    return _flat_trajectories(trajectories.build_trajectories(views.sessions(spark, d)))


# every conversation with a call, its result and a repeated call put before its turns
CALL_TEXT = '{"name": "look", "args": {"q": 1}}'


@query(
    "trajectory_tool_calls",
    """SELECT DISTINCT session_id, CAST(n AS BIGINT) AS place, 'look' AS name, '{"q":1}' AS args,
      CASE n WHEN 0 THEN 'seen ' || session_id END AS result, 1700000000 + n * 2 AS ts,
      CASE WHEN session_id % 2 = 0 THEN 1.0 END AS reward, '- look({"q":1})' || chr(10) || '- look({"q":1})' AS listed
    FROM sessions, (VALUES (0), (1)) v(n)""",
)
def trajectory_tool_calls(spark, d):
    said = views.sessions(spark, d).withColumn("ts", F.lit(1_700_000_009).cast("long"))
    first = said.select("session_id").distinct()
    made = F.array(
        F.struct(F.lit(-3).alias("turn"), F.lit("tool_call").alias("role"), F.lit(CALL_TEXT).alias("text"), F.lit(1_700_000_000).alias("ts")),
        F.struct(
            F.lit(-2).alias("turn"), F.lit("tool").alias("role"), F.concat(F.lit("seen "), "session_id").alias("text"),
            F.lit(1_700_000_001).alias("ts"),
        ),
        F.struct(F.lit(-1).alias("turn"), F.lit("function_call").alias("role"), F.lit(CALL_TEXT).alias("text"), F.lit(1_700_000_002).alias("ts")),
    )
    calls = first.select("session_id", F.explode(made).alias("m")).select("session_id", "m.*")
    turns = said.unionByName(calls.select("session_id", "turn", "role", "text", "ts"))
    rewards = first.where("session_id % 2 = 0").withColumn("reward", F.lit(1.0))
    out = trajectories.build_trajectories(turns, rewards=rewards)
    listed = F.split_part(F.split_part("case_document", F.lit(trajectories.CASE_TOOLS), F.lit(2)), F.lit(trajectories.CASE_SESSION), F.lit(1))
    rows = out.select("session_id", "reward", listed.alias("listed"), F.posexplode("tool_calls").alias("place", "c"))
    return rows.select("session_id", F.col("place").cast("long").alias("place"), "c.name", "c.args", "c.result", "c.ts", "reward", "listed")


@query("write_trajectories", f"WITH {TRAJECTORY_SQL} SELECT 'u' || (session_id % 10) AS user_id, t.* FROM t")
def write_trajectories(spark, d):
    path = work_path(spark, "trajectories")
    user = F.concat(F.lit("u"), F.col("session_id") % 10)
    trajectories.write_trajectories(trajectories.build_trajectories(views.sessions(spark, d)).withColumn("user_id", user), path)
    return _flat_trajectories(trajectories.read_trajectories(spark, path, "long"), "user_id")


@query(
    "clip_text",
    "SELECT session_id, turn, substr(text, 1, 100) AS question, substr(text, 1, 500) AS result FROM sessions",
)
def clip_text(spark, d):
    return views.sessions(spark, d).select(
        "session_id", "turn", S.clip_text("text", 100).alias("question"), S.clip_text("text", 500).alias("result")
    )


# ---- sources ----------------------------------------------------------------

@query(
    "read_behavior",
    """SELECT uid, logid, req_id, bhv_id, bhv_page, bhv_src, bhv_type, bhv_value, ts, ext_item_id, query,
       CASE WHEN bhv_type = 'show' THEN n_items ELSE -1 END AS n_items FROM behavior""",
)
def read_behavior(spark, d):
    """Events written as JSON lines and read back with the fixed schema."""
    path = work_path(spark, "behavior-json")
    views.behavior(spark, d).drop("arrival").withColumn("extra", F.lit("ignored")).write.json(path)
    out = tables.read_behavior(spark, path)
    return out.select(
        "uid", "logid", "req_id", "bhv_id", "bhv_page", "bhv_src", "bhv_type", "bhv_value", "ts",
        F.col("bhv_ext.item_id").alias("ext_item_id"), F.col("bhv_ext.query").alias("query"),
        F.coalesce(F.size("bhv_ext.items"), F.lit(-1)).cast("long").alias("n_items"),
    )


@query("read_dims", "SELECT item_id, category_id, brand, price FROM dim_item")
def read_dims(spark, d):
    path = work_path(spark, "dim-item")
    tables.write_dims(views.dim_item(spark, d), path)
    return tables.read_dims(spark, path, schemas.DIM_ITEM)


@query(
    "read_csv_tables",
    """SELECT 'items' AS tbl, item_id AS id, NULL AS item, name || '|' || author || '|' || city || '|' || item_categories || '|' ||
        array_to_string(list_sort(string_split(item_keywords, ';')), ',') AS texts, price AS amount, strftime(create_time, '%Y-%m-%d %H:%M:%S') AS at
      FROM items
    UNION ALL SELECT 'users', user_id, NULL, gender || '|' || user_categories || '|' || user_keywords, CAST(age AS DOUBLE), NULL FROM users
    UNION ALL SELECT 'interactions', user_id, item_id, concat_ws('|', hour, is_weekend, click, cart, forward, buy), CAST(rating AS DOUBLE),
        strftime(create_time, '%Y-%m-%d %H:%M:%S') FROM interactions""",
)
def read_csv_tables(spark, d):
    """The three tables written as CSV, read back and put under each other."""
    folder = work_path(spark, "csv")
    fmt = {"header": True, "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss", "emptyValue": ""}
    cols = [f.name for f in schemas.INTERACTIONS_CSV.fields]
    views.items(spark, d).write.options(**fmt).csv(f"{folder}/items.csv")
    views.users(spark, d).write.options(**fmt).csv(f"{folder}/users.csv")
    views.interactions(spark, d).select(*cols).write.options(**fmt).csv(f"{folder}/interactions.csv")
    out = tables.read_csv_tables(spark, folder)
    at = F.date_format("create_time", "yyyy-MM-dd HH:mm:ss").alias("at")
    words = F.array_join(F.array_sort(S.split_list("item_keywords")), ",")
    none = F.lit(None)
    items = out["items"].select(
        F.lit("items").alias("tbl"), F.col("item_id").alias("id"), none.cast("long").alias("item"),
        F.concat_ws("|", "name", "author", "city", "item_categories", words).alias("texts"), F.col("price").alias("amount"), at,
    )
    users = out["users"].select(
        F.lit("users").alias("tbl"), F.col("user_id").alias("id"), none.cast("long").alias("item"),
        F.concat_ws("|", "gender", "user_categories", "user_keywords").alias("texts"), F.col("age").cast("double").alias("amount"),
        none.cast("string").alias("at"),
    )
    seen = out["interactions"].select(
        F.lit("interactions").alias("tbl"), F.col("user_id").alias("id"), F.col("item_id").alias("item"),
        F.concat_ws("|", "hour", "is_weekend", "click", "cart", "forward", "buy").alias("texts"),
        F.col("rating").cast("double").alias("amount"), at,
    )
    return items.unionByName(users).unionByName(seen)


@query(
    "read_time_range",
    "SELECT user_id, item_id, order_key, line FROM interactions WHERE create_time BETWEEN '1996-01-01' AND '1998-12-31'",
)
def read_time_range(spark, d):
    out = tables.read_time_range(views.interactions(spark, d), "1996-01-01", "1998-12-31")
    return out.select("user_id", "item_id", "order_key", "line")


@query(
    "upsert_feature_table",
    """SELECT uid, bhv_page AS last_page, ts AS last_ts, arrival % 2 + 1 AS last_batch FROM behavior
    QUALIFY row_number() OVER (PARTITION BY uid ORDER BY arrival % 2 DESC, ts DESC) = 1""",
)
def upsert_feature_table(spark, d):
    """Two batches, the even arrivals and then the odd ones; the later batch wins."""
    path = work_path(spark, "features")
    rows = views.behavior(spark, d).select("uid", F.col("bhv_page").alias("last_page"), F.col("ts").alias("last_ts"), "arrival")
    for batch in (1, 2):
        part = rows.where(F.col("arrival") % 2 == batch - 1).withColumn("last_batch", F.lit(batch)).drop("arrival")
        feature_store.upsert_batch(part, path, batch, ["uid"], ["last_ts"], views.REQUEST_TS_MS, feature_store.TTL_MS["user_feature"])
    out = feature_store.read_features(spark, path, ["uid"], views.REQUEST_TS_MS)
    return out.select("uid", "last_page", "last_ts", "last_batch")


KEYED_COLUMNS = ("arrival", "pos", "ts", "req_id", "item_id", "category_id", "item_brand", "item_price", "user_city")


@query(
    "write_keyed_stream",
    """SELECT uid || '_' || category_id AS key, arrival, pos, ts, req_id, item_id, category_id, item_brand, item_price, user_city FROM dwd""",
)
def write_keyed_stream(spark, d):
    """The rows as keyed JSON, and what a consumer reads from the value."""
    from clickloom.plans.event_queries import dwd_of

    rows = dwd_of(spark, d)
    back = tables.keyed_json(rows, "uid", "category_id").select("key", F.from_json("value", rows.schema).alias("v"))
    return back.select("key", *[f"v.{c}" for c in KEYED_COLUMNS])


# ---- scalar functions -------------------------------------------------------

@query(
    "safe_parse",
    """SELECT event_id, coalesce(CASE WHEN regexp_full_match(value_text, '[+-]?[0-9]+') THEN TRY_CAST(value_text AS INTEGER) END, -1) AS as_int,
       coalesce(TRY_CAST(value_text AS DOUBLE), -1.0) AS as_double FROM (
       SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN user_id || '.5' WHEN 2 THEN 'n/a' END AS value_text FROM events)""",
)
def safe_parse(spark, d):
    e = F.col("event_id") % 4
    text = F.when(e == 0, F.col("user_id").cast("string")).when(e == 1, F.concat("user_id", F.lit(".5"))).when(e == 2, "n/a")
    return views.table(spark, d, "events").select(
        "event_id", S.safe_int(text, -1).alias("as_int"), S.safe_double(text, -1.0).alias("as_double")
    )


@query("minute_floor", "SELECT arrival, ts - ts % 60000 AS minute_start, ts // 60000 AS minute FROM behavior")
def minute_floor(spark, d):
    return views.behavior(spark, d).select("arrival", S.minute_floor("ts").alias("minute_start"), S.minute_index("ts").alias("minute"))


@query("local_day", "SELECT arrival, CAST(CAST(make_timestamp((ts_raw + 28800000) * 1000) AS DATE) AS VARCHAR) AS day FROM behavior")
def local_day(spark, d):
    return views.behavior(spark, d, "raw").select("arrival", S.local_date("ts").cast("string").alias("day"))


@query(
    "decay_factor",
    "SELECT arrival, round(exp(-ln(2.0) * greatest(0, 1706745600000 - ts_raw) / (7 * 86400000.0)), 6) AS factor FROM behavior",
)
def decay_factor(spark, d):
    return views.behavior(spark, d, "raw").select("arrival", F.round(S.decay_factor(F.lit(1706745600000) - F.col("ts")), 6).alias("factor"))


@query("fixed_decimal", "SELECT event_id, printf('%.4f', value / 7) AS four, printf('%.6f', value / 7) AS six FROM events")
def fixed_decimal(spark, d):
    v = F.col("value") / 7
    return views.table(spark, d, "events").select("event_id", S.fixed_decimal(v, 4).alias("four"), S.fixed_decimal(v, 6).alias("six"))


@query(
    "split_list",
    "SELECT user_id, array_to_string(string_split(user_keywords, ';'), '|') AS words, len(string_split(user_keywords, ';')) AS n FROM users",
)
def split_list(spark, d):
    words = S.split_list("user_keywords")
    return views.users(spark, d).select("user_id", F.array_join(words, "|").alias("words"), F.size(words).cast("long").alias("n"))


@query(
    "json_round_trip",
    "SELECT uid, arrival, ts, coalesce(n_items, 0) AS n_items, coalesce(query, '') AS query FROM behavior",
)
def json_round_trip(spark, d):
    text = views.behavior(spark, d).select("uid", "arrival", "ts", F.to_json("bhv_ext").alias("j"))
    back = text.withColumn("e", F.from_json("j", schemas.BEHAVIOR_EXT))
    return back.select(
        "uid", "arrival", "ts", F.coalesce(F.size("e.items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("e.query", F.lit("")).alias("query"),
    )


@query("dense_index", "SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS idx FROM customer")
def dense_index(spark, d):
    return slices.dense_index(views.table(spark, d, "customer").select("c_name"), ["c_name"])
