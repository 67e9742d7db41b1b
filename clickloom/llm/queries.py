"""One registered query per operator over its whole table, and the SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from clickloom.llm import (
    ann,
    bpe,
    divergence,
    html_text,
    lang_id,
    licenses,
    media,
    near_dups,
    packing,
    pii,
    prefix_trie,
    repeats,
    toxicity,
)
from clickloom.llm.common import prepare, table

Plan = Callable[[SparkSession, str], DataFrame]


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(prepare(spark), sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(prepare(spark), sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(prepare(spark), sf_dir, "embeddings"))


def op4_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return lang_id.identify(docs, lang_id.fit(docs))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return toxicity.rate(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(prepare(spark), sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(prepare(spark), sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(prepare(spark), sf_dir, "documents"), licenses.document_path())


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(prepare(spark), sf_dir, "pages"))


def op10_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(prepare(spark), sf_dir, "documents"), words=4)


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(prepare(spark), sf_dir, "conversations"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(prepare(spark), sf_dir, "documents"))


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(prepare(spark), sf_dir, "documents"))


QUERIES: dict[str, Plan] = {
    "op1_media": op1_media,
    "op2_pii": op2_pii,
    "op3_ann": op3_ann,
    "op4_lang_id": op4_lang_id,
    "op5_toxicity": op5_toxicity,
    "op6_bpe": op6_bpe,
    "op7_packing": op7_packing,
    "op8_licenses": op8_licenses,
    "op9_html": op9_html,
    "op10_near_dups": op10_near_dups,
    "op11_trie": op11_trie,
    "op12_divergence": op12_divergence,
    "op13_repeats": op13_repeats,
}

NEAR_DUPS_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS ss
  FROM w),
s AS (SELECT doc_id, unnest(ss) AS sh FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y
  WHERE 100 * c >= 80 * (len(a.ss) + len(b.ss) - c)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT doc_id, CAST(len(ss) AS BIGINT) AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id,
  doc_id <= coalesce(y, doc_id) AS kept
FROM sets LEFT JOIN least_of ON x = doc_id"""

DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS whole FROM w GROUP BY 1, 2 HAVING count(DISTINCT row) >= 10),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(whole) AS n FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, CAST(count(*) AS HUGEINT) AS c FROM w JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY 1, 2),
cell AS (SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c, whole,
    1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.c, 0) + 2)) // (coalesce(n.n, 0) + 2 * v.v) AS p,
    1 + (CAST(1000000000 AS HUGEINT) * (whole + 2)) // (v.n + 2 * v.v) AS q
  FROM g JOIN kept ON g.lang = kept.lang JOIN v ON g.lang = v.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
  LEFT JOIN n ON n.lang = g.lang AND n.source = g.source),
t AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM cell WHERE c > 0 AND p > q),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM t UNION ALL SELECT * FROM pr))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10"""

TRIE_SQL = r"""
WITH own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c, c - c % 100 AS base,
    list_transform(range(1, len(CAST(c AS VARCHAR)) + 1), lambda k: CAST(ascii(substr(CAST(c AS VARCHAR), k, 1)) AS BIGINT)) AS bytes FROM own),
crc AS (SELECT c, base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 6 AS h FROM ids),
turns AS (SELECT crc.c, 0 AS side, i, role, text FROM crc JOIN own ON own.c = base AND i <= h
  UNION ALL SELECT crc.c, 1, i, role, text FROM crc JOIN own ON own.c = crc.c AND i > h),
built AS (SELECT c, list({'role': role, 'text': text} ORDER BY side, i) AS ts FROM turns GROUP BY c),
every AS (SELECT crc.c, coalesce(ts, []) AS ts FROM crc LEFT JOIN built ON built.c = crc.c),
steps AS (SELECT c, len(ts) AS n, d, ts[1:d] AS k, CASE WHEN d > 0 THEN length(ts[d].text) ELSE 0 END AS chars
  FROM every, unnest(range(0, len(ts) + 1)) AS u(d)),
nodes AS (SELECT k, d, min(c) AS c, count(*) AS n_convs, max(chars) AS chars, count(*) FILTER (n = d) AS n_ends,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM steps GROUP BY k, d),
below AS (SELECT a.k, count(*) FILTER (b.d = a.d + 1) AS n_children, count(*) FILTER (b.n_ends = b.n_convs) AS n_leaves,
    sum((b.n_convs - 1) * b.chars) AS saved_tokens
  FROM nodes a JOIN nodes b ON b.d >= a.d AND b.k[1:a.d] = a.k GROUP BY a.k)
SELECT a.c AS conv_id, a.d AS depth, p.c AS parent_conv_id, a.n_convs, n_children, n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, a.ends_sha256
FROM nodes a JOIN below ON below.k = a.k LEFT JOIN nodes p ON a.d > 0 AND p.d = a.d - 1 AND p.k = a.k[1:a.d - 1]"""

REPEATS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT row, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM d, unnest(range(1, len(ws) - 11)) AS u(i)),
first_in AS (SELECT k, min(doc_id) AS least FROM w GROUP BY k),
gone AS (SELECT DISTINCT row, i + j AS i FROM w JOIN first_in USING (k), range(0, 13) AS r(j) WHERE doc_id > least),
words AS (SELECT row, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
kept AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (row, i) GROUP BY row)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (row)"""

ORACLE: dict[str, str] = {
    "op10_near_dups": NEAR_DUPS_SQL,
    "op11_trie": TRIE_SQL,
    "op12_divergence": DIVERGENCE_SQL,
    "op13_repeats": REPEATS_SQL,
}
