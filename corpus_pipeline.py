"""The corpus pipeline: five stages over ``documents``, each written and read again before the next.

Language identification, toxicity, near-duplicates, personal data, packing. The first three
drop rows, the fourth rewrites texts, the last returns the packing of what is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clickloom.llm import lang_id, near_dups, packing, pii, toxicity
from clickloom.llm.common import prepare, table
from clickloom.session import work_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; learns from ``documents`` as given, without held-out rows."""
    prepare(spark)
    return lang_id.keep_identified(docs, lang_id.fit(table(spark, sf_dir, "documents")))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are not predicted toxic; learns from ``documents`` and ``labels``."""
    prepare(spark)
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: five-word shingles, similarity 0.8."""
    prepare(spark)
    return near_dups.keep_one(docs)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; ``n_chars`` follows the new text."""
    prepare(spark)
    return pii.mask(docs, chars_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and batches of the documents left."""
    prepare(spark)
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("toxicity", toxic),
    ("near_dedup", dedup),
    ("pii", privacy),
    ("packing", packed),
]

# the trained models of the first stages have no SQL form
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = work_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
