"""From raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns
a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.llm import exact_dedup, jaccard_join, packing, pii, quality
from rosterloom.llm.common import materialize, table, without

MARK = "_text_mark"

#: SQL cannot say the classifier, so there is none for the whole.
ORACLE_SQL = None


def _marked(docs: DataFrame) -> DataFrame:
    """With a hash of the text, which tells rows apart that repeat a doc_id."""
    return docs.withColumn(MARK, F.xxhash64("text"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.rate(docs, model).where(quality.selected()).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id stays."""
    marked = _marked(docs)
    groups = exact_dedup.exact_groups(marked, carry=(MARK,))
    return without(marked, groups.where("NOT kept"), "doc_id", MARK).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a class of near copies, the document with the smallest doc_id stays."""
    marked = _marked(docs)
    classes = jaccard_join.jaccard_classes(marked, carry=(MARK,))
    dropped = classes.where(~F.col("doc_id").eqNullSafe(F.col("class_id")))
    return without(marked, dropped, "doc_id", MARK).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind; ``n_chars`` follows the new text."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", mask_personal_data),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
