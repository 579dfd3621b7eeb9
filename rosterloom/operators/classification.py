"""Classification of whole mails and the routes that follow from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.functions.classify import attachment_type, body_type, processing_strategy

# Limits of processing.
MAX_PAGES = 10
CONFIDENCE_THRESHOLD = 0.7


def classify_bodies(df: DataFrame, text: str = "text", html: str = "html") -> DataFrame:
    """Adds the body classification, flattened."""
    kind = df.withColumn("_kind", body_type(F.col(text), F.col(html)))
    return kind.select(
        *df.columns,
        *[F.col(f"_kind.{c}").alias(c) for c in ("document_type", "confidence", "extraction_method", "content")],
        *[
            F.col(f"_kind.metadata.{c}").alias(c)
            for c in ("has_html", "has_text", "table_count", "headers_found", "tabular_lines", "total_lines")
        ],
    )


def classify_attachments(df: DataFrame, filename: str = "filename", mime: str = "content_type") -> DataFrame:
    kind = df.withColumn("_kind", attachment_type(F.col(filename), F.col(mime)))
    return kind.select("*", "_kind.*").drop("_kind")


def mail_strategy(artifacts: DataFrame, key: list[str]) -> DataFrame:
    """Strategy per mail from classified artifacts: two partial aggregates."""
    assisted = (F.col("extraction_method") == "vlm_assisted") | (F.col("document_type") == "PDF_UNKNOWN")
    grouped = artifacts.groupBy(*key).agg(
        F.bool_or(assisted).alias("_assisted"), F.count(F.lit(1)).alias("_artifacts")
    )
    return grouped.select(*key, processing_strategy(F.col("_assisted"), F.col("_artifacts")).alias("s")).select(*key, "s.*")


def processing_parameters(artifacts: DataFrame, key: list[str], order: str = "artifact_idx") -> DataFrame:
    """Per mail: the types of its artifacts in their order, their number, and the
    page and confidence limits they are processed under.  A mail is bounded by the
    intake limit, and so is its list."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_at"), "document_type")))
    grouped = artifacts.groupBy(*key).agg(listed.alias("_types"))
    return grouped.select(
        *key,
        F.transform("_types", lambda t: t["document_type"]).alias("document_types"),
        F.size("_types").alias("artifact_count"),
        F.lit(MAX_PAGES).alias("max_pages"),
        F.lit(CONFIDENCE_THRESHOLD).alias("confidence_threshold"),
    )


def route(jobs: DataFrame) -> DataFrame:
    """Next step of a job from its flags."""
    return jobs.select(
        "*",
        F.when(F.col("needs_assistance"), "assist").otherwise("normalize").alias("after_extraction"),
        F.when(F.col("needs_review"), "review").otherwise("version").alias("after_validation"),
    )
