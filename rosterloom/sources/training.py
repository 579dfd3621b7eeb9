"""Training samples and extraction results as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SAMPLE_SCHEMA = "email_body string, extracted_fields map<string,string>"


def read_training_json(spark: SparkSession, path: str) -> DataFrame:
    """Files that each hold a JSON array of samples.  Such a file is one token
    stream, so files and not their parts are the units of parallel reading."""
    return spark.read.schema(SAMPLE_SCHEMA).option("multiLine", True).json(path)


def write_results(df: DataFrame, path: str) -> None:
    """``email`` and ``extracted_data``, one JSON object per line."""
    df.select("email", "extracted_data").write.mode("errorifexists").json(path)
