"""Prompt assembly and model responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.functions.text import is_missing, json_object_text, null_words, strip, strip_fence, strip_tags
from rosterloom.operators.skew import explode_rows, salted_lookup
from rosterloom.schema import FIELDS, column_name

# --- fixed value: request put around the text of a mail -------------------------
REQUEST = (
    "Please extract provider roster information from the following email content:\n\n",
    "\n\nReturn the data in the exact JSON format specified in the system prompt.",
)
# --- end of fixed value -----------------------------------------------------------


def _part(label: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label + ": "), value))


def prompt_text(text: Column, html: Column, attachment_names: Column, document_type: Column) -> Column:
    """Text of one mail given to a model: the classified body, then its HTML and
    plain form, then the names of text attachments, parted by blank lines."""
    plain = document_type == "PLAIN_TEXT"
    body = F.coalesce(F.nullif(text, F.lit("")), html)
    parts = F.array(
        F.when(plain, _part("Email Content", body)),
        F.when(~plain, _part("HTML Table Content", strip_tags(html))),
        _part("HTML Content", strip_tags(html)),
        _part("Plain Text", text),
    )
    names = F.transform(
        F.coalesce(attachment_names, F.array().cast("array<string>")), lambda n: F.concat(F.lit("Attachment: "), n)
    )
    return F.concat_ws("\n\n", F.array_compact(F.concat(parts, names)))


def user_prompt(content: Column) -> Column:
    before, after = REQUEST
    return F.concat(F.lit(before), content, F.lit(after))


def parse_model_rows(response: Column) -> Column:
    """``array<map>`` of a response: a JSON list of objects, or one object."""
    body = strip_fence(response)
    many = F.from_json(body, "array<map<string,string>>")
    one = F.from_json(body, "map<string,string>")
    rows = F.when(F.startswith(body, F.lit("[")), many).otherwise(F.array(one))
    return F.coalesce(F.array_compact(rows), F.array().cast("array<map<string,string>>"))


def model_maps(df: DataFrame, response: str = "response", data: str = "data") -> DataFrame:
    """The rows of each response as ``row_idx`` and a map of its known fields that
    have a value; rows without any value are dropped."""
    known = F.array(*[F.lit(f) for f in FIELDS])

    def cleaned(row: Column) -> Column:
        mine = F.map_filter(row, lambda k, v: F.array_contains(known, k))
        return F.map_filter(
            F.transform_values(mine, lambda k, v: null_words(v)), lambda k, v: v.isNotNull() & (v != "")
        )

    parsed = df.withColumn("_parsed", parse_model_rows(F.col(response))).drop(response)
    filled = F.filter(F.transform("_parsed", cleaned), lambda m: F.size(m) > 0)
    return explode_rows(parsed.withColumn("_rows", filled).drop("_parsed"), "_rows", data, "row_idx")


def clean_model_rows(df: DataFrame, response: str = "response") -> DataFrame:
    """Typed rows of each response; rows without any value are dropped."""
    rows = model_maps(df, response, "_row")
    typed = [F.try_element_at("_row", F.lit(f)).alias(column_name(f)) for f in FIELDS]
    return rows.select(
        *[c for c in rows.columns if c != "_row"],
        *typed,
        F.lit(0.9).alias("confidence"),
        F.lit("llm").alias("extraction_method"),
    )


def extract_json(response: Column) -> Column:
    """Object inside a text as ``map<string,string>``; NULL if it does not parse."""
    parsed = F.from_json(json_object_text(response), "map<string,string>")
    valid = F.try_parse_json(json_object_text(response)).isNotNull()
    return F.when(valid, parsed)


def mapping_entries(response: Column) -> Column:
    """``mappings`` of a header-mapping answer; NULL without a JSON object."""
    kind = "struct<mappings: array<struct<source: string, target: string, confidence: double>>>"
    body = json_object_text(response)
    empty = F.array().cast("array<struct<source: string, target: string, confidence: double>>")
    return F.when(body.isNotNull(), F.coalesce(F.from_json(body, kind)["mappings"], empty))


def classification_entries(response: Column) -> Column:
    """``Type:``, ``Confidence:`` and ``Reasoning:`` lines of an answer."""
    line = lambda name: F.nullif(
        F.regexp_extract(response, rf"(?s).*(?:^|\n){name}:[ \t]*([^\n]*)", 1), F.lit("")
    )
    return F.struct(
        F.coalesce(strip(line("Type")), F.lit("UNKNOWN")).alias("document_type"),
        F.coalesce(strip(line("Confidence")).try_cast("double"), F.lit(0.5)).alias("confidence"),
        F.coalesce(strip(line("Reasoning")), F.lit("Unable to parse response")).alias("reasoning"),
    )


def prefer_source(df: DataFrame, job: list[str], source: str, order: list[str], spread: list[str]) -> DataFrame:
    """Rows of the first source, in ``order``, that a job has any rows of.

    The choice is a partially aggregated minimum per job; a job with most rows is
    spread over the salts of the lookup."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(source))
    ranked = df.withColumn("_rank", rank).where("_rank > 0")
    chosen = ranked.groupBy(*job).agg(F.min("_rank").alias("_chosen"))
    return (
        salted_lookup(ranked, chosen, job, spread, how="inner").where("_rank = _chosen").drop("_rank", "_chosen")
    )


def merge_by_coverage(df: DataFrame, job: list[str], source: str, first: str, second: str, spread: list[str]) -> DataFrame:
    """Rows of ``second`` for jobs where it has more rows, of ``first`` otherwise."""
    counts = df.groupBy(*job).agg(
        F.count_if(F.col(source) == first).alias("_a"), F.count_if(F.col(source) == second).alias("_b")
    )
    chosen = counts.select(*job, F.when(F.col("_b") > F.col("_a"), second).otherwise(first).alias("_chosen"))
    return salted_lookup(df, chosen, job, spread, how="inner").where(F.col(source) == F.col("_chosen")).drop("_chosen")


def extraction_statistics(df: DataFrame, job: list[str]) -> DataFrame:
    """Rows and mean confidence per job and method."""
    return df.groupBy(*job, "extraction_method").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg("confidence"), 4).alias("avg_confidence")
    )


def needs_assistance(artifacts: DataFrame, rows: DataFrame, job: list[str], artifact: list[str]) -> DataFrame:
    """Jobs with an artifact that gave no row, or without any row."""
    filled = rows.groupBy(*artifact).agg(F.count(F.lit(1)).alias("_rows"))
    seen = artifacts.select(*artifact, *[c for c in job if c not in artifact]).join(filled, artifact, "left")
    return seen.groupBy(*job).agg(
        F.bool_or(F.col("_rows").isNull()).alias("needs_assistance"),
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("total_rows"),
    )


def field_coverage(df: DataFrame) -> DataFrame:
    """Share of rows with a real value, per target field: one aggregation and one
    unpivot of its single row."""
    share = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(~is_missing(F.col(column_name(f)))).alias(column_name(f)) for f in FIELDS]
    )
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(column_name(f)).alias("filled")) for f in FIELDS])
    return share.select("_n", F.explode(pairs).alias("p")).select(
        "p.field", "p.filled", F.round(F.col("p.filled") / F.nullif(F.col("_n"), F.lit(0)), 4).alias("coverage")
    )
