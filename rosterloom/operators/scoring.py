"""Training samples and completion scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rosterloom.functions import rewards
from rosterloom.operators.responses import extract_json
from rosterloom.operators.skew import salted_lookup

REWARDS = ["json_format", "name", "dates", "line_of_business", "phone", "npi", "full"]


def score(df: DataFrame, completion: str = "completion", answer: str = "answer") -> DataFrame:
    """Seven scores and their total for each completion, one narrow projection."""
    parsed = df.withColumns({"_data": extract_json(F.col(completion)), "_answer": extract_json(F.col(answer))})
    data = F.col("_data")
    scored = parsed.withColumns(
        {
            "json_format": rewards.json_format_reward(data),
            "name": rewards.name_check(data),
            "dates": rewards.date_check(data),
            "line_of_business": rewards.line_of_business_check(data),
            "phone": rewards.phone_number_check(data),
            "npi": rewards.npi_format_check(data),
            "full": rewards.full_check(data, F.col("_answer")),
        }
    )
    total = sum((F.col(r) for r in REWARDS[1:]), F.col(REWARDS[0]))
    return scored.withColumn("total", F.round(total, 6)).drop("_data", "_answer")


def group_advantage(df: DataFrame, prompt: str, spread: list[str], total: str = "total") -> DataFrame:
    """Score relative to the other completions of its prompt: the distance from
    the mean in standard deviations, 0 when all are equal.

    Means are aggregated first and looked up with salts, so a prompt with most of
    the completions is no single window."""
    stats = df.groupBy(prompt).agg(F.avg(total).alias("_mean"), F.stddev_samp(total).alias("_sd"))
    joined = salted_lookup(df, stats, [prompt], spread)
    flat = F.coalesce(F.col("_sd"), F.lit(0.0)) < 1e-9
    advantage = F.when(flat, 0.0).otherwise((F.col(total) - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0)))
    return joined.withColumn("advantage", F.round(advantage, 6) + F.lit(0.0)).drop("_mean", "_sd")


def clean_fields(fields: Column) -> Column:
    """Sample fields without title, degree and plan kinds."""
    return F.transform_values(
        fields,
        lambda k, v: F.when(
            k == "Provider Name", F.regexp_replace(F.regexp_replace(v, r"^Dr\. ", ""), ", MD$", "")
        )
        .when(k == "Line Of Business", F.regexp_replace(v, " ?(?:PPO|HMO)", ""))
        .otherwise(v),
    )


def drop_subject(body: Column) -> Column:
    """Mail text without a leading line that names the subject."""
    return F.when(
        F.contains(F.substring_index(body, "\n", 1), F.lit("Subject")),
        F.when(F.contains(body, F.lit("\n")), F.regexp_replace(body, r"^[^\n]*\n", "")).otherwise(""),
    ).otherwise(body)


def indented_json(fields: Column) -> Column:
    """Object text with one field per line, indented by four blanks."""
    quoted = lambda v: F.regexp_replace(F.to_json(F.array(v)), r"^\[|\]$", "")
    lines = F.transform(
        F.map_entries(fields),
        lambda e: F.concat(
            F.lit("    "), quoted(e["key"]), F.lit(": "), F.when(e["value"].isNull(), "null").otherwise(quoted(e["value"]))
        ),
    )
    return F.when(F.size(lines) == 0, "{}").otherwise(F.concat(F.lit("{\n"), F.array_join(lines, ",\n"), F.lit("\n}")))


def chat_samples(
    df: DataFrame, system_prompt: str, user_prompt: str, end: str = "", body: str = "email_body", fields: str = "extracted_fields"
) -> DataFrame:
    """``text``, ``prompt`` and ``answer`` of each sample.  ``user_prompt`` holds
    ``{email}`` where the mail goes."""
    before, _, after = user_prompt.partition("{email}")
    user = F.concat(F.lit(f"{system_prompt}{end}User: {before}"), drop_subject(F.col(body)), F.lit(f"{after}{end}"))
    answer = indented_json(clean_fields(F.col(fields)))
    return df.select(
        "*",
        F.concat(user, F.lit("Assistant: "), answer, F.lit(end)).alias("text"),
        F.concat(user, F.lit("Assistant: ")).alias("prompt"),
        F.concat(answer, F.lit(end)).alias("answer"),
    )


def shuffled(df: DataFrame, key: list[str], seed: int = 0) -> DataFrame:
    """Repeatable random order: a range-partitioned sort by a keyed hash."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key)


def shuffle_places(df: DataFrame, key: list[str], seed: int = 0, digits: int = 4) -> DataFrame:
    """Add ``place``, the row's number from 0 in a random order that depends on the
    seed and the keys alone: that of a SHA-256 of both.

    The order is cut into ``16 ** digits`` ranges by the hash's first digits.  Each
    range is sorted for itself, and only one count per range goes through the
    running sum, so there is no sort of all rows in one place.  Rows that repeat a
    key follow each other."""
    marked = df.withColumn("_mark", F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]), 256))
    ranged = marked.withColumn("_range", F.substring("_mark", 1, digits))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_mark", *key)) - 1
    numbered = ranged.withColumn("_inside", inside).join(starts, "_range")
    return numbered.select(*df.columns, (F.col("_start") + F.col("_inside")).cast("bigint").alias("place"))
