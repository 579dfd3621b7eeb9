"""Job lists, job details and lifecycle rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.operators.skew import salted_lookup
from rosterloom.schema import ISSUE_LEVELS, JOB_STATUSES


def jobs_with_mail(jobs: DataFrame, emails: DataFrame) -> DataFrame:
    """Jobs with their mail, equi-joined on the mail id."""
    mail = emails.select(F.col("id").alias("email_id"), "message_id", "from_addr", "subject", "received_at")
    return salted_lookup(jobs, mail, ["email_id"], ["job_id"], how="inner")


def list_jobs(jobs: DataFrame, skip: int = 0, limit: int = 100, status: str | None = None) -> DataFrame:
    """One page of jobs, newest first, with the total and ``has_more``.

    Sorting keeps only ``skip + limit`` rows per task; the total is a separate
    count joined as a one-row scalar subquery."""
    if status is not None and status not in JOB_STATUSES:
        raise ValueError(f"Invalid status: {status}")
    chosen = jobs if status is None else jobs.where(F.col("status") == status)
    page = chosen.orderBy(F.desc("created_at"), F.desc("job_id")).offset(skip).limit(limit)
    spark = jobs.sparkSession
    return spark.sql(
        "SELECT *, (SELECT count(*) FROM {chosen}) AS total,"
        " (SELECT count(*) FROM {chosen}) > {upto} AS has_more FROM {page}",
        chosen=chosen,
        page=page,
        upto=skip + limit,
    )


def latest_jobs(jobs: DataFrame, count: int = 50) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(count)


def find_duplicates(mails: DataFrame, known: DataFrame) -> DataFrame:
    """Mails already known by message id or by content hash.

    The OR is two equi-joins, each with one row per key on the right."""
    by_id = known.groupBy("message_id").agg(F.min("id").alias("existing_id"))
    by_hash = known.groupBy("hash").agg(F.min("id").alias("existing_hash_id"))
    by_either = salted_lookup(salted_lookup(mails, by_id, ["message_id"], ["id"]), by_hash, ["hash"], ["id"])
    return (
        by_either.where("existing_id IS NOT NULL OR existing_hash_id IS NOT NULL")
        .withColumn("existing_id", F.least("existing_id", "existing_hash_id"))
        .drop("existing_hash_id")
    )


def issues_of_jobs(issues: DataFrame, versions: DataFrame, job_ids: DataFrame) -> DataFrame:
    """Issues of all versions of some jobs."""
    wanted = salted_lookup(versions, job_ids, ["job_id"], ["version_id"], how="left_semi").select("version_id")
    return salted_lookup(issues, wanted, ["version_id"], issues.columns, how="left_semi")


def issue_levels(issues: DataFrame, key: list[str]) -> DataFrame:
    """Issue counts per level in fixed columns."""
    return issues.groupBy(*key).agg(
        *[F.count_if(F.col("level") == level).alias(f"{level}_count") for level in ISSUE_LEVELS]
    )


def job_details(jobs: DataFrame, versions: DataFrame, records: DataFrame, issues: DataFrame, exports: DataFrame) -> DataFrame:
    """One summary row per job.  Every right side is aggregated to its key before
    it is joined, so no join multiplies rows.  Lists of versions and exports stay
    relations of their own: one job may own any number of them."""
    rows = records.groupBy("version_id").agg(F.count(F.lit(1)).alias("total_records"))
    levels = issue_levels(issues, ["version_id"])
    version_counts = versions.groupBy("job_id").agg(F.count(F.lit(1)).alias("versions"))
    export_counts = exports.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("exports"), F.max(F.struct("created_at", "file_uri"))["file_uri"].alias("latest_export")
    )
    current = rows.join(levels, "version_id", "full").withColumnRenamed("version_id", "current_version_id")
    joined = (
        jobs.join(current, "current_version_id", "left")
        .join(version_counts, "job_id", "left")
        .join(export_counts, "job_id", "left")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    counts = {c: zero(c) for c in ["total_records", *[f"{x}_count" for x in ISSUE_LEVELS], "versions", "exports"]}
    return joined.withColumns(counts).withColumn("issues_count", sum((F.col(f"{x}_count") for x in ISSUE_LEVELS[1:]), F.col("error_count")))


def is_stuck(as_of: Column, minutes: int) -> Column:
    """Pending or processing, and idle for longer than ``minutes``."""
    idle = F.col("updated_at") < as_of - F.make_dt_interval(mins=F.lit(minutes))
    return F.coalesce(F.col("status").isin("pending", "processing") & idle, F.lit(False))


def stuck_jobs(jobs: DataFrame, as_of: Column, minutes: int = 3) -> DataFrame:
    return jobs.where(is_stuck(as_of, minutes))


def fail_stuck(jobs: DataFrame, as_of: Column, minutes: int = 3) -> tuple[DataFrame, DataFrame]:
    """Jobs with the stuck ones failed, and the audit rows of that."""
    marked = jobs.withColumn("_stuck", is_stuck(as_of, minutes))
    failed = F.to_json(F.struct(F.lit("failed").alias("status")))
    audit = audit_entry(marked.where("_stuck"), "system", "job_timeout", as_of, F.to_json(F.struct("status")), failed)
    new_jobs = marked.select(
        *[
            F.when(F.col("_stuck"), "failed").otherwise(F.col(c)).alias(c)
            if c == "status"
            else F.when(F.col("_stuck"), as_of).otherwise(F.col(c)).alias(c)
            if c == "updated_at"
            else F.col(c)
            for c in jobs.columns
        ]
    )
    return new_jobs, audit


def reprocessable(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin("pending", "failed"))


def audit_entry(df: DataFrame, actor: str, action: str, at: Column, before: Column | None = None, after: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        "job_id",
        F.lit(actor).alias("actor"),
        F.lit(action).alias("action"),
        (none if before is None else before).alias("before_json"),
        (none if after is None else after).alias("after_json"),
        at.alias("created_at"),
    )
