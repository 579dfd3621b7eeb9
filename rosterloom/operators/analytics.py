"""Job, issue and latency reports.  All of them are partial aggregations over
keys that the report itself bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.operators.skew import salted_lookup
from rosterloom.schema import JOB_STATUSES, LATENCY_BUCKETS


def job_status(jobs: DataFrame) -> DataFrame:
    """One row: the total and the count of each status."""
    return jobs.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_jobs") for s in JOB_STATUSES],
    )


def status_share(jobs: DataFrame) -> DataFrame:
    """Count and percentage of each status; the window runs over one row per status."""
    counts = jobs.groupBy("status").agg(F.count(F.lit(1)).alias("jobs"))
    total = jobs.agg(F.count(F.lit(1)).alias("_total"))
    return counts.sparkSession.sql(
        "SELECT status, jobs, round(jobs * 100.0D / (SELECT _total FROM {total}), 1) AS share FROM {counts}",
        counts=counts,
        total=total,
    )


def analytics(jobs: DataFrame, exports: DataFrame) -> DataFrame:
    """One row of totals, mean minutes of finished jobs, exports and success rate."""
    done = F.col("status").isin("ready", "exported")
    minutes = (F.unix_micros(F.col("updated_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 60e6
    figures = jobs.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.count_if(done).alias("completed_jobs"),
        F.count_if(F.col("status").isin("pending", "processing")).alias("pending_jobs"),
        F.count_if(F.col("status") == "failed").alias("error_jobs"),
        F.round(F.avg(F.when(done, minutes)), 9).alias("avg_processing_minutes"),
        F.round(F.count_if(done) * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0)), 1).alias("success_rate"),
    )
    total = exports.agg(F.count(F.lit(1)).alias("_n"))
    return jobs.sparkSession.sql(
        "SELECT *, (SELECT _n FROM {total}) AS total_exports FROM {figures}", figures=figures, total=total
    )


def daily_activity(jobs: DataFrame, exports: DataFrame) -> DataFrame:
    """Jobs and exports per day, as one aggregation over both."""
    day = F.to_date("created_at").alias("day")
    both = jobs.select(day, F.lit(1).alias("j"), F.lit(0).alias("e")).unionAll(
        exports.select(day, F.lit(0).alias("j"), F.lit(1).alias("e"))
    )
    return both.groupBy("day").agg(F.sum("j").alias("jobs"), F.sum("e").alias("exports"))


def issue_heat_map(issues: DataFrame) -> DataFrame:
    return issues.groupBy("field", "level").agg(F.count(F.lit(1)).alias("issues"))


def hot_senders(jobs: DataFrame, emails: DataFrame, levels: DataFrame) -> DataFrame:
    """Errors in the jobs of each sender; the caller orders and limits.  ``levels`` has one row per job."""
    mail = emails.select(F.col("id").alias("email_id"), "from_addr")
    return (
        salted_lookup(jobs, mail, ["email_id"], ["job_id"], how="inner")
        .join(levels.select("job_id", "error_count"), "job_id", "left")
        .groupBy("from_addr")
        .agg(F.count(F.lit(1)).alias("jobs"), F.coalesce(F.sum("error_count"), F.lit(0)).alias("errors"))
    )


def fallback_rate(rows: DataFrame, fallback: str) -> DataFrame:
    """Share of rows that came from the fallback method, per job type."""
    return rows.groupBy("document_type").agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.count_if(F.col("extraction_method") == fallback) / F.count(F.lit(1)), 4).alias("fallback_rate"),
    )


def edits_per_job(versions: DataFrame) -> DataFrame:
    """User-made versions per job."""
    return versions.groupBy("job_id").agg(
        F.count_if(F.col("author") == "user").alias("edits"), F.count(F.lit(1)).alias("versions")
    )


def stage_runs(events: DataFrame) -> DataFrame:
    """Runs, errors and mean duration per stage and status."""
    return events.groupBy("agent", "status").agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg("duration_s"), 9).alias("avg_seconds")
    )


def latency_histogram(events: DataFrame, buckets: list[float] | None = None, key: str = "agent") -> DataFrame:
    """Cumulative counts per upper bound, as a metrics histogram keeps them: one
    aggregation, then an unpivot of one row per stage."""
    bounds = buckets or LATENCY_BUCKETS
    wide = events.groupBy(key).agg(
        *[F.count_if(F.col("duration_s") <= b).alias(f"_b{i}") for i, b in enumerate(bounds)],
        F.count(F.lit(1)).alias("_all"),
    )
    pairs = [F.struct(F.lit(str(b)).alias("le"), F.col(f"_b{i}").alias("runs")) for i, b in enumerate(bounds)]
    pairs.append(F.struct(F.lit("+Inf").alias("le"), F.col("_all").alias("runs")))
    return wide.select(key, F.explode(F.array(*pairs)).alias("p")).select(key, "p.*")


def recent_activity(audit: DataFrame, count: int = 10) -> DataFrame:
    return audit.orderBy(F.desc("created_at"), F.desc("audit_id")).limit(count)
