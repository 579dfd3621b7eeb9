"""Append-only versions of a job's rows: edit, roll back, compare, trace."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.operators.skew import lookup_parts, salted_lookup
from rosterloom.schema import FIELDS, column_name
from rosterloom.session import ensure_checkpoint_dir


def latest_versions(versions: DataFrame, job: str = "job_id", at: str = "created_at", version: str = "version_id") -> DataFrame:
    """Newest version of each job; a partially aggregated maximum, no sort."""
    newest = F.max(F.struct(at, version)).alias("_v")
    return versions.groupBy(job).agg(newest, F.count(F.lit(1)).alias("versions")).select(
        job, F.col("_v")[version].alias(version), F.col("_v")[at].alias(at), "versions"
    )


def version_history(versions: DataFrame, records: DataFrame, issues: DataFrame, version: str = "version_id") -> DataFrame:
    """Versions with their record and issue counts."""
    rows = records.groupBy(version).agg(F.count(F.lit(1)).alias("record_count"))
    found = issues.groupBy(version).agg(F.count(F.lit(1)).alias("issue_count"))
    return (
        versions.join(rows, version, "left")
        .join(found, version, "left")
        .withColumn("record_count", F.coalesce("record_count", F.lit(0)))
        .withColumn("issue_count", F.coalesce("issue_count", F.lit(0)))
    )


def fold_edits(edits: DataFrame, key: list[str], fields: list[str] | None = None) -> DataFrame:
    """Edits ``(key…, field, value, seq)`` to one row per record: the last value of
    each field, NULL where the field is not edited.  A cell edited over and over
    is reduced on the map side before it is shuffled."""
    last = [
        F.max(F.when(F.col("field") == f, F.struct("seq", F.coalesce("value", F.lit("")).alias("value"))))["value"].alias(
            f"_new_{column_name(f)}"
        )
        for f in (fields or FIELDS)
    ]
    return edits.groupBy(*key).agg(*last, F.count(F.lit(1)).alias("_edits"))


def apply_edits(records: DataFrame, edits: DataFrame, key: list[str], fields: list[str] | None = None) -> DataFrame:
    """Copy-on-write snapshot: every record, with its edited cells replaced and
    ``edited`` telling which rows changed.  Both sides are unique on ``key``."""
    chosen = fields or FIELDS
    joined = records.join(fold_edits(edits, key, chosen), key, "left")
    new = {
        column_name(f): F.coalesce(F.col(f"_new_{column_name(f)}"), F.col(column_name(f)))
        for f in chosen
        if column_name(f) in records.columns
    }
    return joined.withColumns(new).select(*records.columns, F.col("_edits").isNotNull().alias("edited"))


def rejected_edits(records: DataFrame, edits: DataFrame, key: list[str]) -> DataFrame:
    """Edits of records that do not exist."""
    return salted_lookup(edits, records.select(*key), key, ["seq"], how="left_anti")


def rollback(jobs: DataFrame, versions: DataFrame, requests: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Move the current version of jobs to a requested one.

    ``requests(job_id, version_id, seq)``: the last request of a job counts, and
    only if the version belongs to the job.  Returns the new jobs and the audit
    rows, which hold the true previous pointer."""
    last = requests.groupBy("job_id").agg(F.max(F.struct("seq", "version_id"))["version_id"].alias("version_id"))
    valid = last.join(versions.select("job_id", "version_id"), ["job_id", "version_id"], "left_semi")
    moved = jobs.join(valid.withColumnRenamed("version_id", "_target"), "job_id", "left")
    new_jobs = moved.select(
        *[
            F.coalesce("_target", "current_version_id").alias(c)
            if c == "current_version_id"
            else F.when(F.col("_target").isNotNull(), at).otherwise(F.col(c)).alias(c)
            if c == "updated_at"
            else F.col(c)
            for c in jobs.columns
        ]
    )
    state = lambda c: F.to_json(F.struct(F.col(c).alias("current_version_id")))
    audit = moved.where(F.col("_target").isNotNull()).select(
        "job_id",
        F.lit("user").alias("actor"),
        F.lit("rollback").alias("action"),
        state("current_version_id").alias("before_json"),
        state("_target").alias("after_json"),
        at.alias("created_at"),
    )
    return new_jobs, audit


def diff(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Cell changes from one version to another: ``key…, field, old_value,
    new_value, change``.  Rows meet on their key, and only differing cells leave
    the join."""
    a = old.select(*key, F.struct(*columns).alias("_old"))
    b = new.select(*key, F.struct(*columns).alias("_new"))
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("field"),
                F.nullif(F.col(f"_old.{c}").cast("string"), F.lit("")).alias("old_value"),
                F.nullif(F.col(f"_new.{c}").cast("string"), F.lit("")).alias("new_value"),
            )
            for c in columns
        ]
    )
    changed = F.filter(cells, lambda c: ~c["old_value"].eqNullSafe(c["new_value"]))
    out = a.join(b, key, "full").select(*key, F.explode(changed).alias("c")).select(*key, "c.*")
    return out.withColumn(
        "change",
        F.when(F.col("old_value").isNull(), "added").when(F.col("new_value").isNull(), "removed").otherwise("changed"),
    )


def lineage_depth(versions: DataFrame, version: str = "version_id", parent: str = "parent_version_id", rounds: int = 40) -> DataFrame:
    """Number of ancestors of each version and its root.

    Pointers double in length every round, so a chain of a million edits takes
    twenty joins, each cut off by a checkpoint.  Only versions whose root is not
    yet known are joined and written again; finished ones stay in the checkpoint
    of the round that finished them.  Most versions may point to one and the same
    ancestor, whose row is then repeated as often as its share asks for."""
    spark = versions.sparkSession
    ensure_checkpoint_dir(spark)
    moved = versions.select(
        F.col(version),
        F.col(parent).alias("_next"),
        F.coalesce(F.col(parent), F.col(version)).alias("root"),
        F.when(F.col(parent).isNotNull(), 1).otherwise(0).cast("bigint").alias("depth"),
    ).checkpoint()
    finished: list[DataFrame] = []
    for _ in range(rounds):
        finished.append(moved.where("_next IS NULL"))
        open_ends = moved.where("_next IS NOT NULL")
        if open_ends.isEmpty():
            return reduce(DataFrame.unionByName, finished).drop("_next")
        jump = reduce(DataFrame.unionByName, finished, open_ends).select(
            F.col(version).alias("_next"),
            F.col("_next").alias("_after"),
            F.col("root").alias("_root"),
            F.col("depth").alias("_more"),
        )
        moved = salted_lookup(open_ends, jump, ["_next"], [version]).select(
            version,
            F.col("_after").alias("_next"),
            F.coalesce("_root", "root").alias("root"),
            (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"),
        ).checkpoint()
    raise ValueError("version parents form a cycle")


def _hashable(df: DataFrame) -> list[str]:
    """Columns that can spread the rows of one key."""
    return [name for name, kind in df.dtypes if "map<" not in kind]


def expired_jobs(jobs: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Finished jobs last touched over ``days`` ago."""
    idle = F.col("updated_at") < as_of - F.make_dt_interval(F.lit(days))
    return jobs.where(F.col("status").isin("ready", "failed") & idle).select("job_id")


def expire(tables: dict[str, DataFrame], as_of: Column, days: int = 30) -> dict[str, DataFrame]:
    """Every table without the finished jobs last touched over ``days`` ago.

    Issues hang on versions, everything else on the job.  Each table is counted and
    dealt in parts of bounded rows."""
    old = expired_jobs(tables["jobs"], as_of, days)
    kept = {}
    for name, table in tables.items():
        if name == "issues" and "job_id" not in table.columns:
            gone = salted_lookup(
                tables["versions"], old, ["job_id"], ["version_id"], how="left_semi", parts=lookup_parts(tables["versions"])
            ).select("version_id")
            kept[name] = salted_lookup(table, gone, ["version_id"], _hashable(table), how="left_anti", parts=lookup_parts(table))
        else:
            kept[name] = salted_lookup(table, old, ["job_id"], _hashable(table), how="left_anti", parts=lookup_parts(table))
    return kept
