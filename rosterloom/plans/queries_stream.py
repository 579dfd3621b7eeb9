"""Windowed stage metrics and silent jobs on the stored events."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterloom.plans.derive import relation, with_relations
from rosterloom.streaming import flows


def _events(spark, folder):
    return relation(spark, folder, "stage_event")


def _shown(df):
    return df.select(
        F.col("window_start").cast("string").alias("window_start"), "agent", "runs", "errors", F.round("avg_seconds", 9).alias("avg_seconds"), "max_seconds"
    )


def hourly_stages(spark, folder):
    return _shown(flows.stage_windows(_events(spark, folder), "1 hour"))


def sliding_stages(spark, folder):
    return _shown(flows.stage_windows(_events(spark, folder), "2 hours", "30 minutes"))


def silent_jobs(spark, folder):
    out = flows.silent_jobs(_events(spark, folder), 240)
    return out.select("job_id", F.col("active_from").cast("string").alias("active_from"), F.col("silent_since").cast("string").alias("silent_since"), "status", "events")


_FIGURES = "agent, count(*) AS runs, count(*) FILTER (status = 'error') AS errors, round(avg(duration_s), 9) AS avg_seconds, max(duration_s) AS max_seconds"
_MICROS = lambda e: f"strftime({e}, '%Y-%m-%d %H:%M:%S') || CASE WHEN microsecond({e}) % 1000000 = 0 THEN '' ELSE rtrim('.' || lpad(CAST(microsecond({e}) % 1000000 AS VARCHAR), 6, '0'), '0') END"

QUERIES = [
    (
        "hourly_stages",
        hourly_stages,
        with_relations("stage_event") + f"SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS VARCHAR) AS window_start, {_FIGURES} FROM stage_event_t GROUP BY time_bucket(INTERVAL 1 HOUR, ts), agent",
    ),
    (
        "sliding_stages",
        sliding_stages,
        with_relations("stage_event")
        + f", s AS (SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * unnest(range(0, 4)) AS w FROM stage_event_t) SELECT CAST(w AS VARCHAR) AS window_start, {_FIGURES} FROM s GROUP BY w, agent",
    ),
    (
        "silent_jobs",
        silent_jobs,
        with_relations("stage_event")
        + ", g AS (SELECT *, coalesce(ts > lag(ts) OVER (PARTITION BY job_id ORDER BY ts) + INTERVAL 4 HOUR, true) AS fresh FROM stage_event_t)"
        ", n AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY job_id ORDER BY ts) AS s FROM g)"
        ", z AS (SELECT job_id, min(ts) AS a, max(ts) AS b, arg_max(status, (ts, status)) AS status, count(*) AS events FROM n GROUP BY job_id, s)"
        f" SELECT job_id, {_MICROS('a')} AS active_from, {_MICROS('b')} AS silent_since, status, events FROM z WHERE status NOT IN ('success', 'error')",
    ),
]
QUERIES = [(n, f, s.replace(") , ", "), ")) for n, f, s in QUERIES]
