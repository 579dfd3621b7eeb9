"""Streams: mail intake, duplicate suppression, stage metrics, silent jobs.

The transformations take a batch or a streaming frame alike; watermarks only
matter to the latter.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rosterloom.operators.skew import keep_first
from rosterloom.plans.process import RosterStore, run_batch
from rosterloom.sources import mail
from rosterloom.streaming.state import mark_arrivals


def stream_parsed_mail(spark, path: str, files_per_trigger: int = 1_000) -> DataFrame:
    """Parsed mails of a watched folder."""
    files = mail.mail_file_stream(spark, path, files_per_trigger)
    return mail.parse_eml(mail.accepted_files(files))


def drop_repeated_mail(parsed: DataFrame, keep_days: float = 7) -> DataFrame:
    """First mail of each message id.

    Of stored mails that is the earliest one.  A stream gives narrow rows marked
    ``first`` or ``late``, as ``state.mark_arrivals`` does, without the repeats;
    the late ones are for ``state.settle``."""
    if not parsed.isStreaming:
        return keep_first(parsed, ["message_id"], ["received_at", "path"])
    return mark_arrivals(parsed, keep_days).where("arrival <> 'repeat'")


def _marked(events: DataFrame, delay: str) -> DataFrame:
    return events.withWatermark("ts", delay) if events.isStreaming else events


def stage_windows(events: DataFrame, length: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Runs, errors and durations per stage and time window."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    grouped = _marked(events, delay).groupBy(window.alias("w"), "agent").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.avg("duration_s").alias("avg_seconds"),
        F.max("duration_s").alias("max_seconds"),
    )
    return grouped.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "agent", "runs", "errors", "avg_seconds", "max_seconds"
    )


def _activity(events: DataFrame, minutes: int) -> DataFrame:
    """Events of a job within one gap length, as one row each.

    Two events less than the gap apart are always of one session, so they can be
    merged before the sessions are built, on the map side.  A job with most of
    the events then sends one row per gap length."""
    merged = events.groupBy("job_id", F.window("ts", f"{minutes} minutes").alias("_bucket")).agg(
        F.min("ts").alias("ts"), F.max(F.struct("ts", "status")).alias("_last"), F.count(F.lit(1)).alias("_events")
    )
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    seconds = (micros("_last.ts") - micros("ts")) / F.lit(1_000_000) + F.lit(minutes * 60)
    return merged.drop("_bucket").withColumn("_gap", F.make_interval(secs=seconds.cast("decimal(18,6)")))


def silent_jobs(events: DataFrame, minutes: int = 3, delay: str = "10 minutes") -> DataFrame:
    """Jobs that went silent for some minutes without an end state.

    A silence is where a session window of a job closes; the session keeps only
    its last status.  Stored events are merged per gap length first.  On a stream
    set ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition``
    for the same effect within each micro-batch."""
    if events.isStreaming:
        window = F.session_window("ts", f"{minutes} minutes")
        source = _marked(events, delay).withColumns({"_last": F.struct("ts", "status"), "_events": F.lit(1)})
    else:
        source = _activity(events, minutes)
        window = F.session_window("ts", F.col("_gap"))
    sessions = source.groupBy(window.alias("w"), "job_id").agg(
        F.max("_last").alias("_last"), F.sum("_events").alias("events")
    )
    return sessions.where(~F.col("_last.status").isin("success", "error")).select(
        "job_id", F.col("w.start").alias("active_from"), F.col("_last.ts").alias("silent_since"), F.col("_last.status").alias("status"), "events"
    )


def process_arrivals(
    store: RosterStore, source: str, checkpoint: str, as_of: str | None = None, files_per_trigger: int = 1_000, every: str | None = None
) -> StreamingQuery:
    """Run the whole flow for each micro-batch of arriving mails.

    What has arrived is worked off once, or, with ``every`` (such as ``1 minute``),
    again and again until the query is stopped.  Without ``as_of`` each micro-batch
    is validated as of its own day.  A micro-batch that is tried again replaces
    what its first try has written."""
    files = mail.mail_file_stream(store.spark, source, files_per_trigger)

    def handle(batch: DataFrame, number: int) -> None:
        today = datetime.now(timezone.utc).date().isoformat() if as_of is None else as_of
        run_batch(store, f"stream-{number:08d}", batch, today)

    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**trigger).start()
