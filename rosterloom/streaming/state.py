"""Keyed state with event-time timers: silence alarms, first arrivals of mails.

Both run as ``transformWithStateInPandas`` over the RocksDB state store, so state
is bounded by disk and not by memory, and a restart goes on from the checkpoint.
Rows that come too late for the state are not dropped: they leave as rows of kind
``late``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rosterloom.session import ship_package

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ACTIVITY = "job_id bigint, first bigint, last bigint, status string, events bigint"
ALARM = "job_id bigint, kind string, active_from timestamp, silent_since timestamp, status string, events bigint"


ARRIVAL = "path string, message_id string, received_at timestamp, raw_hash string, arrival string"
DAY_MS = 86_400_000


def use_rocksdb(spark: SparkSession) -> None:
    """Streams that are started from now on keep their state in RocksDB, the only
    store with timers and times to live."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def join_spans(spans: list[tuple], gap: int) -> list[tuple]:
    """Merge (first, last, status, events) spans that are at most ``gap`` apart.
    The status is that of the last event; of events at one time, the largest."""
    merged: list[tuple] = []
    for first, last, status, events in sorted(spans, key=lambda s: (s[0], s[1])):
        if merged and first <= merged[-1][1] + gap:
            start, end, known, count = merged[-1]
            newest = max((end, known), (last, status))
            merged[-1] = (start, *newest, count + events)
        else:
            merged.append((first, last, status, events))
    return merged


def _activity(gap: int):
    """Events of a batch to spans, on the side of the reader: a job that owns most
    of the events sends few rows to its state.  The same as ``join_spans`` over the
    events of each job, for all jobs of a batch in one sort."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            job, micros = batch.column("job_id"), batch.column("micros").to_numpy()
            unknown, job = job.is_null().to_numpy(zero_copy_only=False), job.fill_null(0).to_numpy()
            words, status = np.unique(np.array(batch.column("status").to_pylist(), dtype=object), return_inverse=True)
            order = np.lexsort((status, micros, job, unknown))
            unknown, job, micros, status = unknown[order], job[order], micros[order], status[order]
            fresh = (np.diff(micros) > gap) | (np.diff(job) != 0) | (unknown[1:] != unknown[:-1])
            start = np.flatnonzero(np.concatenate([[True], fresh]))
            end = np.append(start[1:], len(order)) - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(job[start], pa.int64(), mask=unknown[start]), pa.array(micros[start], pa.int64()),
                    pa.array(micros[end], pa.int64()), pa.array(words[status[end]], pa.string()), pa.array(end - start + 1, pa.int64()),
                ],
                names=["job_id", "first", "last", "status", "events"],
            )

    return merged


class SilenceAlarm(StatefulProcessor):
    """Keeps the open spans of a job.  A span closes when the watermark passes its
    last event by the gap; it is an alarm if it did not end in an end state.

    A job has one timer, that of the span which closes first: every call of the
    handle is a message to the JVM, and a job may have any number of spans."""

    def __init__(self, gap: int, ended: tuple[str, ...]) -> None:
        self.gap, self.ended = gap, ended

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getListState("spans", "first bigint, last bigint, status string, events bigint")

    def closing(self, last: int) -> int:
        """When a span closes, in milliseconds."""
        return -(-(last + self.gap) // 1000)

    def timer(self, spans: list[tuple]) -> int | None:
        return self.closing(min(span[1] for span in spans)) if spans else None

    def shown(self, key: tuple, kind: str, spans: list[tuple]) -> pd.DataFrame:
        first, last, status, events = zip(*spans)
        time = lambda micros: np.array(micros, dtype="datetime64[us]")
        return pd.DataFrame(
            {
                "job_id": pd.array([key[0]] * len(spans), dtype="Int64"), "kind": kind, "active_from": time(first),
                "silent_since": time(last), "status": list(status), "events": list(events),
            }
        )

    def kept(self) -> list[tuple]:
        return [tuple(row) for row in self.spans.get()]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        before = self.kept()
        new = [tuple(r) for batch in rows for r in batch[["first", "last", "status", "events"]].itertuples(index=False)]
        new = [(int(a), int(b), s, int(n)) for a, b, s, n in new]
        late = [span for span in new if self.closing(span[1]) <= watermark]
        after = join_spans(before + [span for span in new if self.closing(span[1]) > watermark], self.gap)
        old, now = self.timer(before), self.timer(after)
        if old != now:
            if old is not None:
                self.handle.deleteTimer(old)
            if now is not None:
                self.handle.registerTimer(now)
        if after != before:
            self.spans.put(after)
        if late:
            yield self.shown(key, "late", late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All that the watermark has passed, as if each span had a timer of its own.
        at = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        spans = self.kept()
        closed = [span for span in spans if self.closing(span[1]) <= at]
        rest = [span for span in spans if self.closing(span[1]) > at]
        if not rest:
            self.spans.clear()
        elif closed:
            self.spans.put(rest)
            self.handle.registerTimer(self.timer(rest))
        silent = [span for span in closed if span[2] not in self.ended]
        if silent:
            yield self.shown(key, "alarm", silent)

    def close(self) -> None:
        pass


def silence_alarms(
    events: DataFrame, minutes: int = 3, delay: str = "10 minutes", ended: tuple[str, ...] = ("success", "error")
) -> DataFrame:
    """A row of kind ``alarm`` for every silence of a job, once the watermark has
    passed it, and of kind ``late`` for activity that came after its silence was
    closed.  The stream form of ``flows.silent_jobs``, with the same spans.

    ``events`` streams ``ts, job_id, status``; rows without a time or a status are
    left to the caller."""
    ship_package(events.sparkSession)
    use_rocksdb(events.sparkSession)
    gap = minutes * 60_000_000
    timed = events.select("job_id", "status", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    marked = timed.where("ts IS NOT NULL AND status IS NOT NULL").select("job_id", F.unix_micros("ts").alias("micros"), "status")
    spans = marked.mapInArrow(_activity(gap), ACTIVITY)
    return spans.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=SilenceAlarm(gap, ended), outputStructType=ALARM, outputMode="Append", timeMode="EventTime"
    )


class FirstArrival(StatefulProcessor):
    """Remembers the first mail of a message id for some time after it arrived."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "arrived bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mails = pd.concat(list(rows)).sort_values(["received_at", "path"], ignore_index=True)
        mails["arrival"] = "repeat"
        if not self.first.exists():
            received, arrived = mails["received_at"].iloc[0], int(mails["arrived"].iloc[0])
            recent = pd.notna(received) and received >= pd.Timestamp(arrived - self.keep_ms, unit="ms")
            mails.loc[0, "arrival"] = "first" if recent else "late"
            self.first.update((arrived,))
            self.handle.registerTimer(arrived + self.keep_ms)
        yield mails[["path", "message_id", "received_at", "raw_hash", "arrival"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.first.clear()
        yield from ()

    def close(self) -> None:
        pass


def mark_arrivals(parsed: DataFrame, keep_days: float = 7) -> DataFrame:
    """Every mail of a stream as ``first``, ``repeat`` or ``late``, in narrow rows
    that the mails meet on their path.

    State lives ``keep_days`` from the arrival of a message id's first mail, by the
    clock of the stream and not by the mails' own times, so old mails are not
    dropped.  A mail that is itself older than that, and whose id is not known, may
    repeat one whose state has gone: it is ``late``, and ``settle`` decides it."""
    ship_package(parsed.sparkSession)
    use_rocksdb(parsed.sparkSession)
    arrived = parsed.select("path", "message_id", "received_at", "raw_hash", F.current_timestamp().alias("_at"))
    # The watermark is that of the arrivals; it moves the timers and drops nothing.
    timed = arrived.withWatermark("_at", "0 seconds").withColumn("arrived", F.unix_millis("_at")).drop("_at")
    return timed.groupBy("message_id").transformWithStateInPandas(
        statefulProcessor=FirstArrival(int(keep_days * DAY_MS)), outputStructType=ARRIVAL, outputMode="Append", timeMode="EventTime"
    )


def settle(arrivals: DataFrame, stored: DataFrame) -> DataFrame:
    """Marked mails with the late ones decided: ``repeat`` if ``stored`` has their
    message id, ``first`` otherwise."""
    late = arrivals.where("arrival = 'late'").drop("arrival")
    known = stored.select("message_id").distinct().withColumn("_known", F.lit(True))
    decided = late.join(known, "message_id", "left").withColumn("arrival", F.when(F.col("_known"), "repeat").otherwise("first"))
    return arrivals.where("arrival <> 'late'").unionByName(decided.drop("_known"))
