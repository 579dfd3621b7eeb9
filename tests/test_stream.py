"""A stream gives what the batch gives."""

import datetime

from pyspark.sql import functions as F

from rosterloom.plans.process import RosterStore
from rosterloom.sources import mail
from rosterloom.streaming import flows
from tests.test_mail import TABLE, message

START = datetime.datetime(2024, 1, 1)
EVENT_SCHEMA = "ts timestamp, job_id long, agent string, status string, duration_s double"


def events(spark, minutes, job=1, status="started"):
    rows = [(START + datetime.timedelta(minutes=m), job, "extract", status, float(m)) for m in minutes]
    return spark.createDataFrame(rows, EVENT_SCHEMA)


def drain(df, path, checkpoint):
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


def test_windows_equal_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    events(spark, [0, 1, 2, 6, 7, 11]).coalesce(1).write.parquet(source)
    events(spark, [60]).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(EVENT_SCHEMA).parquet(source)
    drain(flows.stage_windows(stream, "5 minutes"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.window_start, r.runs) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.window_start, r.runs) for r in flows.stage_windows(spark.read.parquet(source), "5 minutes").collect()}
    # The last window stays open until the watermark passes it.
    assert got == {w for w in want if w[0] < START + datetime.timedelta(minutes=50)}


def test_late_events_are_dropped(spark, tmp_path):
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    windows = lambda: flows.stage_windows(spark.readStream.schema(EVENT_SCHEMA).parquet(source), "5 minutes")
    events(spark, [0, 60]).coalesce(1).write.parquet(source)
    drain(windows(), out, cp)
    events(spark, [1, 58, 120]).coalesce(1).write.mode("append").parquet(source)
    drain(windows(), out, cp)
    got = {int((r.window_start - START).total_seconds() // 60): r.runs for r in spark.read.parquet(out).collect()}
    assert got == {0: 1, 55: 1, 60: 1}


def test_silent_jobs(spark, tmp_path):
    source = str(tmp_path / "in")
    quiet = events(spark, [0, 1, 2, 30, 31])
    done = events(spark, [0, 1], job=2).union(events(spark, [2], job=2, status="success"))
    quiet.union(done).union(events(spark, [90], job=3)).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(EVENT_SCHEMA).parquet(source)
    drain(flows.silent_jobs(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    minute = lambda t: int((t - START).total_seconds() // 60)
    got = {(r.job_id, minute(r.active_from), minute(r.silent_since)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {(r.job_id, minute(r.active_from), minute(r.silent_since)) for r in flows.silent_jobs(spark.read.parquet(source)).collect()}
    assert got == {(1, 0, 2), (1, 30, 31)} and batch == got | {(3, 90, 90)}


def test_mail_stream(spark, tmp_path):
    source = tmp_path / "mail"
    source.mkdir()
    (source / "1.eml").write_bytes(message("<1@x>", html=TABLE))
    (source / "1_again.eml").write_bytes(message("<1@x>", html=TABLE))
    (source / "2.eml").write_bytes(message("<2@x>"))
    unique = flows.drop_repeated_mail(flows.stream_parsed_mail(spark, str(source)))
    drain(unique.drop("attachments"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.message_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["<1@x>", "<2@x>"]

    store = RosterStore(spark, str(tmp_path / "store"))
    go = lambda: flows.process_arrivals(store, str(source), str(tmp_path / "cp2"), "2025-06-01", files_per_trigger=2).awaitTermination(240)
    go()
    assert store.read("emails").count() == 2
    (source / "3.eml").write_bytes(message("<3@x>", text="Name | NPI\nAnn Lee | 1234567897\n"))
    go()
    ids = {r.job_id for r in store.jobs().collect()}
    assert ids == {r.j for r in spark.createDataFrame([("<1@x>",), ("<2@x>",), ("<3@x>",)], "m string").select(mail.mail_key(F.col("m")).alias("j")).collect()}
