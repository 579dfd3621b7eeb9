"""Timers, first arrivals and the commit log: nothing is lost, doubled or seen early."""

import datetime
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rosterloom.plans.derive import relation
from rosterloom.plans.process import RosterStore, run_batch
from rosterloom.sources import mail
from rosterloom.streaming import flows, state
from tests.conftest import SF_DIR
from tests.test_mail import TABLE, message
from tests.test_stream import EVENT_SCHEMA, START, drain, events

FIELDS = ["job_id", "active_from", "silent_since", "status", "events"]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_alarms_equal_the_batch_over_all_events_across_restarts(spark, tmp_path):
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    all_events = relation(spark, SF_DIR, "stage_event").select("ts", "job_id", "status").orderBy("ts")
    schema = all_events.schema
    third = all_events.count() // 3
    numbered = all_events.withColumn("_n", F.row_number().over(Window.orderBy("ts")))
    alarms = lambda: state.silence_alarms(spark.readStream.schema(schema).parquet(source), 240)
    for part in range(3):  # a query of its own for each part, from the same checkpoint
        piece = numbered.where((F.col("_n") > part * third) & ((F.col("_n") <= (part + 1) * third) | F.lit(part == 2))).drop("_n")
        piece.coalesce(1).write.mode("append").parquet(source)
        drain(alarms(), out, cp)
    far = datetime.datetime(2030, 1, 1)
    spark.createDataFrame([(far, -1, "success")], schema).coalesce(1).write.mode("append").parquet(source)
    drain(alarms(), out, cp)
    found = spark.read.parquet(out)
    wanted = flows.silent_jobs(relation(spark, SF_DIR, "stage_event"), 240)
    assert rows(found.where("kind = 'alarm'"), *FIELDS) == rows(wanted, *FIELDS)
    assert found.where("kind = 'late'").count() == 0


def test_late_activity_leaves_as_late(spark, tmp_path):
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    alarms = lambda: state.silence_alarms(spark.readStream.schema(EVENT_SCHEMA).parquet(source), 3)
    events(spark, [0, 60]).coalesce(1).write.parquet(source)
    drain(alarms(), out, cp)
    # Minute 2 belongs to a closed silence, minute 58 is old but still opens a span.
    events(spark, [2, 58, 120]).coalesce(1).write.mode("append").parquet(source)
    drain(alarms(), out, cp)
    minute = lambda t: int((t - START).total_seconds() // 60)
    got = sorted((r.kind, minute(r.active_from), minute(r.silent_since), r.events) for r in spark.read.parquet(out).collect())
    assert got == [("alarm", 0, 0, 1), ("alarm", 58, 60, 2), ("late", 2, 2, 1)]


def test_spans_merge_at_the_gap():
    spans = [(10, 10, "b", 1), (0, 0, "x", 1), (5, 5, "a", 2), (16, 16, "c", 1), (10, 10, "c", 1)]
    assert state.join_spans(spans, 5) == [(0, 10, "c", 5), (16, 16, "c", 1)]


def test_old_mails_are_first_repeat_or_late(spark, tmp_path):
    """Mails in = first + repeats + late, with mails far older than the state lives."""
    source, out, cp = tmp_path / "mail", str(tmp_path / "out"), str(tmp_path / "cp")
    source.mkdir()

    def put(name, message_id, days):
        path = source / f"{name}.eml"
        path.write_bytes(message(message_id))
        old = datetime.datetime.now().timestamp() - days * 86_400
        os.utime(path, (old, old))

    marks = lambda: state.mark_arrivals(flows.stream_parsed_mail(spark, str(source)), keep_days=7)
    put("new", "<n@x>", 0), put("new_again", "<n@x>", 0.01), put("old", "<o@x>", 30), put("old_again", "<o@x>", 31), put("known", "<k@x>", 40)
    drain(marks(), out, cp)
    put("n3", "<n@x>", 30), put("o3", "<o@x>", 0), put("fresh", "<f@x>", 2)
    drain(marks(), out, cp)
    arrivals = spark.read.parquet(out)
    got = {r.path.rsplit("/", 1)[1]: r.arrival for r in arrivals.collect()}
    assert got == {
        "new.eml": "repeat", "new_again.eml": "first", "old.eml": "repeat", "old_again.eml": "late", "known.eml": "late",
        "n3.eml": "repeat", "o3.eml": "repeat", "fresh.eml": "first",
    }
    stored = spark.createDataFrame([("<k@x>",)], "message_id string")
    settled = {r.path.rsplit("/", 1)[1]: r.arrival for r in state.settle(arrivals, stored).collect()}
    assert len(settled) == len(got) and settled["old_again.eml"] == "first" and settled["known.eml"] == "repeat"
    assert sorted(settled.values()) == ["first"] * 3 + ["repeat"] * 5


def test_batch_form_keeps_the_first(spark):
    mails = spark.createDataFrame([("a", "m", 2), ("b", "m", 1), ("c", "n", 5)], "path string, message_id string, received_at long")
    assert sorted(r.path for r in flows.drop_repeated_mail(mails).collect()) == ["b", "c"]


class Broken(Exception):
    pass


@pytest.fixture(scope="module")
def inbox(tmp_path_factory):
    root = tmp_path_factory.mktemp("inbox")
    (root / "a.eml").write_bytes(message("<a@x>", html=TABLE))
    (root / "b.eml").write_bytes(message("<b@x>", text="Name | NPI\nAnn Lee | 1234567897\n"))
    return str(root)


def all_contents(store):
    return {t: sorted(map(repr, store.read(t).drop("batch").collect())) for t in store.tables()}


def test_a_broken_batch_is_invisible_and_its_retry_whole(spark, inbox, tmp_path, monkeypatch):
    files = mail.mail_files(spark, inbox)
    whole = RosterStore(spark, str(tmp_path / "whole"))
    run_batch(whole, "b1", files, "2025-06-01")
    wanted = all_contents(whole)
    assert {"emails", "versions", "records", "issues", "deltas", "jobs", "audit_logs"} <= wanted.keys()

    store = RosterStore(spark, str(tmp_path / "broken"))
    write, commit = RosterStore.write, RosterStore._commit
    for stop in (5, len(wanted)):
        done = []

        def failing(self, table, batch, df, **options):
            write(self, table, batch, df, **options)
            done.append(table)
            if len(done) == stop:
                raise Broken

        monkeypatch.setattr(RosterStore, "write", failing)
        with pytest.raises(Broken):
            run_batch(store, "b1", files, "2025-06-01")
        monkeypatch.setattr(RosterStore, "write", write)
        assert len(done) == stop and store.tables() == [] and store.commits() == []
    run_batch(store, "b1", files, "2025-06-01")
    assert all_contents(store) == wanted

    # A second batch that breaks at its commit leaves the store as it was.
    def no_commit(*_, **__):
        raise Broken

    monkeypatch.setattr(RosterStore, "_commit", no_commit)
    with pytest.raises(Broken):
        run_batch(store, "b1", files.where("path LIKE '%a.eml'"), "2025-06-01")
    monkeypatch.setattr(RosterStore, "_commit", commit)
    assert all_contents(store) == wanted


def test_snapshots_by_commit_number(spark, tmp_path):
    store = RosterStore(spark, str(tmp_path / "s"))
    numbers = lambda *n: spark.createDataFrame([(i,) for i in n], "n int")
    with store.attempt("b1"):
        store.write("t", "b1", numbers(1))
        store.write("u", "b1", numbers(7))
        assert store.tables() == [] and store.batch("t", "b1").count() == 1
    store.write("t", "b2", numbers(2, 3))
    with store.attempt("b1"):  # again, and without u
        store.write("t", "b1", numbers(4))
    seen = lambda s: sorted(r.n for r in s.read("t").collect())
    past = lambda n: RosterStore(spark, store.path, upto=n)
    assert [seen(past(1)), seen(past(2)), seen(store)] == [[1], [1, 2, 3], [2, 3, 4]]
    assert past(2).tables() == ["t", "u"] and store.tables() == ["t"]
    with pytest.raises(LookupError):
        store.read("u")


def test_reports_follow_every_batch(spark, inbox, tmp_path):
    """Roll-ups after edits, rollbacks, failures and a copy equal a recount."""
    from rosterloom.plans import process

    store = RosterStore(spark, str(tmp_path / "s"))
    at = lambda day: F.lit(f"2025-06-{day:02d}").cast("timestamp")
    files = mail.mail_files(spark, inbox)
    run_batch(store, "b1", files.where("path LIKE '%a.eml'"), "2025-06-01")
    run_batch(store, "b2", files, "2025-06-02")
    job = store.read("emails").where("message_id = '<a@x>'").first().job_id
    edits = spark.createDataFrame([(job, 0, "Term Reason", "Gone", 1)], "job_id string, row_idx long, field string, value string, seq long")
    process.edit_cells(store, "e1", edits, "2025-06-03", at(3))
    back = spark.createDataFrame([(job, f"{job}.1", 1)], "job_id string, version_id string, seq long")
    process.roll_back(store, "r1", back, at(4))
    process.export_jobs(store, "x1", at(5))
    process.export_jobs(store, "x1", at(5))  # the same batch again

    def check(s):
        for measure, slot in (("status", F.col("status")), ("created_day", F.to_date("created_at").cast("string"))):
            counted = {(r.s, r["count"]) for r in s.jobs().groupBy(slot.alias("s")).count().collect()}
            assert {(r.slot, r.n) for r in s.report(measure).collect()} == counted

    check(store)
    copy = RosterStore(spark, str(tmp_path / "c"))
    process.copy_live(store, copy, "c1")
    check(copy)
    assert set(store.tables()) == set(copy.tables())
    # The copy knows its mails, too.
    run_batch(copy, "b3", files, "2025-06-06")
    assert copy.batch("emails", "b3").count() == 0 and copy.jobs().count() == 2


def test_model_rows_come_first_and_failures_are_told(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    for name, text in (("good", "Please see the file."), ("bad", "refuse this one"), ("rules", "Name | NPI\nAnn Lee | 1234567897\n")):
        (root / f"{name}.eml").write_bytes(message(f"<{name}@x>", text=text))
    calls = []

    def model(prompts):
        if any("refuse" in p for p in prompts):
            raise RuntimeError("no")
        return ['[{"Provider Name": "Zoe Ray", "Provider NPI": "9876543217"}, {"TIN": "none"}]' for _ in prompts]

    store = RosterStore(spark, str(tmp_path / "s"))
    run_batch(store, "b1", mail.mail_files(spark, str(root)), "2025-06-01", model=model)
    names = {r.job_id: r.message_id for r in store.read("emails").collect()}
    rows = {names[r.job_id]: r.provider_name for r in store.read("records").collect()}
    assert rows.get("<good@x>") == "Zoe Ray" and rows["<rules@x>"] == "Ann Lee"
    told = store.read("model_rejections").collect()
    assert [(names[r.job_id], r.error) for r in told] == [("<bad@x>", "RuntimeError: no")] and told[0].attempts == 3


def test_inference_keeps_rows_apart(spark):
    from rosterloom.operators import inference

    rows = spark.createDataFrame([(i, None if i == 3 else f"p{i}") for i in range(50)], "i int, prompt string").coalesce(1)

    def model(prompts):
        if any(int(p[1:]) % 7 == 0 for p in prompts):
            raise ValueError("seventh")
        return [p.upper() for p in prompts]

    found = {r.i: r for r in inference.infer(rows, model, batch_rows=10).collect()}
    assert len(found) == 50
    for i, r in found.items():
        if i == 3:
            assert (r.response, r.attempts, r.error) == (None, 0, "no prompt")
        elif i % 7 == 0:
            assert (r.response, r.attempts, r.error) == (None, 3, "ValueError: seventh")
        else:
            assert r.response == f"P{i}" and r.error is None
    short = inference.infer(rows.limit(2), lambda prompts: [])
    assert {r.error for r in short.collect()} == {"ValueError: 0 answers to 1 prompts"}


def test_index_never_misses_a_known_key(spark):
    from rosterloom.operators import known

    old = spark.range(400).selectExpr("id", "concat('m', id) AS a", "IF(id % 3 = 0, NULL, concat('h', id % 50)) AS b")
    keys = known.key_rows(old, ["a", "b"], "id")
    halves = known.key_index(keys.where("part < 128")).unionAll(known.key_index(keys.where("part >= 128")))
    new = spark.range(1000).selectExpr("id", "concat('m', id * 2) AS a", "concat('h', id % 100) AS b")
    found = {r.id: r.existing_id for r in known.find_known(new, "id", ["a", "b"], keys, known.merged_index(halves)).collect()}
    by_a, by_b = {f"m{i}": i for i in range(400)}, {}
    for i in range(399, -1, -1):
        if i % 3:
            by_b[f"h{i % 50}"] = i
    wanted = {i: min(x for x in (by_a.get(f"m{i * 2}"), by_b.get(f"h{i % 100}")) if x is not None)
              for i in range(1000) if f"m{i * 2}" in by_a or f"h{i % 100}" in by_b}
    assert found == wanted
    none = known.possible(new, ["a"], known.key_index(keys.where("false"))).where("_possible").count()
    assert none == 0


def test_compaction_rewrites_touched_buckets_only(spark, inbox, tmp_path, monkeypatch):
    from rosterloom.plans import process

    store = RosterStore(spark, str(tmp_path / "s"), buckets=4)
    files = mail.mail_files(spark, inbox)
    run_batch(store, "b1", files, "2025-06-01")
    run_batch(store, "b2", files, "2025-06-02")  # nothing new: tables without rows
    assert process.compact.__doc__ and store.batch("records", "b2").count() == 0
    job = store.read("emails").where("message_id = '<a@x>'").first().job_id
    other = store.read("emails").where("message_id = '<b@x>'").first().job_id
    store.log_jobs("z1", store.jobs().where(F.col("job_id") == job).withColumn("status", F.lit("ready")))
    process.expire(store, "d1", F.lit("2025-09-01").cast("timestamp"))
    assert [r.job_id for r in store.read("expired").collect()] in ([job], [job, other], [other, job])
    gone = {r.job_id for r in store.read("expired").collect()}
    shown = lambda df: sorted(map(repr, df.select(*sorted(c for c in df.columns if c != "batch")).collect()))
    tables = [t for t in store.tables() if t not in ("expired", "rollups")]
    wanted = {t: shown(store.live(t)) for t in tables if "job_id" in store.read(t).columns}
    old = RosterStore(spark, store.path, upto=max(c.number for c in store.commits()), buckets=4)
    before = shown(old.read("records"))

    read, opened = RosterStore.bucket_rows, []

    def watched(self, table, batch, own, buckets):
        rows = read(self, table, batch, own, buckets)
        opened.extend(rows.inputFiles() if rows is not None else [])
        return rows

    monkeypatch.setattr(RosterStore, "bucket_rows", watched)
    touched = process.compact(store, "c1")
    assert 1 <= len(touched) <= len(gone)
    assert opened and all(any(f"job_bucket={b}/" in path for b in touched) for path in opened)
    for table, rows in wanted.items():
        if table != "jobs":
            assert shown(store.read(table)) == rows, table
    assert not gone & {r.job_id for r in store.jobs().collect()}
    counted = {(r.status, r["count"]) for r in store.jobs().groupBy("status").count().collect()}
    assert {(r.slot, r.n) for r in store.report("status").collect()} == counted
    assert shown(old.read("records")) == before  # a snapshot of the past still has them
    assert process.compact(store, "c2") == touched and shown(store.read("records")) == wanted["records"]
