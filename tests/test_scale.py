"""Work per row, per task and per key stays bounded as the tables grow."""

import random
import re
from email import headerregistry

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from rosterloom.operators import export, rules, skew, tables, versions
from rosterloom.operators.narrative import _with_hits, digit_tokens, leading_words, tokens
from rosterloom.operators.skew import dense_index
from rosterloom.plans import derive, queries_extract, queries_flow
from rosterloom.schema import FIELDS
from rosterloom.sources import mail
from rosterloom.sources.spreadsheets import read_workbook
from rosterloom.streaming import state
from tests.test_mail import message


@pytest.fixture
def orders(spark, tmp_path):
    rows = spark.range(1_000).selectExpr(
        "id AS o_orderkey", "id % 7 AS o_custkey", "'O' AS o_orderstatus", "CAST(id AS DOUBLE) AS o_totalprice",
        "timestamp'2024-01-01' AS o_orderdate", "'1-URGENT' AS o_orderpriority",
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(500).selectExpr("id AS c_custkey", "id % 25 AS c_nationkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    return str(tmp_path)


def test_tasks_of_heavy_relations_hold_bounded_rows(spark, orders, monkeypatch):
    monkeypatch.setattr(derive, "TASK_ROWS", 50)
    monkeypatch.setattr(queries_flow, "MAIL_ROWS", 20)
    cores = spark.sparkContext.defaultParallelism
    sizes = lambda df: [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    for name in ("roster", "mail"):
        found = sizes(derive.relation(spark, orders, name).select("html" if name == "mail" else "job_id"))
        assert sum(found) == 1_000 and len(found) >= 20 and len(found) % cores == 0 and max(found) <= 60
    found = sizes(queries_flow.mail_bytes(spark, orders).select("path"))
    assert sum(found) == 500 and max(found) <= 30


def test_queries_ask_for_methods_the_jit_compiles(spark, orders):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    __spark_entry__.queries()["normalized_rows"](spark, orders)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def _spans(events, gap):
    batch = pa.RecordBatch.from_arrays(
        [pa.array([e[0] for e in events], pa.int64()), pa.array([e[1] for e in events], pa.int64()), pa.array([e[2] for e in events])],
        names=["job_id", "micros", "status"],
    )
    return [tuple(r.values()) for b in state._activity(gap)(iter([batch])) for r in b.to_pylist()]


def test_events_become_spans_with_null_and_large_jobs():
    rng = random.Random(3)
    jobs = [None, 0, -5, 2**60 + 1, 2**60 + 2]
    events = [(rng.choice(jobs), rng.randrange(200), rng.choice("abc")) for _ in range(300)]
    wanted = []
    for job in jobs:
        own = [(t, t, s, 1) for j, t, s in events if j == job]
        wanted += [(job, *span) for span in state.join_spans(own, 3)]
    order = lambda rows: sorted(rows, key=repr)
    assert order(_spans(events, 3)) == order(wanted)


class _Handle:
    """Counts the timers of one key."""

    def __init__(self):
        self.timers, self.rows, self.calls = set(), [], 0

    def getListState(self, *_):
        return self

    def get(self):
        return iter(self.rows)

    def exists(self):
        return bool(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class _At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    def getExpiryTimeInMs(self):
        return self.ms


def test_a_job_has_one_timer_whatever_its_spans():
    import pandas as pd

    alarm, handle = state.SilenceAlarm(1_000, ("success",)), _Handle()
    alarm.init(handle)
    micros = np.arange(100) * 10_000
    rows = pd.DataFrame({"first": micros, "last": micros, "status": ["error", "success"] * 50, "events": 1})
    assert list(alarm.handleInputRows((1,), iter([rows]), _At(0))) == []
    assert handle.calls == 1 and len(handle.timers) == 1
    (first,) = alarm.handleExpiredTimer((1,), _At(500), _At(min(handle.timers)))
    assert len(first) == 25 and set(first["status"]) == {"error"} and len(handle.rows) == 50
    (rest,) = alarm.handleExpiredTimer((1,), _At(5_000), _At(max(handle.timers)))
    assert len(rest) == 25 and handle.rows == []


def test_a_header_is_worked_out_once(monkeypatch):
    seen, content = [], message("<once-only@x>")
    plain = headerregistry.HeaderRegistry.__call__
    monkeypatch.setattr(headerregistry.HeaderRegistry, "__call__", lambda s, n, v: (seen.append(n), plain(s, n, v))[1])
    row = mail._parse("/in/a.eml", None, "h", content)
    assert row["message_id"] == "<once-only@x>" and row["parse_error"] is None
    assert "Message-ID" in seen and len(seen) == len(set(seen))


def test_odd_cells_read_as_before(value_of):
    html = (
        "<table><tr><td>plain</td><TD> a  b\n c <td>x<b>y</b>&amp;&nbsp;z</td><th colspan='2'> h </th><td></td>"
        "<td <td>open</td></tr><tr><td>tail"
    )
    grid = lambda v: F.to_json(F.transform(tables.parse_tables(v), lambda t: t["grid"]))
    assert value_of(grid, [html]) == ['[[["plain","a b  c","xy& z","h","","","open"],["tail"]]]']


def test_a_long_cell_is_read_in_one_pass(value_of):
    html = "<table><tr><td>" + "word <i>x</i> " * 20_000 + "</td><td>end</td></tr></table>"
    size = lambda v: F.size(tables.parse_tables(v)[0]["grid"][0])
    assert value_of(size, [html]) == [2]


@pytest.mark.parametrize("first", [1, 3, 1_000])
def test_rules_looked_for_first_change_no_result(spark, first):
    texts = [(i % 90, " ".join(f"w{i * 7 % 11} W{(i * j) % 13}." for j in range(i % 6))) for i in range(120)] + [(None, "w1 w2"), (500, "é w3, w4")]
    table = [(i, f"w{i % 11}, w{i % 13}" if i % 2 else f"W{i % 13}", f"v{i}") for i in range(40)]
    split = lambda t: " ".join(re.findall("[a-z0-9]+", t.lower()))
    wanted = {}
    for i, text in texts:
        for order, term, value in table:
            if f" {split(term)} " in f" {split(text)} ":
                wanted[i] = min(wanted.get(i, (order, value)), (order, value))
    df = spark.createDataFrame(texts, "id int, text string")
    got = rules.match_rules(df, spark.createDataFrame(table, "rule_order int, term string, value string"), "id", "text", first=first)
    assert {r["id"]: (r["rule_order"], r["value"]) for r in got.collect()} == wanted and len(wanted) > 50


def test_small_workbooks_are_read_off_one_stream(spark):
    rows = [(job, 1, i, f"{job}-{i}") for job in [3, 1, None, 2] for i in range(job or 1)]
    df = spark.createDataFrame(rows, "job_id long, version_id long, row_idx long, provider_name string")
    books = export.workbooks(export.export_rows(df), F.lit("2025-01-02 03:04:05").cast("timestamp"), part_rows=2)
    assert "FlatMapGroups" not in books._jdf.queryExecution().executedPlan().toString()
    got = {}
    for b in books.collect():
        sheets = dict(read_workbook(b.content))
        names = [r[FIELDS.index("Provider Name")] for r in sheets["Roster"][1:]]
        got[b.job_id, b.part] = names
        assert b.record_count == len(names) and ["Record Count", b.job_id] in sheets["Provenance"]
    assert got == {("1", 0): ["1-0"], ("2", 0): ["2-0", "2-1"], ("3", 0): ["3-0", "3-1"], ("3", 1): ["3-2"]}


def test_small_groups_are_numbered_without_chunks(spark):
    df = spark.createDataFrame([(k, p) for k in (1, None, 2) for p in (5, 900_000, 70, None)], "k long, p long")
    out = dense_index(df, ["k"], [], "p")
    got = {}
    for r in out.collect():
        got.setdefault(r.k, {})[r.p] = r.row_idx
    assert got == {k: {None: 0, 5: 1, 70: 2, 900_000: 3} for k in (1, None, 2)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Window") == 2


def test_tokens_are_cut_once(spark, orders, value_of):
    texts = ["(1234567890), x9\tP12;  82-1234567\n abc", "", None, "a1 b 2", "x" * 50_000 + " 7"]
    plain = lambda v: F.filter(tokens(v), lambda w: w.rlike("[0-9]"))
    assert value_of(digit_tokens, texts) == value_of(plain, texts)
    spark.range(3).selectExpr("id AS doc_id", "'a 555-123-4567' AS text").write.parquet(f"{orders}/documents.parquet")
    found = queries_extract.token_values(spark, orders)
    union = found._jdf.queryExecution().optimizedPlan().toString()
    assert union.count("regexp_extract_all") <= 2  # once for documents, once for mails
    assert found.where("phone_number = '555-123-4567'").count() >= 3


def test_patterns_are_tried_only_behind_their_words(spark):
    assert leading_words(r"(?:License|Lic\.)[:\s#]*") == ["license", "lic"] and leading_words("([A-Z][a-z]+)") == []
    df = spark.createDataFrame([(0, "none here\nat all"), (1, "LIC. a1\nnpi 1234567890"), (2, "NPI 1234567890")], "id int, text string")
    found = _with_hits(df, "text", "strict", False)
    assert "contains(_lowered" in found._jdf.queryExecution().analyzed().toString().lower()
    hits = {r["id"]: [{e["key"]: e["value"] for e in h} for h in r["_hits"] or []] for r in found.collect()}
    assert hits == {0: [], 1: [{"State License": "a1", "Provider NPI": "1234567890"}], 2: []}


@pytest.mark.parametrize("buckets", [1, 7, 1 << 16])
def test_keys_are_counted_one_by_one_only_in_large_buckets(spark, monkeypatch, buckets):
    monkeypatch.setattr(skew, "HOT_BUCKETS", buckets)
    df = spark.range(1_000).selectExpr("CASE WHEN id < 300 THEN -1 WHEN id < 450 THEN NULL ELSE id END AS key", "id % 2 AS other")
    assert sorted(map(tuple, skew.hot_keys(df, ["key"], 10).collect()), key=str) == [(-1, 3), (None, 2)]
    assert sorted(map(tuple, skew.hot_keys(df, ["key", "other"], 10).collect())) == [(-1, 0, 2), (-1, 1, 2)]


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookups_of_large_tables_are_dealt_in_bounded_parts(spark, monkeypatch, how):
    monkeypatch.setattr(skew, "LOOKUP_ROWS", 50)
    big = spark.range(1_000).selectExpr("CASE WHEN id < 400 THEN -1 WHEN id < 450 THEN NULL ELSE id END AS key", "id").cache()
    small = spark.range(-1, 700).selectExpr("id AS key", "id * 2 AS v")
    assert skew.lookup_parts(big) == 20
    # Only without a broadcast is it seen how the rows are dealt.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = skew.salted_lookup(big, small, ["key"], ["id"], how=how, parts=skew.lookup_parts(big))
        got = sorted(r["id"] for r in met.collect())
        sizes = [r["n"] for r in met.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    hits = [i for i in range(1_000) if i < 400 or 450 <= i < 700]
    assert got == {"left": list(range(1_000)), "left_anti": sorted(set(range(1_000)) - set(hits))}.get(how, hits)
    assert len(sizes) > 10 and max(sizes) < 200


def test_retention_deals_tables_by_their_size(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(skew, "LOOKUP_ROWS", 10)
    plain = versions.salted_lookup
    monkeypatch.setattr(versions, "salted_lookup", lambda *a, **k: (asked.append(k.get("parts")), plain(*a, **k))[1])
    jobs = spark.range(100).selectExpr("id AS job_id", "'failed' AS status", "timestamp'2024-01-01' AS updated_at")
    records = spark.range(300).selectExpr("id % 200 AS job_id", "id AS row_idx")
    kept = versions.expire({"jobs": jobs, "records": records}, F.lit("2025-01-01").cast("timestamp"))
    assert asked == [10, 30] and kept["jobs"].count() == 0 and kept["records"].count() == 100
