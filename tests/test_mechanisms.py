"""CSV lines, free dates, rule tables, roll-ups, sketches, places and attributes."""

import csv
import hashlib
import io
import random
import re

from pyspark.sql import functions as F

from rosterloom.functions import dates
from rosterloom.operators import mapping, rollups, rules, scoring, tables
from rosterloom.sources import delimited


def test_lines_and_cells_equal_a_csv_reader(spark):
    r = random.Random(1)
    texts = ["a,b\n1,2\n", 'a,b\r\n"x,1","y\nz"\r\n3', "", "\n\na\n1", '"open,b\n1,2', 'a\n"""x"""\n', "a,b\n" + '1,"2"\n' * 5000]
    for _ in range(200):
        rows = [["".join(r.choice('ab,"\n \r\x00') for _ in range(r.randint(0, 5))) for _ in range(r.randint(1, 4))] for _ in range(r.randint(1, 5))]
        out = io.StringIO()
        csv.writer(out, lineterminator=r.choice(["\n", "\r\n"])).writerows(rows)
        texts.append(out.getvalue())
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    lines = F.filter(delimited.records(F.col("t")), lambda line: line != "")
    got = df.select("i", lines.alias("l")).select("i", F.transform("l", delimited.cells).alias("c")).orderBy("i").collect()
    for found, text in zip(got, texts):
        assert [list(c) for c in found.c] == [x for x in csv.reader(io.StringIO(text, newline="")) if x]


def test_refused_lines_are_whole_and_numbered(spark):
    long = "x" * 5000
    content = f"A,A,\n1,2,3\n\n{long},b,c,d\nNA,,9\n,,\n".encode()
    rows = delimited.read_csv_attachments(spark.createDataFrame([(7, bytearray(content))], "id int, content binary")).orderBy("line_no").collect()
    assert [(r.line_no, r.row_idx, r.data) for r in rows if r.data is not None] == [
        (2, 0, {"A": "1", "A.1": "2", "Unnamed: 2": "3"}), (5, 3, {"Unnamed: 2": "9"}),
    ]
    assert [(r.line_no, r.read_error) for r in rows if r.read_error] == [(4, f"Line with 4 cells: {long},b,c,d")]


def test_free_dates(value_of):
    cases = {
        "the 3rd of March 2025": "03/03/2025", "Mon, 3 Mar 25": "03/03/2025", "March 3rd, 2025": "03/03/2025", "3-Mar-2025": "03/03/2025",
        "2025 March 3": "03/03/2025", "2025 3 March": "03/03/2025", "3/4/69": "03/04/1969", "3/4/68": "03/04/2068", "13/4/2024": "13/4/2024",
        "02/30/2024": "02/30/2024", "soon": "soon", "May 1": "May 1", "1 2 3 4": "1 2 3 4", "Sept. 5, 2024": "09/05/2024",
        "tuesday 1st of june 2021": "06/01/2021", " 1 / 2 / 2024 ": "01/02/2024", "": "", None: None, "99999999999 1 2024": "99999999999 1 2024",
        "1" * 5000: "1" * 5000, "29 Feb 2024": "02/29/2024", "29 Feb 2023": "29 Feb 2023",
    }
    assert value_of(dates.normalize_free_date, list(cases)) == list(cases.values())


def test_rule_tables_equal_a_search(spark):
    r = random.Random(3)
    word = lambda: r.choice(["ann", "bob", "of", "the", "npi", "x1", "tax", "id"])
    texts = [(i, " ".join(word() + r.choice(["", ",", "."]) for _ in range(r.choice([0, 1, 5, 30])))) for i in range(120)] + [(500, None)]
    table = [(i % 40, " ".join(word() for _ in range(r.randint(0, 4))).title(), f"v{i}") for i in range(60)]
    got = rules.match_rules(
        spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(table, "rule_order int, term string, value string"), "id", "text"
    )
    split = lambda t: " ".join(re.findall("[a-z0-9]+", (t or "").lower()))
    wanted = []
    for i, text in texts:
        hits = [(o, v) for o, term, v in table if split(term) and f" {split(term)} " in f" {split(text)} "]
        wanted += [(i, *min(hits))] if hits else []
    assert sorted(tuple(x) for x in got.collect()) == sorted(wanted) and len(wanted) > 50
    empty = spark.createDataFrame([], "rule_order int, term string, value string")
    assert rules.match_rules(spark.createDataFrame(texts, "id int, text string"), empty, "id", "text").count() == 0


def test_signed_rows_add_up_to_the_last_state(spark):
    r = random.Random(5)
    log = [(job, seq, seq // 2, r.choice("abc") if r.random() < 0.9 else None) for job in range(30) for seq in range(r.randint(1, 10))]
    df = spark.createDataFrame(log, "job int, seq int, batch int, status string")
    changes = rollups.log_changes(df, "job", ["seq"], "batch", {"status": F.col("status")})
    for upto in range(5):
        state = {job: status for job, seq, batch, status in sorted(log) if batch <= upto}
        counted = {}
        for status in state.values():
            if status:
                counted[status] = counted.get(status, 0) + 1
        got = {x.slot: x.n for x in rollups.rolled_up(changes.where(F.col("batch") <= upto), "status").collect()}
        assert got == counted


def test_merged_sketches_stay_within_their_bound(spark):
    rows = spark.range(60_000).selectExpr("concat('s', id % 3) AS agent", "timestamp_seconds(id * 7) AS ts", "pow(id % 9973, 1.5) AS duration_s")
    found = rollups.latency_percentiles(rollups.latency_sketches(rows))
    assert {r.runs for r in found.collect()} == {20_000}
    assert all(r.within_bound for r in rollups.within(rollups.rank_errors(rows, found)).collect())
    wrong = found.withColumn("p50", F.col("p95"))
    assert not any(r.within_bound for r in rollups.within(rollups.rank_errors(rows, wrong)).collect())


def test_places_are_a_keyed_permutation(spark):
    df = spark.range(5000).coalesce(3)
    places = {r.id: r.place for r in scoring.shuffle_places(df, ["id"], seed=3, digits=2).collect()}
    order = sorted(range(5000), key=lambda i: hashlib.sha256(f"3|{i}".encode()).hexdigest())
    assert [places[i] for i in order] == list(range(5000)) and order != sorted(order)


def test_attributes_may_hold_brackets(spark):
    html = """<table class="a>b"><tr data-x='</td>'><td title='a>b'>x</td><td title="1 > 0" >y</td></tr>
    <tr><td title="open>p</td><td>q</td></tr><tr><td>r<td alt="s>t">u</table>"""
    rows = tables.html_cells(spark.createDataFrame([(1, html)], "id int, html string")).orderBy("table_idx", "row_idx", "col_idx").collect()
    cells = [r.cell for r in rows]
    assert cells[:2] == ["x", "y"] and cells[-2:] == ["r", "u"] and "q" in cells and {r.row_idx for r in rows} == {0, 1, 2}


def test_mapping_answers_and_origins(spark):
    df = spark.createDataFrame(
        [(1, 'ok {"mappings": [{"source": "N", "target": "TIN", "confidence": 0.4}]} end'), (2, "none"), (3, "{broken}"), (4, None)], "id int, a string"
    )
    got = {r.id: [(m.source, m.target, m.confidence) for m in r.m] for r in df.select("id", mapping.answered_mapping(F.col("a"), F.array(F.lit("tin"))).alias("m")).collect()}
    assert got == {1: [("N", "TIN", 0.4)], 2: [("tin", "TIN", 0.8)], 3: [], 4: [("tin", "TIN", 0.8)]}
    rows = spark.createDataFrame([(1, {"N": "5", "M": "6", "Reason": "x"})], "id int, data map<string,string>")
    entries = F.array(*[F.struct(F.lit(s).alias("source"), F.lit("TIN").alias("target"), F.lit(c).alias("confidence")) for s, c in (("N", 0.4), ("M", 0.9), ("Z", 1.0))])
    typed = mapping.apply_mapping(rows, rows.select("id", entries.alias("mappings")), ["id"], ["id"]).first()
    assert typed.tin == "6" and [(o.field, o.source, o.confidence) for o in typed.origins] == [("TIN", "M", 0.9)]

