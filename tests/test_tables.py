"""HTML as people write it: omitted end tags, nested tables, entities."""

from html import unescape

from pyspark.sql import functions as F

from rosterloom.operators.narrative import text_rows
from rosterloom.operators.tables import cell_text, html_cells, table_rows

OPEN_TAGS = "<TABLE><thead><tr><th>Provider Name<th>NPI<tbody><tr><td>Ann Lee<td>1234567893<tr><td>Bob<td>2</table>"
NESTED = (
    "<table><tr><td>Provider Name</td><td>NPI</td></tr><tr><td>Ann<table><tr><td>in</td></tr></table> Lee</td>"
    "<td>1</td></tr><tr><td>Bob</td><td>2</td></tr></table><table><tr><td>next"
)


def grids(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    found = {}
    for r in html_cells(df).collect():
        found.setdefault((r.id, r.table_idx), {}).setdefault(r.row_idx, {})[r.col_idx] = r.cell
    return {k: [[row[c] for c in sorted(row)] for _, row in sorted(rows.items())] for k, rows in found.items()}


def test_omitted_end_tags(spark):
    assert grids(spark, OPEN_TAGS)[0, 0] == [["Provider Name", "NPI"], ["Ann Lee", "1234567893"], ["Bob", "2"]]
    df = spark.createDataFrame([(1, OPEN_TAGS)], "id int, html string")
    assert [r.data["Provider Name"] for r in table_rows(df).orderBy("row_idx").collect()] == ["Ann Lee", "Bob"]


def test_nested_tables_are_kept_apart(spark):
    found = grids(spark, NESTED)
    assert found[0, 0] == [["Provider Name", "NPI"], ["Ann Lee", "1"], ["Bob", "2"]]
    assert found[0, 1] == [["in"]] and found[0, 2] == [["next"]]


def test_odd_markup(spark):
    found = grids(
        spark, "</table><td>loose</td>", "<!-- <table><tr><td>x --><table><td>a</td><tr></tr><td>b</table>", None, "", "<table></table>",
        "<tablet><td>no</tablet>",
    )
    assert found == {(1, 0): [["a"], ["b"]]}


def test_entities(value_of):
    texts = ["&eacute;t&eacute;", "&#233;&#xE9;&#X1F600;", "R&D &unknown; &amp;lt; &", "&#150;&#39;&quot;", "&#xD800;&#9999999;", "a&ampb;"]
    assert value_of(cell_text, texts[:5]) == [unescape(t) for t in texts[:5]]
    assert value_of(cell_text, [texts[5], "x&nbsp;y", None]) == ["a&ampb;", "x y", None]


def test_many_tables_and_cells(spark):
    wide = "<table>" + "<tr>" + "<td>1" * 2_000 + "</table>" + "<table><tr><td>x</table>" * 300
    df = spark.createDataFrame([(1, wide)], "id int, html string")
    counts = {r.table_idx: r["count"] for r in html_cells(df).groupBy("table_idx").count().collect()}
    assert counts == {0: 2_000} | {i: 1 for i in range(1, 301)}


def test_text_rows_reads_its_input_once(spark, tmp_path):
    path = str(tmp_path / "texts")
    spark.createDataFrame(
        [(1, "Name | NPI\nAnn | 1\nBob | 2"), (2, "Hello,\nNPI: 1234567893\nbye"), (3, None), (4, "")], "id int, text string"
    ).write.parquet(path)
    out = text_rows(spark.read.parquet(path))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    rows = {(r.id, r.row_idx): (r.data, r.extraction_method) for r in out.collect()}
    assert rows[1, 0] == ({"Name": "Ann", "NPI": "1"}, "plain_text_structured") and rows[1, 1][0]["NPI"] == "2"
    assert rows[2, 0][0]["Provider NPI"] == "1234567893" and len(rows) == 3
