"""Export, training samples and job rules."""

import pytest
from pyspark.sql import functions as F

from rosterloom.operators import export, jobs, scoring, versions
from rosterloom.schema import FIELDS
from rosterloom.sources.spreadsheets import read_workbook
from rosterloom.sources.training import read_training_json, write_results


def records(spark, count):
    rows = [(1, 5, i, f"0{i}", "Ann <Lee>") for i in range(count)]
    return spark.createDataFrame(rows, "job_id long, version_id long, row_idx long, provider_npi string, provider_name string")


def test_workbooks_keep_every_row_in_order(spark):
    at = F.lit("2025-01-02 03:04:05").cast("timestamp")
    books = export.workbooks(export.export_rows(records(spark, 25)), at, part_rows=10)
    rows, log = [], export.export_log(books, at)
    for book in sorted(books.collect(), key=lambda b: b.part):
        sheets = dict(read_workbook(book.content))
        assert sheets["Roster"][0] == FIELDS
        assert ["Record Count", "25"] in sheets["Provenance"] and ["Export Date", "2025-01-02 03:04:05"] in sheets["Provenance"]
        rows += [(r[FIELDS.index("Provider NPI")], r[FIELDS.index("Provider Name")]) for r in sheets["Roster"][1:]]
    assert rows == [(f"0{i}", "Ann <Lee>") for i in range(25)]
    names = sorted(r.file_uri for r in log.collect())
    assert names[0].startswith("exports/roster_export_job_1_v5_") and len(set(names)) == 3
    assert {len(r.checksum) for r in log.collect()} == {64}


def test_write_rows(spark, tmp_path):
    export.write_rows(export.export_rows(records(spark, 30)), str(tmp_path / "csv"), "csv", part_rows=7)
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == 30 and set(FIELDS) <= set(back.columns)
    assert back.where("`Provider NPI` = '029'").count() == 1


def test_empty_export(spark):
    assert export.export_rows(records(spark, 1).limit(0)).columns[3:] == FIELDS


def test_training_files(spark, tmp_path):
    (tmp_path / "d.json").write_text('[{"email_body": "Subject: a\\nHi", "extracted_fields": {"Provider Name": "Dr. Ann, MD", "TIN": null}}]')
    samples = read_training_json(spark, str(tmp_path / "d.json"))
    row = scoring.chat_samples(samples, "S", "Q {email}", "|").first()
    assert row.answer == '{\n    "Provider Name": "Ann",\n    "TIN": null\n}|' and row.prompt == "S|User: Q Hi|Assistant: "
    write_results(samples.select(F.col("email_body").alias("email"), F.col("extracted_fields").alias("extracted_data")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().email == "Subject: a\nHi"


def test_list_jobs_refuses_unknown_status(spark):
    with pytest.raises(ValueError):
        jobs.list_jobs(spark.range(1), status="lost")


def test_rollback_then_diff_is_empty(spark):
    job = spark.createDataFrame([(1, 12)], "job_id long, current_version_id long").withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    history = spark.createDataFrame([(10, 1), (12, 1), (20, 2)], "version_id long, job_id long")
    wanted = spark.createDataFrame([(1, 10, 1), (1, 20, 0)], "job_id long, version_id long, seq long")
    moved, audit = versions.rollback(job, history, wanted, F.lit("2024-02-01").cast("timestamp"))
    assert moved.first().current_version_id == 10
    entry = audit.first()
    assert entry.before_json == '{"current_version_id":12}' and entry.after_json == '{"current_version_id":10}'
    foreign = spark.createDataFrame([(1, 20, 5)], "job_id long, version_id long, seq long")
    assert versions.rollback(job, history, foreign, F.lit("2024-02-01").cast("timestamp"))[0].first().current_version_id == 12
    rows = spark.createDataFrame([(0, "a"), (1, "b")], "row_idx long, tin string")
    assert versions.diff(rows, rows, ["row_idx"], ["tin"]).isEmpty()
