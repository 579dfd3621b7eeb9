"""Roster export: rows in the target column order, provenance and the export log."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rosterloom.schema import FIELDS, column_name
from rosterloom.sources.spreadsheets import write_workbook

# Rows of one workbook part.  A sheet cannot hold more than 1,048,576 rows, and a
# task builds a part in memory.
PART_ROWS = 1_048_575  # rows of a sheet in this format, less the header


def export_rows(records: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The 17 fields under their own names, missing ones empty; all text."""
    key = key or ["job_id", "version_id", "row_idx"]
    have = set(records.columns)
    cells = [
        (F.coalesce(F.col(column_name(f)).cast("string"), F.lit("")) if column_name(f) in have else F.lit("")).alias(f)
        for f in FIELDS
    ]
    return records.select(*key, *cells)


def write_rows(rows: DataFrame, path: str, fmt: str = "parquet", part_rows: int = PART_ROWS) -> None:
    """Sorted files per job.  A job larger than a part is spread over several
    tasks by its row number, so no job is written by one task alone."""
    part = F.floor(F.col("row_idx") / F.lit(part_rows)).alias("part")
    spread = rows.withColumn("part", part).repartition("job_id", "part").sortWithinPartitions("job_id", "row_idx")
    writer = spread.drop("part").write.mode("errorifexists").partitionBy("job_id")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def provenance(rows: DataFrame, as_of: Column) -> DataFrame:
    """Job, version, export date and record count."""
    counted = rows.groupBy("job_id", "version_id").agg(F.count(F.lit(1)).alias("record_count"))
    return counted.select("job_id", "version_id", F.date_format(as_of, "yyyy-MM-dd HH:mm:ss").alias("export_date"), "record_count")


def provenance_sheet(counts: DataFrame) -> DataFrame:
    """The wider form, one line per entry and job."""
    text = lambda c: F.col(c).cast("string")
    hash_text = F.substring(F.sha2(F.concat_ws(":", "job_id", "version_id", "record_count", "export_date"), 256), 1, 16)
    lines = [
        ("Job ID", text("job_id")),
        ("Version ID", text("version_id")),
        ("Record Count", text("record_count")),
        ("Export Date", F.concat(F.col("export_date"), F.lit(" UTC"))),
        ("Export Format", F.lit("Excel (.xlsx)")),
        ("Schema Version", F.lit("1.0")),
        ("Schema Fields", F.lit(str(len(FIELDS)))),
        ("Content Hash", hash_text),
    ]
    sheet = F.array(*[F.struct(F.lit(name).alias("entry"), value.alias("value")) for name, value in lines])
    return counts.select("job_id", "version_id", F.posexplode(sheet).alias("line", "l")).select(
        "job_id", "version_id", "line", "l.entry", "l.value"
    )


WORKBOOK_SCHEMA = "job_id string, version_id string, part long, content binary, record_count long"
_PART = ["job_id", "version_id", "part"]
_FACTS = ["record_count", "export_date"]
#: Finished workbooks that a task hands over at once, by number and bytes.
BATCH_BOOKS, BATCH_BYTES = 500, 1 << 24


def _build_part(job: str, version: str, count: int, export_date: str | None, cells: list[tuple]) -> bytes:
    return write_workbook(
        {
            "Roster": [FIELDS, *cells],
            "Provenance": [
                ["Field", "Value"],
                ["Job ID", job],
                ["Version ID", version],
                ["Export Date", export_date],
                ["Record Count", str(count)],
            ],
        }
    )


def _build_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Workbooks off a sorted stream of parts, each led by its row of facts."""
    columns = [*_PART, *_FACTS, *FIELDS]
    lists = ([batch.column(c).to_pylist() for c in columns] for batch in batches)
    stream = itertools.chain.from_iterable(zip(*values) for values in lists)
    width, books, held = len(_PART), [], 0
    for (job, version, part), members in itertools.groupby(stream, key=lambda row: row[:width]):
        count, export_date = next(members)[width : width + 2]
        cells = [row[width + 2 :] for row in members]
        content = _build_part(str(job), str(version), count, export_date, cells)
        books.append((str(job), str(version), part, content, len(cells)))
        held += len(content)
        if len(books) >= BATCH_BOOKS or held >= BATCH_BYTES:
            yield _book_batch(books)
            books, held = [], 0
    if books:
        yield _book_batch(books)


def _book_batch(books: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64()]
    names = ["job_id", "version_id", "part", "content", "record_count"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*books), kinds)], names=names)


def workbooks(rows: DataFrame, as_of: Column, part_rows: int = PART_ROWS) -> DataFrame:
    """One workbook per job and part.  ``row_idx`` must be gap-free within a job,
    which bounds every part by ``part_rows``.

    Rows are dealt by part, so that a job with most rows is spread, and sorted;
    the facts of a version go with them as the first row of each of its parts, in
    place of a look-up."""
    keyed = rows.where("job_id IS NOT NULL AND version_id IS NOT NULL")
    parted = keyed.select(
        "job_id", "version_id", F.floor(F.col("row_idx") / F.lit(part_rows)).cast("bigint").alias("part"),
        F.lit(None).cast("bigint").alias("record_count"), F.lit(None).cast("string").alias("export_date"), "row_idx",
        *[F.col(f"`{f}`").cast("string").alias(f) for f in FIELDS],
    )
    sizes = parted.groupBy(*_PART).agg(F.count(F.lit(1)).alias("_rows"))
    total = F.sum("_rows").over(Window.partitionBy("job_id", "version_id"))
    facts = sizes.select(
        *_PART, total.alias("record_count"), F.date_format(as_of, "yyyy-MM-dd HH:mm:ss").alias("export_date"),
        F.lit(None).cast(dict(rows.dtypes)["row_idx"]).alias("row_idx"), *[F.lit(None).cast("string").alias(f) for f in FIELDS],
    )
    dealt = facts.unionByName(parted).repartition(*_PART)
    ordered = dealt.sortWithinPartitions(*_PART, F.col("record_count").desc_nulls_last(), F.col("row_idx").asc_nulls_last())
    return ordered.drop("row_idx").mapInArrow(_build_parts, WORKBOOK_SCHEMA)


def export_log(books: DataFrame, at: Column) -> DataFrame:
    """Log row of each workbook: name, checksum and size."""
    name = F.concat(
        F.lit("roster_export_job_"), F.col("job_id").cast("string"), F.lit("_v"), F.col("version_id").cast("string"), F.lit("_"),
        F.unix_seconds(at).cast("string"),
        F.when(F.col("part") > 0, F.concat(F.lit("_p"), F.col("part").cast("string"))).otherwise(""),
        F.lit(".xlsx"),
    )
    return books.select(
        "job_id",
        "version_id",
        F.concat(F.lit("exports/"), name).alias("file_uri"),
        F.sha2("content", 256).alias("checksum"),
        F.length("content").alias("file_size"),
        at.alias("created_at"),
    )
