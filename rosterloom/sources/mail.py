"""Mail files: intake checks, parsing, attachments.

Only the MIME decoding is Python, in one pass over each file.  Checks on names
and sizes are column expressions; the size limit reaches the file source, so an
oversized file is never read.
"""

from __future__ import annotations

import email
import email.policy
import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_MEGABYTES = 50

ATTACHMENT_TYPE = "array<struct<filename: string, content_type: string, size: long, checksum: string, content: binary>>"
PARSED_SCHEMA = (
    "path string, received_at timestamp, raw_hash string, message_id string, from_addr string, to_addr string,"
    f" subject string, text string, html string, attachments {ATTACHMENT_TYPE}, parse_error string"
)
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def mail_files(spark: SparkSession, path: str) -> DataFrame:
    """Every file below a folder, with its bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def mail_file_stream(spark: SparkSession, path: str, files_per_trigger: int = 1_000) -> DataFrame:
    """The same as a stream of arriving files.  Files of any age are taken: by
    default the source passes over those much older than the newest."""
    return (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("maxFileAge", "36500d")
        .load(path)
    )


def file_rejection(max_megabytes: int = MAX_MEGABYTES) -> Column:
    """Why a file is not taken; NULL if it is."""
    return (
        F.when(~F.endswith(F.lower("path"), F.lit(".eml")), "File must be an EML file")
        .when(F.col("length") == 0, "Empty file")
        .when(F.col("length") > max_megabytes * 1024 * 1024, f"File too large. Maximum size: {max_megabytes}MB")
    )


def rejected_files(files: DataFrame, max_megabytes: int = MAX_MEGABYTES) -> DataFrame:
    """Files refused by name or size.  No bytes are read for them.  Spark's file
    source lists no empty files, so those are passed over without a row."""
    return files.select("path", "length", file_rejection(max_megabytes).alias("reason")).where("reason IS NOT NULL")


def accepted_files(files: DataFrame, max_megabytes: int = MAX_MEGABYTES) -> DataFrame:
    return files.where(F.col("length").between(1, max_megabytes * 1024 * 1024)).where(
        F.endswith(F.lower("path"), F.lit(".eml"))
    )


class _Policy(email.policy.EmailPolicy):
    """The default policy, which works a header out anew each time it is asked for;
    here short ones are kept for their next use, of which a part's type has many."""

    def header_fetch_parse(self, name, value):
        if hasattr(value, "name") or len(value) > 1_000:
            return super().header_fetch_parse(name, value)
        return _header_value(name, value)


@functools.lru_cache(maxsize=1_024)
def _header_value(name: str, value: str):
    return email.policy.default.header_fetch_parse(name, value)


_POLICY = _Policy()


def _header(message, name: str) -> str:
    return str(message.get(name, "") or "").strip()


def _content(part) -> str:
    try:
        text = part.get_content()
    except (LookupError, KeyError, ValueError, AttributeError):
        return ""
    return text if isinstance(text, str) else ""


def _bodies(message) -> tuple[str, str]:
    """First non-empty plain part and first non-empty HTML part."""
    found = {"text/plain": "", "text/html": ""}
    for part in message.walk():
        kind = part.get_content_type()
        if kind in found and not found[kind]:
            found[kind] = _content(part)
    if not any(found.values()) and isinstance(message.get_payload(), str):
        found["text/plain"] = message.get_payload()
    return found["text/plain"], found["text/html"]


def _attachments(message) -> list[dict]:
    out = []
    for part in message.walk():
        if part.get_content_disposition() != "attachment":
            continue
        data = part.get_payload(decode=True)
        if not data:
            continue
        checksum = hashlib.sha256(data).hexdigest()
        out.append(
            {
                "filename": part.get_filename() or f"attachment_{checksum[:8]}",
                "content_type": part.get_content_type(),
                "size": len(data),
                "checksum": checksum,
                "content": data,
            }
        )
    return out


def _parse(path: str, received_at, raw_hash: str, content: bytes) -> dict:
    row = {"path": path, "received_at": received_at, "raw_hash": raw_hash, "parse_error": None}
    try:
        message = email.message_from_bytes(content, policy=_POLICY)
        text, html = _bodies(message)
        return row | {
            "message_id": _header(message, "Message-ID"),
            "from_addr": _header(message, "From"),
            "to_addr": _header(message, "To"),
            "subject": _header(message, "Subject"),
            "text": text,
            "html": html,
            "attachments": _attachments(message),
        }
    except Exception as problem:  # one broken mail must not fail its task
        empty = dict.fromkeys(["message_id", "from_addr", "to_addr", "subject", "text", "html"], "")
        return row | empty | {"attachments": [], "parse_error": f"{type(problem).__name__}: {problem}"}


PARSED_COLUMNS = [
    "path", "received_at", "raw_hash", "message_id", "from_addr", "to_addr", "subject", "text", "html", "attachments", "parse_error",
]


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Small frames out, since one mail may hold many megabytes."""
    for batch in batches:
        for start in range(0, len(batch), 64):
            piece = batch.iloc[start : start + 64]
            rows = [_parse(*record) for record in piece.itertuples(index=False, name=None)]
            yield pd.DataFrame(rows, columns=PARSED_COLUMNS)


def parse_eml(files: DataFrame) -> DataFrame:
    """One row per file: headers, bodies, attachments with size and SHA-256."""
    picked = files.select(
        "path", F.col("modificationTime").alias("received_at"), F.sha2("content", 256).alias("raw_hash"), "content"
    )
    return picked.mapInPandas(_parse_batches, PARSED_SCHEMA)


def mail_rejection() -> Column:
    """Why a parsed mail is not taken; NULL if it is."""
    return (
        F.when(F.col("parse_error").isNotNull(), F.concat(F.lit("Invalid EML file: "), F.col("parse_error")))
        .when(F.col("message_id") == "", "Missing Message-ID header")
        .when(F.col("from_addr") == "", "Missing From header")
    )


def split_parsed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mails taken, and ``path, reason`` of the others.  Parse once and write the
    result before splitting it: each side reads its input again."""
    marked = parsed.withColumn("reason", mail_rejection())
    return marked.where("reason IS NULL").drop("reason", "parse_error"), marked.where("reason IS NOT NULL").select("path", "reason")


def mail_key(message_id: Column) -> Column:
    """Job id of a mail, the same on every run."""
    return F.substring(F.sha2(message_id, 256), 1, 32)


def explode_attachments(parsed: DataFrame) -> DataFrame:
    """One row per attachment."""
    from rosterloom.operators.skew import explode_rows

    rows = parsed.select("path", "message_id", "attachments")
    return explode_rows(rows, "attachments", "a", "attachment_idx").select("path", "message_id", "attachment_idx", "a.*")
