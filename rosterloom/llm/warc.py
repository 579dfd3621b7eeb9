"""WARC archives and a splittable reader (operator 3).

Writing: every page becomes one record in a gzip member of its own.  Of pages
with equal payloads the one with the smallest id is a response, the others are
revisits that refer to it and hold no payload.  Every task writes its own files
under names that hold its attempt and returns a manifest; only files in the
manifest of the attempts that counted are read, so repeated or lost tasks do no
harm.

Reading: archives are cut into byte ranges without regard to records.  A task
looks for gzip magic in its range, takes a member as a record only if its start
decodes to a WARC header, reads on from member to member, and owns the records
that start inside its range.  After a damaged member it looks for the next magic.

Null html is an empty payload, a null url leaves out the target.  Rows that
repeat the smallest id of a payload are all responses; null ids count as larger
than all others.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.llm.common import code, map_rows, materialize, shared_folder
from rosterloom.session import ship_package

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 64 << 20
ROLL_BYTES = 1 << 30
CHUNK = 1 << 18
HEADER_LIMIT = 1 << 16
LEVEL = 4
DATE = "2025-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def opened(uri: str):
    """File system and path of a folder or file, local or remote."""
    return fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(identifier: str | None) -> int | None:
    number = (identifier or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def member(page_id, url, payload: bytes, digest: str, revisits: bool, refers_to, level: int = LEVEL) -> bytes:
    """One record as a gzip member.  A revisit holds the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisits else http + payload
    lines = ["WARC/1.0", f"WARC-Type: {'revisit' if revisits else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if revisits:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_originals(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Pages with ``_first`` (the smallest id of their payload) and ``_shared``.

    The first pass aggregates digests only; the second joins the payloads that
    occur more than once.  A hot payload's rows are split by the join's own skew
    handling, as both its sides are shuffled for it."""
    rows = pages.select(F.col("page_id"), F.col("url"), code(F.col("html")).cast("binary").alias("_payload"))
    keyed = rows.withColumn("_digest", F.sha1("_payload"))
    firsts = (
        keyed.where(F.octet_length("_payload") >= min_bytes)
        .groupBy("_digest")
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_copies"))
        .where("_copies > 1")
        .select("_digest", "_first", F.lit(True).alias("_shared"))
    )
    return keyed.join(firsts, "_digest", "left").drop("_digest")


def write_archives(
    pages: DataFrame, folder: str, min_bytes: int = 0, level: int = LEVEL, roll_bytes: int = ROLL_BYTES
) -> DataFrame:
    """Write all pages and return the manifest: path, bytes, records."""
    ship_package(pages.sparkSession)
    rows = with_originals(pages, min_bytes)
    revisits = F.coalesce("_shared", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("_first"))
    opened(folder)[0].create_dir(opened(folder)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        done, out, path, size, count = [], None, "", 0, 0
        for batch in batches:
            for page_id, url, payload, again, first in zip(*[(v.as_py() for v in c) for c in batch.columns]):
                if out is None:
                    path = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{len(done)}.warc.gz"
                    out, size, count = system.open_output_stream(f"{base}/{path}", compression=None), 0, 0
                data = member(page_id, url, payload, base32_sha1(payload), again, first, level)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= roll_bytes:
                    out.close()
                    done.append((path, size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, count))
        names, sizes, counts = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}/{n}" for n in names], pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
            names=["path", "bytes", "records"],
        )

    source = rows.select("page_id", "url", "_payload", revisits.alias("_revisits"), "_first")
    return materialize(source.mapInArrow(write, "path string, bytes bigint, records bigint"))


class Source:
    """A file read forward in chunks, with a window that can be looked into."""

    def __init__(self, file, start: int) -> None:
        self.file, self.at, self.data, self.ended = file, start, b"", False
        file.seek(start)

    def more(self) -> bool:
        chunk = b"" if self.ended else self.file.read(CHUNK)
        self.ended = not chunk
        self.data += chunk
        return bool(chunk)

    def skip(self, count: int) -> None:
        self.data, self.at = self.data[count:], self.at + count


def is_record(source: Source) -> bool:
    """Whether the window starts with a member that decodes to a WARC header.  A
    member may need some hundred bytes before its first letter comes out, so the
    window is widened until it does."""
    while True:
        try:
            head = zlib.decompressobj(31).decompress(source.data[:HEADER_LIMIT], 7)
        except zlib.error:
            return False
        if len(head) == 7:
            return head == b"WARC/1."
        if len(source.data) >= HEADER_LIMIT or not source.more():
            return False


def next_record(source: Source, end: int) -> bool:
    """Move to the next record that starts before ``end``."""
    while source.at < end:
        found = source.data.find(MAGIC)
        if found < 0:
            keep = min(len(source.data), len(MAGIC) - 1)
            source.skip(len(source.data) - keep)
            if not source.more():
                return False
            continue
        source.skip(found)
        if source.at >= end:
            return False
        if is_record(source):
            return True
        source.skip(1)
    return False


def inflate(source: Source) -> bytes | None:
    """Decode the member at the window's start and step behind it; None if it is
    damaged, having stepped over its magic."""
    unpacker, parts = zlib.decompressobj(31), []
    used, start = 0, source.at
    rest = source.data
    try:
        while True:
            parts.append(unpacker.decompress(rest))
            if unpacker.eof:
                used += len(rest) - len(unpacker.unused_data)
                break
            used += len(rest)
            source.skip(len(source.data))
            if not source.more():
                raise zlib.error("cut off")
            rest = source.data
    except zlib.error:
        source.__init__(source.file, start + 1)
        return None
    source.skip(start + used - source.at)
    return b"".join(parts)


def parse(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of a decoded record."""

    def fields(head: bytes) -> dict[str, str]:
        pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
        return {name.strip().lower(): value.strip() for name, _, value in pairs}

    head, _, rest = record.partition(b"\r\n\r\n")
    warc = fields(head)
    block = rest[: int(warc.get("content-length", "0"))]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def records_in(file, start: int, end: int) -> Iterator[bytes]:
    """Decoded records that start in [start, end)."""
    source = Source(file, start)
    while next_record(source, end):
        record = inflate(source)
        if record is not None:
            yield record


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = False) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type,
    refers_to, target, intact (the digest of a response fits its payload) and, if
    asked for, payload.  A revisit's figures are those of the payload it stands for."""
    spark = manifest.sparkSession
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("bigint")))
    splits = manifest.select("path", "bytes", starts.alias("start"))
    splits = splits.select("path", "start", F.least("bytes", F.col("start") + split_bytes).alias("end"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(rows):
        for path, start, end in rows:
            system, name = opened(path)
            with system.open_input_file(name) as file:
                for record in records_in(file, start, end):
                    warc, http, payload = parse(record)
                    digest = warc.get("warc-payload-digest", "").removeprefix("sha1:")
                    again = warc["warc-type"] == "revisit"
                    row = (
                        page_of(warc["warc-record-id"]),
                        int(http["content-length"]) if again else len(payload),
                        digest,
                        warc["warc-type"],
                        page_of(warc.get("warc-refers-to")),
                        warc.get("warc-target-uri"),
                        again or base32_sha1(payload) == digest,
                    )
                    yield (*row, None if again else payload) if with_payload else row

    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, target string, intact boolean"
    return map_rows(splits.repartition(tasks, "path", "start"), ["path", "start", "end"], read, schema + ", payload binary" * with_payload)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Write all pages to the shared folder and read the archives back."""
    folder = shared_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, min_bytes), split_bytes)
