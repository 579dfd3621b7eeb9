"""From mail files to stored, validated versions: all jobs of a batch at once."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.functions.classify import attachment_type, body_type
from rosterloom.operators import export as exports
from rosterloom.operators import inference, known, responses, rollups
from rosterloom.operators import jobs as job_rules
from rosterloom.operators import versions as version_rules
from rosterloom.operators.classification import route
from rosterloom.operators.mapping import apply_mapping, row_mappings
from rosterloom.operators.narrative import text_rows
from rosterloom.operators.normalize import delta_table, normalize
from rosterloom.operators.skew import dense_index, explode_rows, keep_first, salted_lookup
from rosterloom.operators.tables import table_rows
from rosterloom.operators.validate import issue_table, validate, validation_statistics
from rosterloom.schema import FIELD_COLUMNS
from rosterloom.sources import mail
from rosterloom.sources.delimited import read_csv_attachments
from rosterloom.sources.spreadsheets import read_xlsx_attachments


ORIGINS = "array<struct<field:string,source:string,confidence:double>>"
KEYS, KEY_PARTS = ["message_id", "hash"], 16
COMMIT = "number bigint, batch string, own string, tables array<string>, whole boolean, buckets array<int>"


def job_measures() -> dict[str, Column]:
    """What the store counts of its jobs: their state, and the day they came in."""
    return {"status": F.col("status"), "created_day": F.to_date("created_at")}


def emails_of(parsed: DataFrame) -> DataFrame:
    """First mail of each message id, with the job id made from it."""
    first = keep_first(parsed.drop("text", "html", "attachments"), ["message_id"], ["received_at", "path"])
    return first.select(
        mail.mail_key(F.col("message_id")).alias("job_id"),
        "message_id", "from_addr", "to_addr", "subject", "received_at",
        F.col("path").alias("raw_uri"), F.col("raw_hash").alias("hash"),
    )


def artifacts_of(parsed: DataFrame) -> DataFrame:
    """Classified artifacts of each mail: the body is number 0, then its
    attachments.  Mails are narrow rows with arrays, so this is no shuffle."""
    kind = parsed.withColumn("_body", body_type(F.col("text"), F.col("html")))
    nothing = F.lit(None).cast("binary")
    body = F.struct(
        F.lit("email_body").alias("source"),
        F.col("_body.document_type").alias("document_type"),
        F.col("_body.confidence").alias("class_confidence"),
        F.col("_body.content").alias("text"),
        nothing.alias("content"),
    )

    def attached(a: Column) -> Column:
        kinds = attachment_type(a["filename"], a["content_type"])
        return F.struct(
            a["filename"].alias("source"),
            kinds["document_type"].alias("document_type"),
            kinds["confidence"].alias("class_confidence"),
            F.lit(None).cast("string").alias("text"),
            a["content"].alias("content"),
        )

    parts = F.concat(F.array(body), F.transform("attachments", attached))
    rows = kind.select(mail.mail_key(F.col("message_id")).alias("job_id"), "path", parts.alias("_parts"))
    return explode_rows(rows, "_parts", "p", "artifact_idx").select("job_id", "path", "artifact_idx", "p.*")


def extract(artifacts: DataFrame, **narrative_options) -> DataFrame:
    """Rows of every readable artifact: ``job_id, artifact_idx, row_idx, data``.
    What an attachment's reader refused is a row with ``read_error`` and no data."""
    key = ["job_id", "artifact_idx"]
    of_kind = lambda kind: artifacts.where(F.col("document_type") == kind)
    parts = [
        table_rows(of_kind("HTML_TABLE").select(*key, F.col("text").alias("html"))),
        text_rows(of_kind("PLAIN_TEXT").select(*key, "text"), **narrative_options),
        read_csv_attachments(of_kind("CSV").select(*key, "content")),
        read_xlsx_attachments(of_kind("XLSX").select(*key, "content")),
    ]
    columns = [*key, "row_idx", "data", "confidence", "extraction_method"]
    rows = parts[0].select(*columns)
    for part in parts[1:]:
        rows = rows.unionByName(part.select(*columns, *[c for c in ("read_error", "line_no") if c in part.columns]), allowMissingColumns=True)
    return rows


def clean(rows: DataFrame, as_of: str, prefix: str = "") -> DataFrame:
    """Numbered, typed, normalized and validated rows with their change log."""
    numbered = dense_index(
        rows.withColumnRenamed("row_idx", "position").withColumn("position", F.col("position").cast("bigint")),
        ["job_id"], ["artifact_idx"], "position",
    )
    unit = ["job_id", "artifact_idx"]
    typed = apply_mapping(numbered, row_mappings(rows, unit), unit, ["row_idx"])
    return validate(normalize(typed), as_of, prefix=prefix)


@dataclass(frozen=True)
class RosterStore:
    """Append-only Parquet tables below one folder, with a log of commits.

    Every try of a batch writes folders of its own, and one row in the log, written
    last, makes all of them visible at once in place of the tables of an earlier try.
    Readers see only what the log names, so a batch that failed half-way does not
    exist and can simply be repeated.  A store has one writer at a time.

    The log has one row per batch and is read on the driver; ``upto`` shows the
    store as of a commit number.  With ``buckets`` the tables that know their job
    lie in that many folders by its hash, which ``compact`` can rewrite one by one;
    a store keeps the number it was begun with."""

    spark: SparkSession
    path: str
    upto: int | None = None
    buckets: int = 0
    _open: dict[str, tuple[str, list[str]]] = field(default_factory=dict, compare=False, repr=False)

    @contextmanager
    def attempt(self, batch: str) -> Iterator[None]:
        """All writes of a batch inside become visible together at the end."""
        if batch in self._open:
            yield
            return
        own, written = self._open[batch] = (f"t{uuid.uuid4().hex}", [])
        try:
            yield
            self._commit(batch, own, written, whole=True)
        finally:
            del self._open[batch]

    def write(self, table: str, batch: str, df: DataFrame, by: tuple[str, ...] = ()) -> None:
        """Write a table of a batch, in folders by some columns if asked; visible
        at once if no attempt is open."""
        own, written = self._open.get(batch, (f"t{uuid.uuid4().hex}", []))
        folder = self.folder(table, batch, own)
        if self.buckets and not by and "job_id" in df.columns:
            self._write_buckets(folder, df)
        else:
            df.write.mode("overwrite").partitionBy(*by).parquet(folder)
            if by and not self._has_files(folder):
                return  # no rows, so no folders: the batch is without this table
        written.append(table)
        if batch not in self._open:
            self._commit(batch, own, written, whole=False)

    def folder(self, table: str, batch: str, own: str) -> str:
        return f"{self.path}/{table}/batch={batch}/try={own}"

    def _write_buckets(self, folder: str, df: DataFrame) -> None:
        """One folder per bucket; AQE cuts a bucket that one job fills."""
        placed = df.withColumn("job_bucket", bucket_of(F.col("job_id"), self.buckets)).hint("rebalance", "job_bucket")
        placed.write.mode("overwrite").partitionBy("job_bucket").parquet(folder)
        if not self._has_files(folder):
            df.limit(0).write.mode("overwrite").parquet(f"{folder}/job_bucket=0")

    def _has_files(self, folder: str) -> bool:
        try:
            self.spark.read.parquet(folder)
        except AnalysisException as problem:
            if problem.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
            return False
        return True

    def _commit(self, batch: str, own: str, written: list[str], whole: bool, buckets: list[int] | None = None) -> None:
        number = max((c.number for c in self.commits()), default=0) + 1
        row = self.spark.createDataFrame([(number, batch, own, sorted(set(written)), whole, buckets)], COMMIT)
        # A commit that broke off left no row, so its number is free.
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/commit={number}")

    def commits(self) -> list:
        """Rows of the log in their order."""
        try:
            rows = self.spark.read.schema(COMMIT).parquet(f"{self.path}/commits").drop("commit").collect()
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted((r for r in rows if self.upto is None or r.number <= self.upto), key=lambda r: r.number)

    def tries(self, table: str) -> dict[str, dict[str, set[int]]]:
        """The visible tries of each batch that has the table, with the buckets
        that a later one has taken over."""
        found: dict[str, dict[str, set[int]]] = {}
        for commit in self.commits():
            if commit.whole:
                found.pop(commit.batch, None)
            if table in commit.tables:
                if commit.buckets is None:
                    found[commit.batch] = {}
                for replaced in found[commit.batch].values():
                    replaced |= set(commit.buckets or ())
                if commit.own:
                    found[commit.batch][commit.own] = set()
        return {batch: tries for batch, tries in found.items() if tries}

    def _rows(self, table: str, tries: dict[str, dict[str, set[int]]]) -> DataFrame:
        folders = [self.folder(table, batch, own) for batch, owns in tries.items() for own in owns]
        rows = self.spark.read.option("basePath", f"{self.path}/{table}").option("mergeSchema", False).parquet(*folders)
        for owns in tries.values():
            for own, replaced in owns.items():
                if replaced:
                    rows = rows.where(~((F.col("try") == own) & F.col("job_bucket").isin(*sorted(replaced))))
        return rows.drop("try", "job_bucket")

    def read(self, table: str) -> DataFrame:
        tries = self.tries(table)
        if not tries:
            raise LookupError(f"the store has no table {table}")
        return self._rows(table, tries)

    def batch(self, table: str, batch: str) -> DataFrame:
        """A table of one batch, of the open attempt if that has written it."""
        own, written = self._open.get(batch, ("", []))
        if table in written:
            return self.spark.read.parquet(self.folder(table, batch, own)).drop("job_bucket")
        return self._rows(table, {batch: self.tries(table)[batch]}).drop("batch")

    def earlier(self, table: str, batch: str) -> DataFrame | None:
        """Rows of all other batches; None before the first."""
        tries = {name: owns for name, owns in self.tries(table).items() if name != batch}
        return self._rows(table, tries) if tries else None

    def bucket_rows(self, table: str, batch: str, own: str, buckets: list[int]) -> DataFrame | None:
        """Rows of some buckets of a try, read from their folders alone; None if it
        has none of them."""
        folder = self.folder(table, batch, own)
        try:
            rows = self.spark.read.option("basePath", folder).parquet(f"{folder}/job_bucket={{{','.join(map(str, buckets))}}}")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return rows.drop("job_bucket")

    def tables(self) -> list[str]:
        names = {table for commit in self.commits() for table in commit.tables}
        return sorted(table for table in names if self.tries(table))

    def jobs(self, batch: str | None = None) -> DataFrame:
        """Current state of each job, its newest entry; with ``batch`` the state
        without that batch, which a repeated try must start from."""
        log = self.read("jobs") if batch is None else self.earlier("jobs", batch)
        newest = F.max(F.struct("seq", "status", "current_version_id", "version_no", "created_at", "updated_at")).alias("j")
        return log.groupBy("job_id").agg(newest).select("job_id", "j.*").drop("seq")

    def jobs_in(self, batch: str) -> DataFrame:
        """Newest entry of each job that a batch has written."""
        newest = F.max(F.struct("seq", "status", "created_at")).alias("j")
        return self.batch("jobs", batch).groupBy("job_id").agg(newest).select("job_id", "j.*")

    def log_jobs(self, batch: str, changed: DataFrame) -> None:
        """Append the new state of some jobs, behind all their earlier entries."""
        earlier = self.earlier("jobs", batch)
        if earlier is None:
            numbered = changed.withColumn("seq", F.lit(1).cast("bigint"))
        else:
            last = earlier.join(changed.select("job_id"), "job_id", "left_semi").groupBy("job_id").agg(F.max("seq").alias("_seq"))
            numbered = changed.join(last, "job_id", "left").withColumn("seq", F.coalesce("_seq", F.lit(0)) + 1)
        columns = ["job_id", "status", "current_version_id", "version_no", "created_at", "updated_at", "seq"]
        before = None if earlier is None else self.jobs(batch).join(changed.select("job_id"), "job_id", "left_semi")
        self.write("jobs", batch, numbered.select(*columns))
        now = self.batch("jobs", batch)
        self.write("rollups", batch, rollups.signed_changes(before, now, job_measures()))

    def report(self, measure: str) -> DataFrame:
        """``slot, n``: a measure of the jobs' current states, from the signed rows
        that each batch has added."""
        return rollups.rolled_up(self.read("rollups"), measure).select("slot", "n")

    def current_records(self, batch: str | None = None) -> DataFrame:
        """Rows of the version that each job points to."""
        pointers = self.jobs(batch).select("job_id", F.col("current_version_id").alias("version_id"))
        return salted_lookup(self.read("records"), pointers, ["job_id", "version_id"], ["row_idx"], how="left_semi")

    def live(self, table: str) -> DataFrame:
        """A table without the jobs that have expired."""
        rows = self.read(table)
        if not self.tries("expired"):
            return rows
        gone = self.read("expired").select("job_id").distinct()
        if "job_id" in rows.columns:
            return salted_anti(rows, gone)
        if "message_id" in rows.columns:
            return salted_anti(rows.withColumn("job_id", mail.mail_key(F.col("message_id"))), gone).drop("job_id")
        return rows


def salted_anti(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of jobs that are not listed; a job may own most rows."""
    spread = [c for c, kind in rows.dtypes if c != "job_id" and "map<" not in kind] or ["job_id"]
    kept = salted_lookup(rows, gone.withColumn("_gone", F.lit(True)), ["job_id"], spread)
    return kept.where("_gone IS NULL").select(*rows.columns)


def whole_batch(step: Callable) -> Callable:
    """The step's writes become visible together, or not at all."""

    @functools.wraps(step)
    def run(store: RosterStore, batch: str, *args, **options) -> None:
        with store.attempt(batch):
            step(store, batch, *args, **options)

    return run


@whole_batch
def commit_version(
    store: RosterStore, batch: str, rows: DataFrame, author: str, reason: str, at: Column, jobs: DataFrame | None = None
) -> None:
    """Write one new version per job of ``rows``, which carry issues and deltas,
    or of ``jobs``, where a job without any row gets an empty, pending version.

    The rows are written first and read back, so that the tables derived from
    them do not repeat the extraction."""
    numbers = (rows if jobs is None else jobs).select("job_id").distinct()
    earlier = store.earlier("versions", batch)
    if earlier is None:
        numbered = numbers.withColumn("version_no", F.lit(1)).withColumn("parent_version_id", F.lit(None).cast("string"))
    else:
        mine = earlier.join(numbers, "job_id", "left_semi")
        last = mine.groupBy("job_id").agg(F.max("version_no").alias("_last"))
        pointers = store.jobs(batch).select("job_id", F.col("current_version_id").alias("parent_version_id"))
        numbered = numbers.join(last, "job_id", "left").join(pointers, "job_id", "left").select(
            "job_id", (F.coalesce("_last", F.lit(0)) + 1).alias("version_no"), "parent_version_id"
        )
    version_id = F.concat_ws(".", "job_id", "version_no").alias("version_id")
    versions = numbered.select(
        "job_id", version_id, "version_no", "parent_version_id", F.lit(author).alias("author"), F.lit(reason).alias("reason"), at.alias("created_at")
    )
    store.write("versions", batch, versions)
    committed = store.batch("versions", batch)

    named = salted_lookup(rows, committed.select("job_id", "version_id"), ["job_id"], ["row_idx"], how="inner")
    origins = "origins" if "origins" in rows.columns else F.lit(None).cast(ORIGINS).alias("origins")
    store.write("records", batch, named.select("job_id", "version_id", "row_idx", *FIELD_COLUMNS, "issues", "deltas", "is_valid", origins))
    stored = store.batch("records", batch)
    key = ["job_id", "version_id", "row_idx"]
    store.write("issues", batch, issue_table(stored, key))
    store.write("deltas", batch, delta_table(stored, key))
    counts = validation_statistics(stored, ["job_id"]).select("job_id", "status", "total_rows", "error_count", "warning_count")
    jobs = committed.join(counts, "job_id", "left").na.fill({"status": "pending", "total_rows": 0, "error_count": 0, "warning_count": 0})
    created = F.coalesce("_created", at).alias("created_at")
    if earlier is None:
        known = jobs.withColumn("_created", F.lit(None).cast("timestamp"))
    else:
        known = jobs.join(store.jobs(batch).select("job_id", F.col("created_at").alias("_created")), "job_id", "left")
    state = known.select("job_id", "status", F.col("version_id").alias("current_version_id"), "version_no", created, at.alias("updated_at"))
    store.log_jobs(batch, state)
    after = F.to_json(F.struct("version_id", "total_rows", "error_count", "warning_count"))
    store.write("audit_logs", batch, job_rules.audit_entry(jobs, "system", "version_created", at, after=after))


def _index_mails(store: RosterStore, batch: str) -> None:
    """Store the keys of a batch's mails, and the bitmap that stands before them."""
    keys = known.key_rows(store.batch("emails", batch), KEYS, "job_id", KEY_PARTS)
    store.write("mail_keys", batch, keys, by=("part",))
    store.write("mail_index", batch, known.key_index(keys))


def _model_rows(store: RosterStore, batch: str, model: inference.Model) -> DataFrame:
    """Rows from a model for the jobs that need assistance: an artifact without a
    row, or no row at all.  Calls without an answer are told in
    ``model_rejections``."""
    artifacts, rows = store.batch("artifacts", batch), store.batch("extracted", batch).where("read_error IS NULL")
    key = ["job_id", "artifact_idx"]
    flags = responses.needs_assistance(artifacts.select(*key), rows.select(*key), ["job_id"], key)
    asked = flags.where("needs_assistance").select("job_id")
    files = artifacts.where((F.col("artifact_idx") > 0) & (F.col("document_type") == "PLAIN_TEXT"))
    names = files.groupBy("job_id").agg(F.sort_array(F.collect_set("source")).alias("_names"))
    bodies = artifacts.where("artifact_idx = 0").join(asked, "job_id", "left_semi").join(names, "job_id", "left")
    plain = F.col("document_type") == "PLAIN_TEXT"
    content = responses.prompt_text(F.when(plain, F.col("text")), F.when(~plain, F.col("text")), F.col("_names"), F.col("document_type"))
    prompts = bodies.select("job_id", responses.user_prompt(content).alias("prompt"))
    store.write("model_calls", batch, inference.infer(prompts, model))
    good, dead = inference.split_answers(store.batch("model_calls", batch))
    store.write("model_rejections", batch, dead.select("job_id", "attempts", "error"))
    return responses.model_maps(good.select("job_id", "response")).select(
        "job_id", F.lit(0).alias("artifact_idx"), "row_idx", "data", F.lit(0.9).alias("confidence"), F.lit("llm").alias("extraction_method")
    )


@whole_batch
def run_batch(
    store: RosterStore, batch: str, files: DataFrame, as_of: str, at: Column | None = None, model: inference.Model | None = None, **options
) -> None:
    """Take in a set of files and store the resulting versions.

    Parsed mails are stored once; a mail whose message id or hash an earlier
    batch knows is left out.  Copies are dropped on their keys alone, before any
    join, and the wide rows meet the chosen ones on their path, which is unique.
    With a ``model``, jobs that need assistance take its rows in place of the
    rules' if it gives any."""
    at = F.lit(as_of).cast("timestamp") if at is None else at
    parsed = mail.parse_eml(mail.accepted_files(files))
    store.write("parsed", batch, parsed)
    taken, refused = mail.split_parsed(store.batch("parsed", batch))
    store.write("rejections", batch, refused.unionByName(mail.rejected_files(files).select("path", "reason")))
    fresh = emails_of(taken)
    keys = store.earlier("mail_keys", batch)
    if keys is not None:
        index = known.merged_index(store.earlier("mail_index", batch))
        met = known.find_known(fresh, "job_id", KEYS, keys, index, parts=KEY_PARTS)
        fresh = fresh.join(met.select("job_id"), "job_id", "left_anti")
    store.write("emails", batch, fresh)
    _index_mails(store, batch)
    first = taken.join(store.batch("emails", batch).select(F.col("raw_uri").alias("path")), "path", "left_semi")
    store.write("artifacts", batch, artifacts_of(first))
    store.write("extracted", batch, extract(store.batch("artifacts", batch), **options))
    extracted = store.batch("extracted", batch)
    refused = extracted.where("read_error IS NOT NULL").select("job_id", "artifact_idx", "line_no", F.col("read_error").alias("reason"))
    store.write("artifact_rejections", batch, refused)
    rows = extracted.where("read_error IS NULL").drop("read_error", "line_no")
    if model is not None:
        both = rows.withColumn("_by", F.lit("rule")).unionByName(_model_rows(store, batch, model).withColumn("_by", F.lit("model")))
        rows = responses.prefer_source(both, ["job_id"], "_by", ["model", "rule"], ["artifact_idx", "row_idx"]).drop("_by")
    store.write("rows", batch, clean(rows, as_of))
    jobs = store.batch("emails", batch)
    commit_version(store, batch, store.batch("rows", batch), "system", "Initial ingestion", at, jobs)
    store.write("routes", batch, _routes(store, batch))


def _routes(store: RosterStore, batch: str) -> DataFrame:
    """Which way each job of a batch goes: to assistance if the rules left an
    artifact or the job without rows, to review if its rows have errors."""
    key = ["job_id", "artifact_idx"]
    rows = store.batch("extracted", batch).where("read_error IS NULL").select(*key)
    flags = responses.needs_assistance(store.batch("artifacts", batch).select(*key), rows, ["job_id"], key)
    states = store.batch("jobs", batch).select("job_id", (F.col("status") == "needs_review").alias("needs_review"))
    return route(states.join(flags, "job_id", "left").withColumn("needs_assistance", F.coalesce("needs_assistance", F.lit(True))))


def resumed(records: DataFrame, as_of: str, prefix: str = "") -> DataFrame:
    """Stored or edited rows taken up again from validation on: typed values as
    they are, issues found anew, no changes to log."""
    bare = records.select("job_id", "row_idx", *FIELD_COLUMNS)
    return validate(bare, as_of, prefix=prefix).withColumn("deltas", F.array().cast("array<" + _delta_type() + ">"))


@whole_batch
def revalidate(
    store: RosterStore, batch: str, records: DataFrame, as_of: str, author: str, reason: str, at: Column, prefix: str = ""
) -> None:
    """New version from stored or edited records, with issues found anew."""
    store.write("rows", batch, resumed(records, as_of, prefix))
    commit_version(store, batch, store.batch("rows", batch), author, reason, at)


@whole_batch
def edit_cells(store: RosterStore, batch: str, edits: DataFrame, as_of: str, at: Column, author: str = "user") -> None:
    """One new version for each job that ``edits(job_id, row_idx, field, value,
    seq)`` touch; the last edit of a cell counts.  Edits of rows that the current
    version does not have are told in ``edit_rejections``."""
    key = ["job_id", "row_idx"]
    current = store.current_records(batch)
    store.write("edit_rejections", batch, version_rules.rejected_edits(current, edits, key))
    good = edits.join(store.batch("edit_rejections", batch), ["job_id", "row_idx", "field", "seq"], "left_anti")
    touched = salted_lookup(current, good.select("job_id").distinct(), ["job_id"], ["row_idx"], how="left_semi")
    edited = version_rules.apply_edits(touched.select(*key, *FIELD_COLUMNS), good, key).drop("edited")
    revalidate(store, batch, edited, as_of, author, "Cell edit", at)


def _log_changes(store: RosterStore, batch: str, jobs: DataFrame, audit: DataFrame) -> None:
    """Store the audit rows, and the new state of the jobs they tell of."""
    store.write("audit_logs", batch, audit)
    store.log_jobs(batch, jobs.join(store.batch("audit_logs", batch).select("job_id"), "job_id", "left_semi"))


@whole_batch
def roll_back(store: RosterStore, batch: str, requests: DataFrame, at: Column) -> None:
    """Point jobs to an earlier version of theirs; ``requests(job_id, version_id,
    seq)``.  No version is removed."""
    history = store.read("versions")
    jobs, audit = version_rules.rollback(store.jobs(batch), history, requests, at)
    numbers = history.select(F.col("version_id").alias("current_version_id"), "version_no")
    _log_changes(store, batch, jobs.drop("version_no").join(numbers, "current_version_id"), audit)


@whole_batch
def fail_stuck(store: RosterStore, batch: str, as_of: Column, minutes: int = 3) -> None:
    """Fail jobs that were pending or processing for too long."""
    _log_changes(store, batch, *job_rules.fail_stuck(store.jobs(batch), as_of, minutes))


def version_diff(store: RosterStore, old: str, new: str) -> DataFrame:
    """Cell changes between two versions of a job."""
    rows = lambda version: store.read("records").where(F.col("version_id") == version)
    return version_rules.diff(rows(old), rows(new), ["row_idx"], FIELD_COLUMNS)


@whole_batch
def export_jobs(store: RosterStore, batch: str, at: Column, statuses: tuple[str, ...] = ("ready", "exported")) -> None:
    """Workbooks of the current versions of the jobs in some state, and their
    log.  The workbooks are built once, and their log is read off what was stored."""
    jobs = store.jobs(batch).where(F.col("status").isin(*statuses))
    rows = salted_lookup(store.current_records(batch), jobs.select("job_id"), ["job_id"], ["row_idx"], how="left_semi")
    store.write("workbooks", batch, exports.workbooks(exports.export_rows(rows), at))
    store.write("exports", batch, exports.export_log(store.batch("workbooks", batch), at))
    done = store.batch("exports", batch).select("job_id").distinct()
    marked = jobs.join(done, "job_id", "left_semi")
    state = lambda status: F.to_json(F.struct(status.alias("status")))
    audit = job_rules.audit_entry(marked, "system", "exported", at, state(F.col("status")), state(F.lit("exported")))
    _log_changes(store, batch, marked.withColumns({"status": F.lit("exported"), "updated_at": at}), audit)


@whole_batch
def expire(store: RosterStore, batch: str, as_of: Column, days: int = 30) -> None:
    """List finished jobs last touched over ``days`` ago; ``live`` leaves them out
    of every table, and ``copy_live`` writes a store without them."""
    store.write("expired", batch, version_rules.expired_jobs(store.jobs(), as_of, days))


def bucket_of(job_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(job_id), F.lit(buckets)).cast("int")


def compact(store: RosterStore, batch: str) -> list[int]:
    """Rewrite the buckets that hold expired jobs without them, in every batch and
    table, and take these jobs out of the reports; gives the buckets.

    Other buckets are neither read nor written.  Each table of a batch changes at
    once, by a commit of its own; until then, and if a step fails, ``live`` leaves
    the expired jobs out.  The replaced files stay for snapshots of the past."""
    if not store.buckets:
        raise ValueError("the store has no buckets")
    gone = store.read("expired").select("job_id").distinct()
    touched = sorted(r.b for r in gone.select(bucket_of(F.col("job_id"), store.buckets).alias("b")).distinct().collect())
    if not touched:
        return []
    leaving = store.jobs().join(gone, "job_id", "left_semi")
    store.write("rollups", batch, rollups.signed_changes(leaving, leaving.limit(0), job_measures()))
    for table in store.tables():
        if table == "expired":  # the tombstones themselves
            continue
        for name, owns in store.tries(table).items():
            for own, replaced in owns.items():
                wanted = [b for b in touched if b not in replaced]
                rows = store.bucket_rows(table, name, own, wanted) if wanted else None
                if rows is None:
                    continue
                fresh = f"t{uuid.uuid4().hex}"
                folder = store.folder(table, name, fresh)
                kept = salted_anti(rows, gone).withColumn("job_bucket", bucket_of(F.col("job_id"), store.buckets))
                kept.hint("rebalance", "job_bucket").write.mode("overwrite").partitionBy("job_bucket").parquet(folder)
                store._commit(name, fresh if store._has_files(folder) else "", [table], whole=False, buckets=wanted)
    return touched


#: Made anew from the copied tables.
_DERIVED = ("rollups", "mail_keys", "mail_index")


def copy_live(store: RosterStore, target: RosterStore, batch: str, tables: Sequence[str] | None = None) -> None:
    """All rows that have not expired, of all tables, as one batch of another
    store.  Files that were refused have no job and stay listed."""
    with target.attempt(batch):
        for table in store.tables() if tables is None else tables:
            if table in _DERIVED:
                continue
            target.write(table, batch, store.live(table).drop("batch"))
        target.write("rollups", batch, rollups.signed_changes(None, target.jobs_in(batch), job_measures()))
        _index_mails(target, batch)


def _delta_type() -> str:
    from rosterloom.operators.normalize import DELTA_TYPE

    return DELTA_TYPE
