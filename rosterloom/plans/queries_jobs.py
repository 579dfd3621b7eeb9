"""Queries on jobs, versions, reports, masking and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterloom.functions import text as T
from rosterloom.operators import analytics, export, jobs, scoring, versions
from rosterloom.operators.skew import flag_repeats, keep_first
from rosterloom.plans import twins as q
from rosterloom.plans.derive import read, relation, with_relations
from rosterloom.schema import END_TO_END_BUCKETS, FIELDS, JOB_STATUSES, LATENCY_BUCKETS, column_name

AS_OF = "2000-01-01 00:00:00"
def clock():
    return F.lit(AS_OF).cast("timestamp_ntz")


EDITED = ["Provider NPI", "Phone Number", "Term Reason"]


def text_time(name: str):
    return F.col(name).cast("string").alias(name)


# --- joins and lists ------------------------------------------------------------
def jobs_with_mail(spark, folder):
    out = jobs.jobs_with_mail(relation(spark, folder, "job"), relation(spark, folder, "email"))
    return out.select("job_id", "status", "message_id", "from_addr", "subject")


def job_page(spark, folder):
    out = jobs.list_jobs(relation(spark, folder, "job"), skip=40, limit=25, status="ready")
    return out.select("job_id", "status", text_time("created_at"), "total", "has_more")


def latest_jobs(spark, folder):
    return jobs.latest_jobs(relation(spark, folder, "job")).select("job_id", "status", text_time("created_at"))


def known_mails(spark, folder):
    mails = relation(spark, folder, "email")
    known = mails.select((F.col("id") + 1000000).alias("id"), "message_id", "hash")
    return jobs.find_duplicates(mails.select("id", "message_id", "hash"), known).select("id", "existing_id")


def issues_of_jobs(spark, folder):
    wanted = relation(spark, folder, "job").where("status = 'needs_review'").select("job_id")
    found = jobs.issues_of_jobs(relation(spark, folder, "issue"), relation(spark, folder, "version"), wanted)
    return found.groupBy("version_id", "field", "level").agg(F.count(F.lit(1)).alias("issues"))


def job_details(spark, folder):
    out = jobs.job_details(*[relation(spark, folder, n) for n in ("job", "version", "record", "issue", "export")])
    return out.select(
        "job_id", "status", "total_records", "error_count", "warning_count", "info_count", "issues_count", "versions", "exports", "latest_export"
    )


def first_mails(spark, folder):
    return keep_first(relation(spark, folder, "email"), ["message_id"], ["received_at", "id"]).select("id", "message_id", "subject")


def repeated_texts(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return flag_repeats(docs, ["hash"], ["doc_id"])


# --- versions ---------------------------------------------------------------------
def latest_versions(spark, folder):
    return versions.latest_versions(relation(spark, folder, "version")).withColumn("created_at", F.col("created_at").cast("string"))


def version_history(spark, folder):
    out = versions.version_history(*[relation(spark, folder, n) for n in ("version", "record", "issue")])
    return out.withColumn("created_at", F.col("created_at").cast("string"))


def edited_rows(spark, folder):
    rows = relation(spark, folder, "roster").select("row_idx", *[column_name(f) for f in EDITED])
    return versions.apply_edits(rows, relation(spark, folder, "edit"), ["row_idx"], EDITED)


def _moved(rows, rest: int, of: int):
    """All rows, some of them under another key, where nothing else is."""
    return rows.withColumn("row_idx", F.when(F.col("row_idx") % of == rest, -F.col("row_idx")).otherwise(F.col("row_idx")))


_MOVED = lambda rest, of: f"CASE WHEN row_idx % {of} = {rest} THEN -row_idx ELSE row_idx END"


def rejected_edits(spark, folder):
    rows = _moved(relation(spark, folder, "roster"), 0, 3)
    return versions.rejected_edits(rows, relation(spark, folder, "edit"), ["row_idx"])


def version_changes(spark, folder):
    columns = [column_name(f) for f in EDITED]
    old = _moved(relation(spark, folder, "roster"), 1, 10).select("row_idx", *columns)
    new = _moved(edited_rows(spark, folder), 2, 10).drop("edited")
    return versions.diff(old, new, ["row_idx"], columns)


def lineage(spark, folder):
    return versions.lineage_depth(relation(spark, folder, "version"))


def _rolled(spark, folder):
    history = relation(spark, folder, "version")
    current = versions.latest_versions(history).select(
        "job_id", F.col("version_id").alias("current_version_id"), clock().alias("updated_at")
    )
    lines = read(spark, folder, "lineitem")
    job = F.col("l_orderkey") - F.col("l_orderkey") % 16
    wanted = lines.select(
        job.alias("job_id"), (job + F.col("l_partkey") % 20).alias("version_id"), (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("seq")
    )
    return versions.rollback(current, history, wanted, F.lit("2001-01-01").cast("timestamp_ntz"))


def rolled_back_jobs(spark, folder):
    return _rolled(spark, folder)[0].withColumn("updated_at", F.col("updated_at").cast("string"))


def rollback_audit(spark, folder):
    return _rolled(spark, folder)[1].drop("created_at")


ROLLED = with_relations("version") + (
    ", cur AS (SELECT job_id, arg_max(version_id, (created_at, version_id)) AS current_version_id FROM version_t GROUP BY job_id)"
    ", req AS (SELECT job_id, arg_max(version_id, (seq, version_id)) AS target FROM (SELECT l_orderkey - l_orderkey % 16 AS job_id,"
    " l_orderkey - l_orderkey % 16 + l_partkey % 20 AS version_id, l_partkey * 8 + l_linenumber AS seq FROM lineitem) GROUP BY job_id)"
    ", moved AS (SELECT c.job_id, current_version_id, CASE WHEN EXISTS (SELECT 1 FROM version_t v WHERE v.job_id = c.job_id AND v.version_id = target) THEN target END AS target"
    " FROM cur c LEFT JOIN req r ON c.job_id = r.job_id) "
)


def _expired(spark, folder):
    tables = {
        "jobs": relation(spark, folder, "job"),
        "versions": relation(spark, folder, "version").withColumn("job_id", F.col("version_id")),
        "records": relation(spark, folder, "record").withColumn("job_id", F.col("version_id")),
        "issues": relation(spark, folder, "issue"),
    }
    return versions.expire(tables, clock(), days=30)


def expired_tables(spark, folder):
    """Rows left per table after retention, per month of the job key."""
    kept = _expired(spark, folder)
    parts = [
        t.select(F.lit(name).alias("table"), (F.col("job_id" if "job_id" in t.columns else "version_id") % 12).alias("slot"))
        for name, t in kept.items()
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionAll(part)
    return union.groupBy("table", "slot").agg(F.count(F.lit(1)).alias("kept"))


def stuck_jobs(spark, folder):
    out, _ = jobs.fail_stuck(relation(spark, folder, "job"), clock())
    return out.select("job_id", "status", text_time("updated_at"))


def stuck_audit(spark, folder):
    return jobs.fail_stuck(relation(spark, folder, "job"), clock())[1].drop("created_at")


def reprocessable(spark, folder):
    return jobs.reprocessable(relation(spark, folder, "job")).select("job_id", "status")


# --- reports ------------------------------------------------------------------------
def job_status(spark, folder):
    return analytics.job_status(relation(spark, folder, "job"))


def status_share(spark, folder):
    return analytics.status_share(relation(spark, folder, "job"))


def totals(spark, folder):
    return analytics.analytics(relation(spark, folder, "job"), relation(spark, folder, "export"))


def daily_activity(spark, folder):
    out = analytics.daily_activity(relation(spark, folder, "job"), relation(spark, folder, "export"))
    return out.withColumn("day", F.col("day").cast("string"))


def issue_levels(spark, folder):
    return jobs.issue_levels(relation(spark, folder, "issue"), ["version_id"])


def issue_heat_map(spark, folder):
    return analytics.issue_heat_map(relation(spark, folder, "issue"))


def hot_senders(spark, folder):
    levels = jobs.issue_levels(relation(spark, folder, "issue").withColumnRenamed("version_id", "job_id"), ["job_id"])
    return analytics.hot_senders(relation(spark, folder, "job"), relation(spark, folder, "email"), levels)


def fallback_rates(spark, folder):
    rows = read(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("document_type"), F.when(F.col("l_linestatus") == "O", "narrative_text").otherwise("html_table").alias("extraction_method")
    )
    return analytics.fallback_rate(rows, "narrative_text")


def edits_per_job(spark, folder):
    return analytics.edits_per_job(relation(spark, folder, "version"))


def stage_runs(spark, folder):
    return analytics.stage_runs(relation(spark, folder, "stage_event"))


def latency_histogram(spark, folder):
    return analytics.latency_histogram(relation(spark, folder, "stage_event"))


def end_to_end_histogram(spark, folder):
    runs = relation(spark, folder, "stage_event").groupBy("job_id").agg(F.sum("duration_s").alias("duration_s"), F.max("status").alias("status"))
    return analytics.latency_histogram(runs, END_TO_END_BUCKETS, key="status")


def _histogram_sql(source: str, key: str, buckets: list[float]) -> str:
    parts = [f"SELECT {key}, '{b}' AS le, count(*) FILTER (duration_s <= {b}) AS runs FROM {source} GROUP BY {key}" for b in buckets]
    parts.append(f"SELECT {key}, '+Inf' AS le, count(*) AS runs FROM {source} GROUP BY {key}")
    return " UNION ALL ".join(parts)


def recent_activity(spark, folder):
    audit = read(spark, folder, "events").select(
        F.col("event_id").alias("audit_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("action"), F.col("user_id").alias("job_id")
    )
    return analytics.recent_activity(audit).select("audit_id", "action", "job_id")


# --- export ----------------------------------------------------------------------------
def _exportable(spark, folder):
    rows = relation(spark, folder, "roster").withColumn("version_id", F.col("job_id") * 10 + 1)
    return export.export_rows(rows.drop("fax_number"))


def export_rows(spark, folder):
    return _exportable(spark, folder)


def provenance(spark, folder):
    return export.provenance(_exportable(spark, folder), clock())


def provenance_sheet(spark, folder):
    return export.provenance_sheet(provenance(spark, folder))


def workbook_parts(spark, folder):
    """Workbooks of every job, built on the executors; their sizes only.
    Row numbers are dense per job, which bounds the parts."""
    from rosterloom.operators.skew import dense_index

    rows = dense_index(_exportable(spark, folder).withColumnRenamed("row_idx", "position"), ["job_id"], [], "position").drop("position")
    books = export.workbooks(rows, clock())
    return books.select("job_id", "part", "record_count", (F.length("content") > 0).alias("written"))


# --- privacy and scores -------------------------------------------------------------------
def masked_texts(spark, folder):
    """Documents with masked identifiers, phones and mail addresses."""
    docs = read(spark, folder, "documents").select("doc_id", T.mask_pii(F.col("text")).alias("masked"))
    return docs.select("doc_id", F.sha2("masked", 256).alias("hash"), F.length("masked").alias("size"))


def masked_contacts(spark, folder):
    rows = relation(spark, folder, "roster")
    line = F.concat_ws(" / ", "provider_npi", "phone_number", "email")
    return rows.select(
        "row_idx", T.mask_pii(line).alias("masked"), T.mask_pii(line, npi=False, phone=False).alias("masked_mail"), T.mask_pii(line, email=False).alias("masked_numbers")
    )


def completion_scores(spark, folder):
    scored = scoring.score(relation(spark, folder, "completion"))
    return scored.select("completion_id", *scoring.REWARDS, "total")


def advantages(spark, folder):
    scored = scoring.score(relation(spark, folder, "completion")).select("completion_id", "prompt_id", "total")
    return scoring.group_advantage(scored, "prompt_id", ["completion_id"])


def training_samples(spark, folder):
    fields = F.create_map(
        F.lit("Provider Name"), F.when(F.col("row_idx") % 2 == 0, "Dr. Ann \"Lee\", MD").otherwise(T.strip(F.col("provider_name"))),
        F.lit("Line Of Business"), F.concat(F.col("line_of_business"), F.lit(", PPO")),
        F.lit("TIN"), F.when(F.col("row_idx") % 3 == 0, F.col("tin")),
    )
    body = F.when(F.col("row_idx") % 2 == 0, F.concat(F.lit("Subject: x\nHello\n"), "tin")).otherwise("Hello\nSubject: y")
    rows = relation(spark, folder, "roster").select("row_idx", body.alias("email_body"), fields.alias("extracted_fields"))
    return scoring.chat_samples(rows, "SYSTEM", "Read: {email} Done.", "</s>").select("row_idx", "text", "prompt", "answer")


def shuffled(spark, folder):
    """Random order of the samples; the check sees its rows, not their order."""
    return scoring.shuffled(relation(spark, folder, "completion").select("completion_id"), ["completion_id"], seed=7)


_V = lambda f: f"trim(json_extract_string(o, '$.\"{f}\"'))"
_NOT_FOUND = "'Information not found'"


def _graded(field: str, absent: float, good: str, yes: float, no: float) -> str:
    v = _V(field)
    return f"(CASE WHEN {v} IS NULL THEN 0.0 WHEN {v} = {_NOT_FOUND} THEN {absent} WHEN {good.replace('@', v)} THEN {yes} ELSE {no} END)::DOUBLE"


_DMY = "try_strptime(@, '%d/%m/%Y') IS NOT NULL"
_LOB = "len(list_filter(list_transform(string_split(@, ','), lambda p: trim(p)), lambda p: p <> '')) > 0 AND len(list_filter(list_transform(string_split(@, ','), lambda p: trim(p)), lambda p: p NOT IN ('', 'Medicare', 'Medicaid', 'Commercial'))) = 0"
_TITLED = "NOT (contains(lower(@), 'dr.') OR contains(lower(@), ', md') OR contains(lower(@), ' m.d.') OR lower(@) LIKE '% md')"
_EXPECTED = {"Provider Name": "Ann Lee, MD", "Effective Date": "2024-01-02", "Phone Number": "555-123-4567", "Group NPI": "1"}
_RAW = lambda f: f"json_extract_string(o, '$.\"{f}\"')"
_FULL = " + ".join(
    f"CASE WHEN coalesce({_RAW(f)}, '') = '' THEN -0.5 WHEN {_RAW(f)} = {q.lit(v)} THEN 0.4 ELSE 0.0 END" for f, v in _EXPECTED.items()
)
SCORES = (
    with_relations("completion")
    + f", p AS (SELECT completion_id, prompt_id, {q.json_object('completion')} AS o FROM completion_t)"
    ", sc AS (SELECT completion_id, prompt_id, CASE WHEN o IS NULL THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS json_format,"
    f" {_graded('Provider Name', 0.5, _TITLED, 1.0, 0.5)} AS name,"
    f" {_graded('Effective Date', 1.0, _DMY, 1.0, 0.0)} + {_graded('Term Date', 1.0, _DMY, 1.0, 0.0)} AS dates,"
    f" {_graded('Line Of Business', 1.0, _LOB, 1.0, 0.0)} AS line_of_business,"
    f" {_graded('Phone Number', 1.0, 'regexp_full_match(@, ' + q.lit('[0-9]{3}-[0-9]{3}-[0-9]{4}') + ')', 1.0, 0.0)} AS phone,"
    f" {_graded('Provider NPI', 1.0, 'length(regexp_replace(@, ' + q.lit('[^0-9]') + ', ' + q.lit('') + ', ' + q.lit('g') + ')) = 10', 1.0, 0.0)} AS npi,"
    f" CASE WHEN o IS NULL THEN 0.0::DOUBLE ELSE round(({_FULL})::DOUBLE, 6) + 0.0 END AS full_score FROM p)"
    ", st AS (SELECT *, round(json_format + name + dates + line_of_business + phone + npi + full_score, 6) AS total FROM sc) "
)
_MASK_NPI = lambda e: f"regexp_replace({e}, '\\b\\d{{10}}\\b', 'NPI_****', 'g')"
_MASK_PHONE = lambda e: f"regexp_replace({e}, '\\(?\\d{{3}}\\)?[-.\\s]?\\d{{3}}[-.\\s]?\\d{{4}}', 'PHONE_****', 'g')"
_MASK_MAIL = lambda e: f"regexp_replace({e}, '\\b[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\\.[A-Za-z]{{2,}})\\b', '***@\\1', 'g')"
_MASK = lambda e: _MASK_MAIL(_MASK_PHONE(_MASK_NPI(e)))
_LINE = "concat_ws(' / ', provider_npi, phone_number, email)"

_EDITS = (
    ", e AS (SELECT row_idx, "
    + ", ".join(f"arg_max(value, (seq, value)) FILTER (field = {q.lit(f)}) AS n_{column_name(f)}" for f in EDITED)
    + " FROM edit_t GROUP BY row_idx), edited AS (SELECT r.row_idx, "
    + ", ".join(f"coalesce(n_{column_name(f)}, r.{column_name(f)}) AS {column_name(f)}" for f in EDITED)
    + ", e.row_idx IS NOT NULL AS edited FROM roster_t r LEFT JOIN e ON r.row_idx = e.row_idx) "
)
_CHANGES = " UNION ALL ".join(
    f"SELECT coalesce(a.row_idx, b.row_idx) AS row_idx, {q.lit(c)} AS field, nullif(a.{c}, '') AS old_value, nullif(b.{c}, '') AS new_value FROM a FULL JOIN b ON a.row_idx = b.row_idx"
    for c in (column_name(f) for f in EDITED)
)
_OLD = f"(status IN ('ready', 'failed') AND updated_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY)"
_STUCK = f"(status IN ('pending', 'processing') AND updated_at < TIMESTAMP '{AS_OF}' - INTERVAL 3 MINUTE)"
_EXPORT_COLUMNS = ", ".join(f"{column_name(f) if f != 'Fax Number' else chr(39) * 2} AS \"{f}\"" for f in FIELDS)
_QUOTE = lambda e: f"CAST(to_json({e}) AS VARCHAR)"

QUERIES = [
    (
        "jobs_with_mail",
        jobs_with_mail,
        with_relations("job", "email") + "SELECT job_id, status, message_id, from_addr, subject FROM job_t JOIN email_t ON email_id = id",
    ),
    (
        "job_page",
        job_page,
        with_relations("job")
        + ", r AS (SELECT * FROM job_t WHERE status = 'ready') SELECT job_id, status, CAST(created_at AS VARCHAR) AS created_at, (SELECT count(*) FROM r) AS total, (SELECT count(*) FROM r) > 65 AS has_more"
        " FROM r ORDER BY r.created_at DESC, job_id DESC LIMIT 25 OFFSET 40",
    ),
    (
        "latest_jobs",
        latest_jobs,
        with_relations("job") + "SELECT job_id, status, CAST(created_at AS VARCHAR) AS created_at FROM job_t ORDER BY job_t.created_at DESC, job_id DESC LIMIT 50",
    ),
    (
        "known_mails",
        known_mails,
        with_relations("email")
        + ", k AS (SELECT id + 1000000 AS id, message_id, hash FROM email_t)"
        " SELECT e.id, min(k.id) AS existing_id FROM email_t e JOIN k ON e.message_id = k.message_id OR e.hash = k.hash GROUP BY e.id",
    ),
    (
        "issues_of_jobs",
        issues_of_jobs,
        with_relations("job", "version", "issue")
        + "SELECT version_id, field, level, count(*) AS issues FROM issue_t WHERE version_id IN (SELECT version_id FROM version_t WHERE job_id IN (SELECT job_id FROM job_t WHERE status = 'needs_review')) GROUP BY ALL",
    ),
    (
        "job_details",
        job_details,
        with_relations("job", "version", "record", "issue", "export")
        + ", i AS (SELECT version_id, count(*) FILTER (level = 'error') AS e, count(*) FILTER (level = 'warning') AS w, count(*) FILTER (level = 'info') AS f FROM issue_t GROUP BY 1)"
        ", r AS (SELECT version_id, count(*) AS n FROM record_t GROUP BY 1), v AS (SELECT job_id, count(*) AS n FROM version_t GROUP BY 1)"
        ", x AS (SELECT job_id, count(*) AS n, arg_max(file_uri, (created_at, file_uri)) AS u FROM export_t GROUP BY 1)"
        " SELECT j.job_id, status, coalesce(r.n, 0) AS total_records, coalesce(e, 0) AS error_count, coalesce(w, 0) AS warning_count, coalesce(f, 0) AS info_count,"
        " coalesce(e + w + f, 0) AS issues_count, coalesce(v.n, 0) AS versions, coalesce(x.n, 0) AS exports, u AS latest_export"
        " FROM job_t j LEFT JOIN i ON i.version_id = current_version_id LEFT JOIN r ON r.version_id = current_version_id LEFT JOIN v ON v.job_id = j.job_id LEFT JOIN x ON x.job_id = j.job_id",
    ),
    (
        "first_mails",
        first_mails,
        with_relations("email") + "SELECT id, message_id, subject FROM email_t QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY received_at, id) = 1",
    ),
    (
        "repeated_texts",
        repeated_texts,
        "SELECT doc_id, h AS hash, row_number() OVER (PARTITION BY h ORDER BY doc_id) > 1 AS is_repeat FROM (SELECT doc_id, sha256(text) AS h FROM documents)",
    ),
    (
        "latest_versions",
        latest_versions,
        with_relations("version")
        + "SELECT job_id, arg_max(version_id, (created_at, version_id)) AS version_id, CAST(max(created_at) AS VARCHAR) AS created_at, count(*) AS versions FROM version_t GROUP BY job_id",
    ),
    (
        "version_history",
        version_history,
        with_relations("version", "record", "issue")
        + "SELECT v.version_id, job_id, parent_version_id, author, CAST(created_at AS VARCHAR) AS created_at, (SELECT count(*) FROM record_t r WHERE r.version_id = v.version_id) AS record_count,"
        " (SELECT count(*) FROM issue_t i WHERE i.version_id = v.version_id) AS issue_count FROM version_t v",
    ),
    ("edited_rows", edited_rows, with_relations("roster", "edit") + _EDITS + "SELECT * FROM edited"),
    (
        "rejected_edits",
        rejected_edits,
        with_relations("roster", "edit") + "SELECT * FROM edit_t WHERE row_idx NOT IN (SELECT " + _MOVED(0, 3) + " FROM roster_t)",
    ),
    (
        "version_changes",
        version_changes,
        with_relations("roster", "edit")
        + _EDITS
        + f", a AS (SELECT * REPLACE ({_MOVED(1, 10)} AS row_idx) FROM roster_t), b AS (SELECT * REPLACE ({_MOVED(2, 10)} AS row_idx) FROM edited), c AS ({_CHANGES})"
        " SELECT *, CASE WHEN old_value IS NULL THEN 'added' WHEN new_value IS NULL THEN 'removed' ELSE 'changed' END AS change FROM c WHERE old_value IS DISTINCT FROM new_value",
    ),
    (
        "lineage_depth",
        lineage,
        with_relations("version").replace("WITH ", "WITH RECURSIVE ", 1)
        + ", walk AS (SELECT version_id, version_id AS root, 0 AS depth FROM version_t WHERE parent_version_id IS NULL"
        " UNION ALL SELECT v.version_id, w.root, w.depth + 1 FROM version_t v JOIN walk w ON v.parent_version_id = w.version_id) SELECT version_id, root, CAST(depth AS BIGINT) AS depth FROM walk",
    ),
    (
        "rolled_back_jobs",
        rolled_back_jobs,
        ROLLED
        + f"SELECT job_id, coalesce(target, current_version_id) AS current_version_id, CASE WHEN target IS NULL THEN '{AS_OF}' ELSE '2001-01-01 00:00:00' END AS updated_at FROM moved",
    ),
    (
        "rollback_audit",
        rollback_audit,
        ROLLED
        + "SELECT job_id, 'user' AS actor, 'rollback' AS action, '{\"current_version_id\":' || current_version_id || '}' AS before_json, '{\"current_version_id\":' || target || '}' AS after_json FROM moved WHERE target IS NOT NULL",
    ),
    (
        "expired_tables",
        expired_tables,
        with_relations("job")
        + f", old AS (SELECT job_id FROM job_t WHERE {_OLD})"
        + " UNION ALL ".join(
            f"{'' if i else ' '}SELECT '{t}' AS \"table\", {k} % 12 AS slot, count(*) AS kept FROM {src} WHERE {k} NOT IN (SELECT job_id FROM old) GROUP BY ALL"
            for i, (t, k, src) in enumerate(
                [("jobs", "job_id", "job_t"), ("versions", "o_orderkey", "orders"), ("records", "l_orderkey", "lineitem"), ("issues", "l_orderkey", "lineitem")]
            )
        ),
    ),
    (
        "stuck_jobs",
        stuck_jobs,
        with_relations("job")
        + f"SELECT job_id, CASE WHEN {_STUCK} THEN 'failed' ELSE status END AS status, CASE WHEN {_STUCK} THEN '{AS_OF}' ELSE CAST(updated_at AS VARCHAR) END AS updated_at FROM job_t",
    ),
    (
        "stuck_audit",
        stuck_audit,
        with_relations("job")
        + "SELECT job_id, 'system' AS actor, 'job_timeout' AS action, '{\"status\":\"' || status || '\"}' AS before_json, '{\"status\":\"failed\"}' AS after_json"
        + f" FROM job_t WHERE {_STUCK}",
    ),
    ("reprocessable_jobs", reprocessable, with_relations("job") + "SELECT job_id, status FROM job_t WHERE status IN ('pending', 'failed')"),
    (
        "job_status",
        job_status,
        with_relations("job") + "SELECT count(*) AS total_jobs, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}_jobs" for s in JOB_STATUSES) + " FROM job_t",
    ),
    (
        "status_share",
        status_share,
        with_relations("job") + "SELECT status, count(*) AS jobs, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM job_t), 1) AS share FROM job_t GROUP BY status",
    ),
    (
        "job_totals",
        totals,
        with_relations("job")
        + "SELECT count(*) AS total_jobs, count(*) FILTER (d) AS completed_jobs, count(*) FILTER (status IN ('pending', 'processing')) AS pending_jobs, count(*) FILTER (status = 'failed') AS error_jobs,"
        " round(avg(CASE WHEN d THEN (epoch_us(updated_at) - epoch_us(created_at)) / 60e6 END), 9) AS avg_processing_minutes, round(count(*) FILTER (d) * 100.0::DOUBLE / count(*), 1) AS success_rate,"
        " (SELECT count(*) FROM lineitem) AS total_exports FROM (SELECT *, status IN ('ready', 'exported') AS d FROM job_t)",
    ),
    (
        "daily_activity",
        daily_activity,
        "SELECT CAST(CAST(t AS DATE) AS VARCHAR) AS day, CAST(sum(j) AS BIGINT) AS jobs, CAST(sum(e) AS BIGINT) AS exports FROM (SELECT o_orderdate AS t, 1 AS j, 0 AS e FROM orders UNION ALL SELECT l_shipdate, 0, 1 FROM lineitem) GROUP BY 1",
    ),
    (
        "issue_levels",
        issue_levels,
        with_relations("issue") + "SELECT version_id, count(*) FILTER (level = 'error') AS error_count, count(*) FILTER (level = 'warning') AS warning_count, count(*) FILTER (level = 'info') AS info_count FROM issue_t GROUP BY 1",
    ),
    ("issue_heat_map", issue_heat_map, with_relations("issue") + "SELECT field, level, count(*) AS issues FROM issue_t GROUP BY ALL"),
    (
        "hot_senders",
        hot_senders,
        with_relations("job", "email", "issue")
        + ", l AS (SELECT version_id, count(*) FILTER (level = 'error') AS e FROM issue_t GROUP BY 1)"
        " SELECT from_addr, count(*) AS jobs, CAST(coalesce(sum(e), 0) AS BIGINT) AS errors FROM job_t j JOIN email_t m ON j.email_id = m.id LEFT JOIN l ON l.version_id = j.job_id GROUP BY 1",
    ),
    (
        "fallback_rates",
        fallback_rates,
        "SELECT l_returnflag AS document_type, count(*) AS rows, round(count(*) FILTER (l_linestatus = 'O') / count(*), 4) AS fallback_rate FROM lineitem GROUP BY 1",
    ),
    ("edits_per_job", edits_per_job, with_relations("version") + "SELECT job_id, count(*) FILTER (author = 'user') AS edits, count(*) AS versions FROM version_t GROUP BY 1"),
    (
        "stage_runs",
        stage_runs,
        with_relations("stage_event") + "SELECT agent, status, count(*) AS runs, round(avg(duration_s), 9) AS avg_seconds FROM stage_event_t GROUP BY ALL",
    ),
    ("latency_histogram", latency_histogram, with_relations("stage_event") + _histogram_sql("stage_event_t", "agent", LATENCY_BUCKETS)),
    (
        "end_to_end_histogram",
        end_to_end_histogram,
        with_relations("stage_event")
        + ", runs AS (SELECT job_id, sum(duration_s) AS duration_s, max(status) AS status FROM stage_event_t GROUP BY 1) "
        + _histogram_sql("runs", "status", END_TO_END_BUCKETS),
    ),
    (
        "recent_activity",
        recent_activity,
        "SELECT event_id AS audit_id, event_type AS action, user_id AS job_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 10",
    ),
    (
        "export_rows",
        export_rows,
        with_relations("roster") + f"SELECT job_id, job_id * 10 + 1 AS version_id, row_idx, {_EXPORT_COLUMNS} FROM roster_t",
    ),
    (
        "provenance",
        provenance,
        f"SELECT o_custkey AS job_id, o_custkey * 10 + 1 AS version_id, '{AS_OF}' AS export_date, count(*) AS record_count FROM orders GROUP BY 1",
    ),
    (
        "provenance_sheet",
        provenance_sheet,
        f"WITH p AS (SELECT o_custkey AS j, o_custkey * 10 + 1 AS v, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT j, v, unnest(["
        + ", ".join(
            f"{{'line': {i}, 'entry': {q.lit(e)}, 'value': {x}}}"
            for i, (e, x) in enumerate(
                [
                    ("Job ID", "CAST(j AS VARCHAR)"), ("Version ID", "CAST(v AS VARCHAR)"), ("Record Count", "CAST(n AS VARCHAR)"),
                    ("Export Date", f"'{AS_OF} UTC'"), ("Export Format", "'Excel (.xlsx)'"), ("Schema Version", "'1.0'"), ("Schema Fields", "'17'"),
                    ("Content Hash", f"substr(sha256(concat_ws(':', j, v, n, '{AS_OF}')), 1, 16)"),
                ]
            )
        )
        + "]) AS r FROM p) SELECT j AS job_id, v AS version_id, r.line AS line, r.entry AS entry, r.value AS value FROM s",
    ),
    (
        "workbook_parts",
        workbook_parts,
        "SELECT CAST(o_custkey AS VARCHAR) AS job_id, n // 50000 AS part, count(*) AS record_count, true AS written FROM"
        " (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders) GROUP BY ALL",
    ),
    ("masked_texts", masked_texts, f"SELECT doc_id, sha256(m) AS hash, length(m) AS size FROM (SELECT doc_id, {_MASK('text')} AS m FROM documents)"),
    (
        "masked_contacts",
        masked_contacts,
        with_relations("roster") + f"SELECT row_idx, {_MASK(_LINE)} AS masked, {_MASK_MAIL(_LINE)} AS masked_mail, {_MASK_PHONE(_MASK_NPI(_LINE))} AS masked_numbers FROM roster_t",
    ),
    (
        "completion_scores",
        completion_scores,
        SCORES + 'SELECT completion_id, json_format, name, dates, line_of_business, phone, npi, full_score AS "full", total FROM st',
    ),
    (
        "advantages",
        advantages,
        SCORES
        + "SELECT completion_id, prompt_id, total, CASE WHEN coalesce(sd, 0) < 1e-9 THEN 0.0::DOUBLE ELSE round((total - m) / sd, 6) + 0.0 END AS advantage"
        " FROM (SELECT *, avg(total) OVER (PARTITION BY prompt_id) AS m, stddev_samp(total) OVER (PARTITION BY prompt_id) AS sd FROM st)",
    ),
    (
        "training_samples",
        training_samples,
        with_relations("roster")
        + f", f AS (SELECT row_idx, CASE WHEN row_idx % 2 = 0 THEN 'Ann \"Lee\"' ELSE {q.strip('provider_name')} END AS n, regexp_replace(line_of_business || ', PPO', ' ?(PPO|HMO)', '', 'g') AS l,"
        " CASE WHEN row_idx % 3 = 0 THEN tin END AS t, CASE WHEN row_idx % 2 = 0 THEN 'Hello' || chr(10) || tin ELSE 'Hello' || chr(10) || 'Subject: y' END AS b FROM roster_t)"
        f", a AS (SELECT *, '{{' || chr(10) || '    \"Provider Name\": ' || {_QUOTE('n')} || ',' || chr(10) || '    \"Line Of Business\": ' || {_QUOTE('l')} || ',' || chr(10)"
        f" || '    \"TIN\": ' || coalesce({_QUOTE('t')}, 'null') || chr(10) || '}}' AS j, 'SYSTEM</s>User: Read: ' || b || ' Done.</s>Assistant: ' AS p FROM f)"
        " SELECT row_idx, p || j || '</s>' AS text, p AS prompt, j || '</s>' AS answer FROM a",
    ),
    ("shuffled_samples", shuffled, "SELECT o_orderkey AS completion_id FROM orders"),
]


def _glue(sql: str) -> str:
    return sql.replace(") , ", "), ")


QUERIES = [(n, f, _glue(s)) for n, f, s in QUERIES]
