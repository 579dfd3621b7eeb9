"""Queries on the flow from mail bytes to versions, and on what is kept up to date
beside it: model calls, known keys, roll-ups, sketches, rule tables, CSV lines."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.functions import dates, text
from rosterloom.operators import classification, inference, known, normalize, responses, rollups, rules, scoring, tables, validate
from rosterloom.operators.mapping import answered_mapping
from rosterloom.operators.skew import explode_rows
from rosterloom.operators.tables import clean_header
from rosterloom.plans import twins as q
from rosterloom.plans.derive import read, relation, with_relations
from rosterloom.plans.process import RosterStore, resumed, run_batch
from rosterloom.plans.queries_extract import _CLEAN, _PROMPT, KINDS, prompts_of
from rosterloom.schema import FIELDS, column_name
from rosterloom.session import ensure_checkpoint_dir
from rosterloom.sources import delimited, mail, training
from rosterloom.streaming import state


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- model calls --------------------------------------------------------------------
def stand_in_model(prompts: list[str]) -> list[str]:
    """A fixed function in a model's place: an object made of the prompt's length.
    It fails on every seventh length."""
    sizes = [len(p) for p in prompts]
    if any(n % 7 == 0 for n in sizes):
        raise ValueError("prompt refused")
    return ["```json\n" + json.dumps([{"Provider Name": f"Size {n}", "TIN": str(n), "Provider NPI": "n/a"}]) + "\n```" for n in sizes]


def inferred_rows(spark, folder):
    """Typed rows of the answered pages, and the pages that got no answer."""
    asked = inference.infer(prompts_of(spark, folder), stand_in_model).drop("prompt")
    stored = _folder(spark, "answers")
    asked.write.parquet(stored)
    good, dead = inference.split_answers(spark.read.parquet(stored))
    none = F.lit(None).cast("string")
    rows = responses.clean_model_rows(good).select("page_id", "provider_name", "tin", "provider_npi", none.alias("error"))
    return rows.unionByName(dead.select("page_id", none.alias("provider_name"), none.alias("tin"), none.alias("provider_npi"), "error"))


_FULL_PROMPT = f"length('{responses.REQUEST[0]}' || p || '{responses.REQUEST[1]}')"
INFERRED = (
    f"WITH s AS (SELECT page_id, {_FULL_PROMPT} AS n FROM (SELECT page_id, {_PROMPT} AS p FROM pages))"
    " SELECT page_id, CASE WHEN n % 7 <> 0 THEN 'Size ' || n END AS provider_name, CASE WHEN n % 7 <> 0 THEN CAST(n AS VARCHAR) END AS tin,"
    " CAST(NULL AS VARCHAR) AS provider_npi, CASE WHEN n % 7 = 0 THEN 'ValueError: prompt refused' END AS error FROM s"
)


# --- known mails ----------------------------------------------------------------------
def indexed_mails(spark, folder):
    """Mails, one per order, that the whole customer history knows by id or hash,
    by way of a stored index of its keys."""
    stored = _folder(spark, "known")
    columns = ["message_id", "hash"]
    keys = known.key_rows(relation(spark, folder, "email"), columns, "id", parts=16)
    keys.write.partitionBy("part").parquet(f"{stored}/keys")
    history = spark.read.parquet(f"{stored}/keys")
    known.key_index(history).write.parquet(f"{stored}/index")
    mails = read(spark, folder, "orders").selectExpr(
        "o_orderkey AS id", "concat('<', CAST(o_orderkey AS STRING), '@mail.example>') AS message_id", "concat('h', CAST(o_custkey * 4 AS STRING)) AS hash"
    )
    return known.find_known(mails, "id", columns, history, spark.read.parquet(f"{stored}/index"), parts=16)


INDEXED = with_relations("email") + (
    ", i AS (SELECT message_id, min(id) AS a FROM email_t GROUP BY 1), h AS (SELECT hash, min(id) AS b FROM email_t GROUP BY 1)"
    " SELECT o_orderkey AS id, least(a, b) AS existing_id FROM orders LEFT JOIN i ON message_id = concat('<', CAST(o_orderkey AS STRING), '@mail.example>')"
    " LEFT JOIN h ON hash = concat('h', CAST(o_custkey * 4 AS STRING)) WHERE a IS NOT NULL OR b IS NOT NULL"
)


# --- roll-ups and sketches ---------------------------------------------------------------
_STATE_ORDER = ["batch", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]


def rolled_up_jobs(spark, folder):
    """Jobs per state and per supplier part after all batches of a log of line
    items, summed from the signed rows of each batch."""
    log = read(spark, folder, "lineitem").selectExpr(
        "l_orderkey AS job_id", "l_linenumber AS batch", "l_partkey", "l_returnflag", "l_linestatus", "l_suppkey"
    )
    measures = {"state": F.concat("l_returnflag", "l_linestatus"), "owner": (F.col("l_suppkey") % 50).cast("string")}
    return rollups.rolled_up(rollups.log_changes(log, "job_id", _STATE_ORDER, "batch", measures))


ROLLED_UP = (
    "WITH j AS (SELECT arg_max(l_returnflag || l_linestatus, t) AS s, arg_max(CAST(l_suppkey % 50 AS VARCHAR), t) AS o FROM (SELECT *, (l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS t FROM lineitem) GROUP BY l_orderkey)"
    " SELECT 'state' AS measure, s AS slot, count(*) AS n FROM j GROUP BY s UNION ALL SELECT 'owner', o, count(*) FROM j GROUP BY o"
)


def stage_percentiles(spark, folder):
    """Whether each stage's percentiles, merged from hourly sketches, lie within the
    sketch's rank bound of the exact ones."""
    events = relation(spark, folder, "stage_event").select("agent", "ts", "duration_s")
    found = rollups.latency_percentiles(rollups.latency_sketches(events))
    return rollups.within(rollups.rank_errors(events, found)).join(found.select("agent", "runs"), "agent")


# --- order, dates, rules, lines --------------------------------------------------------------
def shuffled_places(spark, folder):
    return scoring.shuffle_places(relation(spark, folder, "completion").select("completion_id"), ["completion_id"], seed=7)


def _written_dates() -> str:
    """The order date in one of many forms, by order key."""
    day, month, year = "CAST(day(o_orderdate) AS STRING)", "month(o_orderdate)", "CAST(year(o_orderdate) AS STRING)"
    names = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
    long = f"CASE {month} " + " ".join(f"WHEN {i + 1} THEN '{n}'" for i, n in enumerate(names)) + " END"
    short = f"substr({long}, 1, 3)"
    ending = "CASE WHEN day(o_orderdate) IN (1, 21, 31) THEN 'st' WHEN day(o_orderdate) IN (2, 22) THEN 'nd' WHEN day(o_orderdate) IN (3, 23) THEN 'rd' ELSE 'th' END"
    number = f"CAST({month} AS STRING)"
    forms = [
        f"concat('the ', {day}, {ending}, ' of ', {long}, ' ', {year})",
        f"concat('Mon, ', {day}, ' ', {short}, ' ', substr({year}, 3, 2))",
        f"concat({long}, ' ', {day}, {ending}, ', ', {year})",
        f"concat({day}, '-', {short}, '-', {year})",
        f"concat({year}, ' ', upper({long}), ' ', {day})",
        f"concat({number}, '/', {day}, '/', substr({year}, 3, 2))",
        f"concat('  ', {short}, '. ', {day}, ' ', {year}, ' ')",
        f"concat({day}, ' ', lower({long}), ' ', {year})",
        f"concat({long}, ' ', {year})",
        f"concat('13/', {day}, '/', {year})",
        "'next week'",
        f"concat({year}, '.', {number}, '.', {day})",
    ]
    return "CASE o_orderkey % 12 " + " ".join(f"WHEN {i} THEN {form}" for i, form in enumerate(forms)) + " END"


def free_dates(spark, folder):
    rows = read(spark, folder, "orders").selectExpr("o_orderkey AS row_idx", f"{_written_dates()} AS written")
    return rows.select("row_idx", "written", dates.normalize_free_date(F.col("written")).alias("date"))


def rule_matches(spark, folder):
    """Rules from every document, its third and fourth word, looked for in every
    document: the first rule by id that matches."""
    texts = read(spark, folder, "documents").select("doc_id", "text")
    word, gap = r"\p{Alnum}++", r"\P{Alnum}++"
    term = F.regexp_extract("text", rf"^\P{{Alnum}}*+(?:{word}{gap}){{2}}({word}(?:{gap}{word})?)", 1)
    table = texts.select(F.col("doc_id").alias("rule_order"), term.alias("term"), F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("value"))
    return rules.match_rules(texts, table, "doc_id", "text")


RULES = (
    "WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS ws FROM documents),"
    " r AS (SELECT doc_id AS rule, array_to_string(ws[3:4], ' ') AS term FROM w WHERE len(ws[3:4]) > 0),"
    " g AS (SELECT DISTINCT doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM w)"
    " SELECT doc_id, min(rule) AS rule_order, 'r' || CAST(min(rule) AS VARCHAR) AS value FROM g JOIN r USING (term) GROUP BY doc_id"
)


def csv_lines(spark, folder):
    """Documents as CSV files with quoted cells, read back: rows and refused lines."""
    quoted = "concat('\"', replace(coalesce(text, ''), '\"', '\"\"'), '\"')"
    extra = "CASE WHEN doc_id % 5 = 0 THEN ',\"one, more\"' ELSE '' END"
    line = f"concat('id,text\\n', CAST(doc_id AS STRING), ',', {quoted}, '\\r\\n\\n', CAST(doc_id AS STRING), ',NA', {extra})"
    files = read(spark, folder, "documents").selectExpr("doc_id", f"CAST({line} AS BINARY) AS content")
    rows = delimited.read_csv_attachments(files)
    cell = lambda name: F.try_element_at("data", F.lit(name))
    return rows.select("doc_id", "line_no", "row_idx", cell("id").alias("id"), F.sha2(cell("text"), 256).alias("text_hash"), "read_error")


CSV_LINES = (
    f"WITH m AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, 2 AS line_no, 0 AS row_idx, CAST(doc_id AS VARCHAR) AS id,"
    f" CASE WHEN t NOT IN ({', '.join(q.lit(w) for w in sorted(delimited.MISSING))}) THEN sha256(t) END AS text_hash, CAST(NULL AS VARCHAR) AS read_error FROM m"
    " UNION ALL SELECT doc_id, 4, 2, CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id AS VARCHAR) END, NULL,"
    " CASE WHEN doc_id % 5 = 0 THEN 'Line with 3 cells: ' || doc_id || ',NA,\"one, more\"' END FROM m"
)


# --- alarms ------------------------------------------------------------------------------
def silence_alarms(spark, folder):
    """Alarms of a stream over all events, drained once; those whose silence the
    watermark has passed."""
    events = relation(spark, folder, "stage_event").select("ts", "job_id", "status")
    stored = _folder(spark, "alarms")
    events.write.parquet(f"{stored}/in")
    alarms = state.silence_alarms(spark.readStream.schema(events.schema).parquet(f"{stored}/in"), 240)
    sink = alarms.writeStream.format("parquet").option("path", f"{stored}/out").option("checkpointLocation", f"{stored}/checkpoint")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(state.ALARM).parquet(f"{stored}/out")
    micros = lambda c: F.unix_micros(c).alias(c)
    return found.select("job_id", "kind", micros("active_from"), micros("silent_since"), "status", "events")


ALARMS = (
    with_relations("stage_event")
    + ", g AS (SELECT *, coalesce(ts > lag(ts) OVER (PARTITION BY job_id ORDER BY ts) + INTERVAL 4 HOUR, true) AS fresh FROM stage_event_t)"
    ", n AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY job_id ORDER BY ts) AS s FROM g)"
    ", z AS (SELECT job_id, min(ts) AS a, max(ts) AS b, arg_max(status, (ts, status)) AS status, count(*) AS events FROM n GROUP BY job_id, s)"
    " SELECT job_id, 'alarm' AS kind, epoch_us(a) AS active_from, epoch_us(b) AS silent_since, status, events FROM z WHERE status NOT IN ('success', 'error')"
    " AND b + INTERVAL 4 HOUR <= (SELECT max(ts) FROM stage_event_t) - INTERVAL 10 MINUTE"
)


# --- the flow from bytes to versions ---------------------------------------------------------
_C = "CAST(c_custkey AS STRING)"
_BODY = (
    "concat('<html><table><tr><th>Provider Name</th><th>NPI</th><th>Term Date</th></tr>',"
    f" '<tr><td>Ann Lee</td><td>', lpad({_C}, 10, '1'), '</td><td>08/01/2025</td></tr>',"
    " CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '<tr><td>Bob Ray</td><td>1234567893</td><td></td></tr>' END,"
    f" CASE WHEN c_custkey % 6 = 0 THEN '<tr><td></td><td>12345</td><td>soon</td></tr>' ELSE '' END, '</table></html>')"
)
_MAILS = {
    "path": f"concat('/in/', {_C}, CASE WHEN c_custkey % 50 = 7 THEN '.msg' ELSE '.eml' END)",
    "message_id": "CASE WHEN c_custkey % 41 <> 5 THEN concat('<', CAST(c_custkey - c_custkey % 3 AS STRING), '@x.example>') END",
    "sender": "CASE WHEN c_custkey % 43 <> 6 THEN concat('s', CAST(c_nationkey AS STRING), '@x.example') END",
    "body": _BODY,
}
#: Mails that one task parses.
MAIL_ROWS = 10_000
_STORES: dict[tuple[str, str], str] = {}


def mail_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """One mail file per customer, as the file source would list it."""
    mails = read(spark, folder, "customer", MAIL_ROWS).selectExpr("c_custkey", *[f"{e} AS {c}" for c, e in _MAILS.items()])
    header = lambda name, value: F.when(F.col(value).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(value), F.lit("\n"))).otherwise("")
    content = F.concat(
        header("Message-ID", "message_id"), header("From", "sender"), F.lit("To: in@x.example\nSubject: Roster\nMIME-Version: 1.0\n"),
        F.lit("Content-Type: text/html; charset=utf-8\n\n"), "body", F.lit("\n"),
    )
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("c_custkey") * 60)
    rows = mails.select("path", at.alias("modificationTime"), F.encode(content, "utf-8").alias("content"))
    return rows.select("path", "modificationTime", F.length("content").cast("bigint").alias("length"), "content")


def flow_store(spark: SparkSession, folder: str) -> RosterStore:
    """The store after one batch with all mails, made once per session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STORES:
        store = RosterStore(spark, _folder(spark, "flow"))
        run_batch(store, "all", mail_bytes(spark, folder), "2025-06-01")
        _STORES[key] = store.path
    return RosterStore(spark, _STORES[key])


def _named(store: RosterStore, table: str) -> DataFrame:
    return store.read(table).join(store.read("emails").select("job_id", "message_id"), "job_id")


def flow_rows(spark, folder):
    found = _named(flow_store(spark, folder), "records")
    return found.select("message_id", "row_idx", "provider_name", "provider_npi", "term_date", "is_valid")


def flow_jobs(spark, folder):
    """Every job with its state and the number of accepted mails of its id."""
    store = flow_store(spark, folder)
    taken = mail.split_parsed(store.read("parsed"))[0].groupBy("message_id").agg(F.count(F.lit(1)).alias("mails"))
    rows = store.read("records").groupBy("job_id").agg(F.count(F.lit(1)).alias("total_rows"))
    named = store.read("emails").select("job_id", "message_id", "from_addr", F.col("raw_uri").alias("path"))
    jobs = store.jobs().select("job_id", "status", "version_no").join(named, "job_id").join(rows, "job_id", "left")
    return jobs.join(taken, "message_id").select(
        "message_id", "from_addr", "path", "status", "version_no", F.coalesce("total_rows", F.lit(0)).alias("total_rows"), "mails"
    )


def flow_rejections(spark, folder):
    return flow_store(spark, folder).read("rejections").select("path", "reason")


def flow_issues(spark, folder):
    found = _named(flow_store(spark, folder), "issues")
    return found.select("message_id", "row_idx", "field", "level", "message")


def flow_deltas(spark, folder):
    """Changes of the flow with the header each field came from."""
    found = _named(flow_store(spark, folder), "deltas")
    return found.select(
        "message_id", "row_idx", "field", "change_type", "mapped", "source_header", F.round("mapping_confidence", 6).alias("mapping_confidence")
    )


def flow_routes(spark, folder):
    found = _named(flow_store(spark, folder), "routes")
    return found.select("message_id", "needs_assistance", "total_rows", "after_extraction", "after_validation")


def resumed_issues(spark, folder):
    """The flow's rows validated anew under the published identifier prefix."""
    store = flow_store(spark, folder)
    rows = resumed(store.current_records(), "2025-06-01", prefix="80840")
    found = validate.issue_table(rows, ["job_id", "row_idx"]).join(store.read("emails").select("job_id", "message_id"), "job_id")
    return found.where("field = 'Provider NPI'").select("message_id", "row_idx", "level", "message")


# --- mapping answers, outcomes, parameters, wide rows, files --------------------------------
def mapping_answers(spark, folder):
    headers = relation(spark, folder, "header")
    name = clean_header(F.col("header"))
    given = F.concat(F.lit('Sure: {"mappings": [{"source": "x", "target": "TIN", "confidence": 0.'), (F.col("header_id") % 9 + 1).cast("string"), F.lit("}]} ok"))
    kind = F.col("header_id") % 4
    answer = F.when(kind == 0, given).when(kind == 1, "no object").when(kind == 2, '{"mappings": [').otherwise('{"other": 1}')
    answer = F.when(kind == 2, F.concat(answer, F.lit("}"))).otherwise(answer)
    rows = headers.select("header_id", answered_mapping(answer, F.array(name)).alias("m"))
    return explode_rows(rows, "m", "e", "pos").select("header_id", "pos", "e.source", "e.target", F.col("e.confidence").alias("confidence"))


def normalization_outcomes(spark, folder):
    rows = relation(spark, folder, "roster")
    data = F.when(F.col("row_idx") % 9 == 0, F.lit(None)).when(F.col("row_idx") % 9 == 1, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("TIN"), F.col("tin")))
    flagged = normalize.normalized_flag(rows.select("job_id", data.alias("data")))
    return normalize.normalization_outcome(flagged, ["job_id"])


def mail_parameters(spark, folder):
    kinds = classification.classify_attachments(relation(spark, folder, "attachment"))
    found = classification.processing_parameters(kinds, ["mail_id"], "attachment_id")
    return found.withColumn("document_types", F.array_join("document_types", ","))


_WIDE = ["name", "npi", "spec", "kind", "eff", "term", "license", "org", "tin", "address"]
_WIDE_SQL = {
    "name": "concat('N', CAST(o_orderkey AS STRING))", "npi": "CASE WHEN o_orderkey % 2 = 0 THEN lpad(CAST(o_orderkey AS STRING), 10, '1') ELSE 'Surgery' END",
    "spec": "CASE WHEN o_orderkey % 2 = 0 THEN 'Surgery' ELSE lpad(CAST(o_orderkey AS STRING), 10, '1') END", "kind": "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Add' END",
    "eff": "CAST(o_orderdate AS STRING)", "term": "'none'", "license": "concat('A', CAST(o_custkey AS STRING))", "org": "concat('G', CAST(o_custkey AS STRING))",
    "tin": "'82-1'", "address": "o_orderpriority",
}
_WIDTH = "CASE o_orderkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 6 WHEN 3 THEN 8 ELSE 10 END"


def wide_rows(spark, folder):
    """Fields by position of rows with two to ten cells."""
    orders = read(spark, folder, "orders").selectExpr("o_orderkey AS row_idx", f"slice(array({', '.join(_WIDE_SQL[c] for c in _WIDE)}), 1, {_WIDTH}) AS cells")
    found = explode_rows(orders.select("row_idx", tables.positional_fields(F.col("cells")).alias("_f")), "_f", "f")
    return found.select("row_idx", F.col("f.key").alias("field"), F.col("f.value").alias("value"))


def _wide_sql() -> str:
    base = f"(SELECT o_orderkey AS row_idx, {_WIDTH} AS w, {', '.join(f'{e} AS {c}' for c, e in _WIDE_SQL.items())} FROM orders)"
    npi = "lpad(CAST(row_idx AS VARCHAR), 10, '1')"
    fields = [
        (3, "Provider Name", "name"), (3, "Provider NPI", f"CASE WHEN length({npi}) = 10 THEN {npi} ELSE '' END"), (3, "Provider Specialty", "'Surgery'"),
        (6, "Transaction Type", "CASE WHEN kind = '' THEN 'Update' ELSE kind END"), (6, "Effective Date", "eff"), (6, "Term Date", "term"),
        (8, "State License", "license"), (8, "Organization Name", "org"), (10, "TIN", "tin"), (10, "Complete Address", "address"),
    ]
    return " UNION ALL ".join(f"SELECT row_idx, '{f}' AS field, {e} AS value FROM {base} WHERE w >= {n}" for n, f, e in fields)


def object_keys(spark, folder):
    files = relation(spark, folder, "attachment").join(
        read(spark, folder, "orders").select(F.col("o_orderkey").alias("mail_id"), F.col("o_orderdate").alias("at")), "mail_id"
    )
    return files.select("attachment_id", text.object_key("mails", F.col("filename"), F.col("at")).alias("object_key"))


def training_round_trip(spark, folder):
    """Samples written as JSON lines and read back as training files are."""
    rows = relation(spark, folder, "roster").select(
        F.concat(F.lit("Dear \"all\",\n"), "provider_name", F.lit("\t"), "tin").alias("email"),
        F.create_map(F.lit("TIN"), F.col("tin"), F.lit("Reason"), F.col("term_reason")).alias("extracted_data"),
    )
    stored = _folder(spark, "training")
    training.write_results(rows, f"{stored}/lines")
    back = spark.read.schema("email string, extracted_data map<string,string>").json(f"{stored}/lines")
    # One array of samples per file, as the readers of training data expect.
    whole = back.groupBy(F.pmod(F.xxhash64("email"), F.lit(8)).alias("_file")).agg(
        F.to_json(F.collect_list(F.struct(F.col("email").alias("email_body"), F.col("extracted_data").alias("extracted_fields")))).alias("value")
    )
    whole.select("value").repartition(4).write.option("maxRecordsPerFile", 1).text(f"{stored}/arrays")
    training.read_training_json(spark, f"{stored}/arrays").write.parquet(f"{stored}/samples")
    samples = spark.read.schema(training.SAMPLE_SCHEMA).parquet(f"{stored}/samples")
    cell = lambda name: F.try_element_at("extracted_fields", F.lit(name))
    return samples.select(F.sha2("email_body", 256).alias("email_hash"), cell("TIN").alias("tin"), cell("Reason").alias("reason"))


_BAD = "CASE WHEN c_custkey % 50 = 7 THEN 'File must be an EML file' WHEN c_custkey % 41 = 5 THEN 'Missing Message-ID header' WHEN c_custkey % 43 = 6 THEN 'Missing From header' END"
FLOW = (
    f"WITH m AS (SELECT c_custkey, {_MAILS['path']} AS path, {_MAILS['message_id']} AS message_id, {_MAILS['sender']} AS from_addr, {_BAD} AS reason FROM customer)"
    ", j AS (SELECT message_id, arg_min(path, (c_custkey, path)) AS path, arg_min(from_addr, (c_custkey, path)) AS from_addr, min(c_custkey) AS k, count(*) AS mails"
    " FROM m WHERE reason IS NULL GROUP BY message_id)"
    f", a AS (SELECT message_id, 0 AS o, 'Ann Lee' AS name, lpad(CAST(k AS VARCHAR), 10, '1') AS npi, '08/01/2025' AS term FROM j"
    " UNION ALL SELECT message_id, 1, 'Bob Ray', '1234567893', 'Information not found' FROM j WHERE k % 4 <> 0"
    " UNION ALL SELECT message_id, 2, '', '12345', 'soon' FROM j WHERE k % 6 = 0)"
    ", r AS (SELECT message_id, row_number() OVER (PARTITION BY message_id ORDER BY o) - 1 AS row_idx, name, npi, term FROM a)"
    ", i AS (SELECT message_id, row_idx, 'Provider Name' AS field, 'error' AS level, 'Required field ''Provider Name'' is missing or empty' AS message FROM r WHERE name = ''"
    " UNION ALL SELECT message_id, row_idx, 'Provider NPI', 'error', 'Invalid NPI format: ' || npi || ' (must be 10 digits)' FROM r WHERE NOT regexp_full_match(npi, '[0-9]{10}')"
    f" UNION ALL SELECT message_id, row_idx, 'Provider NPI', 'warning', 'NPI checksum validation failed: ' || npi FROM r WHERE regexp_full_match(npi, '[0-9]{{10}}') AND NOT {q.luhn('npi')}"
    # Fields that no mail has: every row carries the sentinel, which is no address, no date and no number.
    " UNION ALL SELECT message_id, row_idx, f, 'warning', m || 'Information not found' FROM r, (VALUES ('Complete Address', 'Address may have low confidence: '),"
    " ('Term Date', 'Could not validate date range: Unknown string format: '), ('Phone Number', 'Invalid phone format: ')) v(f, m)) "
)

QUERIES = [
    ("inferred_rows", inferred_rows, INFERRED),
    ("indexed_mails", indexed_mails, INDEXED),
    ("rolled_up_jobs", rolled_up_jobs, ROLLED_UP),
    ("stage_percentiles", stage_percentiles, with_relations("stage_event") + "SELECT agent, true AS within_bound, count(duration_s) AS runs FROM stage_event_t GROUP BY agent"),
    (
        "shuffled_places",
        shuffled_places,
        with_relations("completion")
        + "SELECT completion_id, row_number() OVER (ORDER BY sha256('7|' || CAST(completion_id AS VARCHAR)), completion_id) - 1 AS place FROM completion_t",
    ),
    (
        "free_dates",
        free_dates,
        f"SELECT row_idx, written, CASE WHEN row_idx % 12 IN (8, 9, 10) THEN written ELSE strftime(o_orderdate, '%m/%d/%Y') END AS date"
        f" FROM (SELECT o_orderkey AS row_idx, o_orderdate, {_written_dates()} AS written FROM orders)",
    ),
    ("rule_matches", rule_matches, RULES),
    ("csv_lines", csv_lines, CSV_LINES),
    ("silence_alarms", silence_alarms, ALARMS),
    ("flow_rows", flow_rows, FLOW + "SELECT message_id, row_idx, name AS provider_name, npi AS provider_npi, term AS term_date,"
     " NOT EXISTS (SELECT 1 FROM i WHERE i.message_id = r.message_id AND i.row_idx = r.row_idx AND level = 'error') AS is_valid FROM r"),
    ("flow_jobs", flow_jobs, FLOW + "SELECT message_id, from_addr, path, CASE WHEN EXISTS (SELECT 1 FROM i WHERE i.message_id = j.message_id AND level = 'error') THEN 'needs_review'"
     " ELSE 'ready' END AS status, 1 AS version_no, (SELECT count(*) FROM r WHERE r.message_id = j.message_id) AS total_rows, mails FROM j"),
    ("flow_rejections", flow_rejections, FLOW + "SELECT path, reason FROM m WHERE reason IS NOT NULL"),
    ("flow_issues", flow_issues, FLOW + "SELECT * FROM i"),
    (
        "flow_deltas",
        flow_deltas,
        # A failed date or identifier is always told; both come from mapped headers.
        FLOW + ", d AS (SELECT message_id, row_idx, 'Term Date' AS field, 'parsing_failed' AS change_type, 'Term Date' AS header FROM r WHERE term = 'soon'"
        f" UNION ALL SELECT message_id, row_idx, 'Provider NPI', 'normalized', 'Provider NPI' FROM r WHERE NOT {q.luhn('npi')})"
        " SELECT message_id, row_idx, field, change_type, true AS mapped, header AS source_header, 1.0::DOUBLE AS mapping_confidence FROM d",
    ),
    (
        "flow_routes",
        flow_routes,
        FLOW + "SELECT message_id, false AS needs_assistance, (SELECT count(*) FROM r WHERE r.message_id = j.message_id) AS total_rows, 'normalize' AS after_extraction,"
        " CASE WHEN EXISTS (SELECT 1 FROM i WHERE i.message_id = j.message_id AND level = 'error') THEN 'review' ELSE 'version' END AS after_validation FROM j",
    ),
    (
        "resumed_issues",
        resumed_issues,
        FLOW + "SELECT message_id, row_idx, 'error' AS level, 'Invalid NPI format: ' || npi || ' (must be 10 digits)' AS message FROM r WHERE NOT regexp_full_match(npi, '[0-9]{10}')"
        f" UNION ALL SELECT message_id, row_idx, 'warning', 'NPI checksum validation failed: ' || npi FROM r WHERE regexp_full_match(npi, '[0-9]{{10}}') AND NOT {q.luhn('npi', '80840')}",
    ),
    (
        "mapping_answers",
        mapping_answers,
        with_relations("header")
        + f", h AS (SELECT header_id, {_CLEAN('header')} AS n FROM header_t), t AS (SELECT * FROM (VALUES "
        + ", ".join(f"({i}, {q.lit(f)})" for i, f in enumerate(FIELDS))
        + ") v(i, target))"
        " SELECT header_id, 0 AS pos, 'x' AS source, 'TIN' AS target, (header_id % 9 + 1) / 10.0::DOUBLE AS confidence FROM h WHERE header_id % 4 = 0"
        " UNION ALL SELECT header_id, row_number() OVER (PARTITION BY header_id ORDER BY i) - 1, n, target, 0.8::DOUBLE FROM h, t"
        " WHERE header_id % 4 = 1 AND (contains(lower(target), lower(n)) OR contains(lower(n), lower(target)))",
    ),
    (
        "normalization_outcomes",
        normalization_outcomes,
        with_relations("roster")
        + "SELECT job_id, count(*) AS total_rows, count(*) FILTER (row_idx % 9 > 1) AS successful_normalizations, count(*) FILTER (row_idx % 9 <= 1) AS failed_normalizations,"
        " 'Data normalization completed: ' || count(*) FILTER (row_idx % 9 > 1) || '/' || count(*) || ' rows normalized' AS note FROM roster_t GROUP BY job_id",
    ),
    (
        "mail_parameters",
        mail_parameters,
        with_relations("attachment")
        + "SELECT mail_id, string_agg(document_type, ',' ORDER BY attachment_id) AS document_types, CAST(count(*) AS INT) AS artifact_count, 10 AS max_pages, 0.7::DOUBLE AS confidence_threshold"
        f" FROM ({KINDS}) GROUP BY mail_id",
    ),
    ("wide_rows", wide_rows, _wide_sql()),
    (
        "object_keys",
        object_keys,
        with_relations("attachment")
        + "SELECT attachment_id, 'mails/' || strftime(o_orderdate, '%Y/%m/%d/%H%M%S') || '/' || filename AS object_key FROM attachment_t JOIN orders ON o_orderkey = mail_id",
    ),
    (
        "training_round_trip",
        training_round_trip,
        with_relations("roster")
        + "SELECT sha256(concat('Dear \"all\",' || chr(10), provider_name, chr(9), tin)) AS email_hash, tin, term_reason AS reason FROM roster_t",
    ),
]
