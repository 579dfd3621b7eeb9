"""Mail files through to stored versions."""

import io
import zipfile
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from rosterloom.operators.versions import diff
from rosterloom.plans import process
from rosterloom.plans.process import RosterStore, revalidate, run_batch
from rosterloom.schema import FIELD_COLUMNS, column_name
from rosterloom.sources import mail
from rosterloom.sources.delimited import read_csv_attachments
from rosterloom.sources.spreadsheets import read_workbook, workbook_rows, write_workbook

TABLE = """<html><table><tr><td>Provider Name:</td><td>NPI#:</td><td>Term Date:</td><td>Reason</td></tr>
<tr><td>dr. ann o'lee</td><td>123-456-7897</td><td>8/1/2025</td><td>retired</td></tr>
<tr><td>bob ray</td><td>1234567897</td><td>8/2/2025</td><td></td></tr></table></html>"""


def message(message_id="<1@x>", sender="a@x.org", text="Hello,\nEffective 09/22/2025, Paul Stone, MD will move.\nNPI: 9876543217\n", html=None, files=()):
    out = EmailMessage()
    if message_id:
        out["Message-ID"] = message_id
    if sender:
        out["From"] = sender
    out["To"], out["Subject"] = "b@y.org", "Roster"
    out.set_content(text)
    if html:
        out.add_alternative(html, subtype="html")
    for name, kind, data in files:
        main, sub = kind.split("/")
        out.add_attachment(data, maintype=main, subtype=sub, filename=name)
    return out.as_bytes()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("mail")
    book = write_workbook({"Empty": [["only"]], "Data": [["NPI", "Name", "NPI"], ["0123456789", "Ann", "x"], ["2", "", "y"]]})
    csv = "Provider Name,NPI,Phone\nJosé Ruiz,0123456789,555-223-4567\nNA,,\nZoe Ray,9876543217,5552234567\n".encode("latin-1")
    files = {
        "a.eml": message("<a@x>", html=TABLE),
        "a_again.eml": message("<a@x>", html=TABLE),
        "b.EML": message("<b@x>", files=[("r.csv", "text/csv", csv), ("r.xlsx", "application/octet-stream", book), ("e.txt", "text/plain", b"")]),
        "c.eml": message("<c@x>", text="Name | NPI\nAnn Lee | 1234567897\nBob | 2 | extra\n"),
        "noid.eml": message(None),
        "nofrom.eml": message("<d@x>", sender=None),
        "empty.eml": b"",
        "note.txt": b"not a mail",
        "broken.eml": b"\xff\xfe\x00 no headers",
    }
    for name, content in files.items():
        (root / name).write_bytes(content)
    return str(root)


def test_intake_checks(spark, folder):
    files = mail.mail_files(spark, folder)
    refused = {r.path.rsplit("/", 1)[1]: r.reason for r in mail.rejected_files(files).collect()}
    # The file source itself passes over empty files; the rule stays for other frames.
    assert refused == {"note.txt": "File must be an EML file"}
    listed = spark.createDataFrame([("a.eml", 0), ("b.eml", 99_000_000), ("c.eml", 5)], "path string, length long")
    assert [r.reason for r in mail.rejected_files(listed).orderBy("path").collect()] == [
        "Empty file", "File too large. Maximum size: 50MB",
    ]
    assert mail.accepted_files(files, max_megabytes=0).count() == 0
    taken, bad = mail.split_parsed(mail.parse_eml(mail.accepted_files(files)))
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in bad.collect()} == {
        "noid.eml": "Missing Message-ID header",
        "nofrom.eml": "Missing From header",
        "broken.eml": "Missing Message-ID header",
    }
    assert {r.message_id for r in taken.collect()} == {"<a@x>", "<b@x>", "<c@x>"}


def test_bodies_and_attachments(spark, folder):
    parsed = mail.parse_eml(mail.accepted_files(mail.mail_files(spark, folder)))
    row = parsed.where("message_id = '<a@x>'").first()
    assert row.text.startswith("Hello,") and "<table>" in row.html and row.subject == "Roster" and row.to_addr == "b@y.org"
    parts = mail.explode_attachments(parsed).orderBy("attachment_idx").collect()
    assert [p.filename for p in parts] == ["r.csv", "r.xlsx"]
    assert all(p.size == len(p.content) and len(p.checksum) == 64 for p in parts)


@pytest.fixture(scope="module")
def csv_rows(spark):
    """Rows of one CSV file in their order; what is refused goes to ``errors``."""

    def read(content, errors=None):
        found = read_csv_attachments(spark.createDataFrame([(bytearray(content),)], "content binary")).collect()
        if errors is not None:
            errors += [r.read_error for r in found if r.read_error]
        return [(r.row_idx, r.data, r.sheet) for r in sorted(found, key=lambda r: r.row_idx) if not r.read_error]

    return read


def test_csv_reader(csv_rows):
    rows = list(csv_rows("A,B\n01,é\n,\n2,NA\n".encode("latin-1")))
    assert rows == [(0, {"A": "01", "B": "é"}, None), (2, {"A": "2"}, None)]
    assert list(csv_rows(b"")) == []


@pytest.mark.parametrize("before", [10, 12_000, 50_000])
def test_csv_reader_keeps_all_good_rows(before, csv_rows):
    errors = []
    lines = [f"{i},x" for i in range(before)] + ["1,2,3"] + ["7,y"] * 500
    rows = list(csv_rows("\n".join(["A,B", *lines]).encode(), errors))
    assert len(rows) == before + 500 and errors == ["Line with 3 cells: 1,2,3"]


def test_workbook_round_trip():
    book = write_workbook({"One": [["h"], ["x"]], "Two": [["A", "A", ""], ["01", " <&> ", "z"], ["", "b", ""]]})
    assert [name for name, _ in read_workbook(book)] == ["One", "Two"]
    assert list(workbook_rows(book)) == [(0, {"h": "x"}, "One")]
    assert list(workbook_rows(book, min_data_rows=2)) == [
        (0, {"A": "01", "A.1": " <&> ", "Unnamed: 2": "z"}, "Two"),
        (1, {"A.1": "b"}, "Two"),
    ]
    assert list(workbook_rows(b"no zip")) == []
    assert book == write_workbook({"One": [["h"], ["x"]], "Two": [["A", "A", ""], ["01", " <&> ", "z"], ["", "b", ""]]})


def test_workbook_with_shared_strings_numbers_and_dates():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "xl/workbook.xml": f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {ns}><si><t>NPI</t></si><si><r><t>Da</t></r><r><t>te</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/s.xml": f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
        '<row r="2"><c r="A2"><v>1234567893</v></c><c r="C2" s="1"><v>45000</v></c></row><row r="4"><c r="A4"><v>1.5</v></c></row></sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, text in parts.items():
            archive.writestr(name, text)
    rows = list(workbook_rows(out.getvalue()))
    assert rows[0] == (0, {"NPI": "1234567893", "Date": "2023-03-15 00:00:00"}, "S")
    assert rows[1] == (2, {"NPI": "1.5"}, "S")


def test_store_round(spark, folder, tmp_path):
    store = RosterStore(spark, str(tmp_path / "store"))
    files = mail.mail_files(spark, folder)
    for _ in range(2):  # the same batch again changes nothing
        run_batch(store, "b1", files, "2025-06-01")
    assert store.read("emails").count() == 3
    jobs = {r.job_id: r for r in store.jobs().collect()}
    assert len(jobs) == 3 and {r.version_no for r in jobs.values()} == {1}
    names = {r.message_id: r.job_id for r in store.read("emails").collect()}
    table = store.read("records").where(F.col("job_id") == names["<a@x>"]).orderBy("row_idx").collect()
    assert [(r.provider_name, r.provider_npi, r.term_date) for r in table] == [
        ("Dr. Ann O'Lee", "1234567897", "08/01/2025"), ("Bob Ray", "1234567897", "08/02/2025"),
    ]
    messages = {r.message for r in store.read("issues").where(F.col("job_id") == names["<a@x>"]).collect()}
    assert "Duplicate NPI found: 1234567897" in messages
    mixed = store.read("records").where(F.col("job_id") == names["<b@x>"]).orderBy("row_idx").collect()
    assert [r.row_idx for r in mixed] == list(range(5))
    assert [r.provider_npi for r in mixed] == ["9876543217", "0123456789", "9876543217", "0123456789", "2"]
    assert store.read("records").where(F.col("job_id") == names["<c@x>"]).count() == 2

    # A later batch with a known mail takes nothing in.
    run_batch(store, "b2", files, "2025-06-01")
    assert store.read("emails").count() == 3 and store.read("versions").count() == 3

    # An edit makes a second version; its difference is the edited cell.
    current = store.batch("records", "b1").where(F.col("job_id") == names["<a@x>"])
    edited = current.withColumn("term_reason", F.when(F.col("row_idx") == 1, "Moved").otherwise(F.col("term_reason")))
    revalidate(store, "e1", edited, "2025-06-01", "user", "Edit", F.lit("2025-06-02").cast("timestamp"))
    newest = store.jobs().where(F.col("job_id") == names["<a@x>"]).first()
    assert newest.version_no == 2 and newest.current_version_id.endswith(".2")
    parent = store.batch("versions", "e1").first()
    assert parent.parent_version_id.endswith(".1")
    changes = diff(current, store.batch("records", "e1"), ["row_idx"], FIELD_COLUMNS).collect()
    assert [(r.row_idx, r.field, r.new_value) for r in changes] == [(1, column_name("Term Reason"), "Moved")]


def test_flow_loses_nothing(spark, tmp_path):
    """Mapped headers, bad lines, mails without rows, refused files, and a batch
    name with leading zeros that is run twice."""
    from email.message import EmailMessage

    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for name, csv_text in (("a", "NPI,Phone,Specialty\n1234567893,2005550000,Surgery\n1,2,3,4\n9876543213,,\n"), ("b", None)):
        message = EmailMessage()
        message["Message-ID"], message["From"], message["To"], message["Subject"] = f"<{name}@x>", "f@x.org", "t@x.org", "S"
        message.set_content("Hi" if csv_text else "")
        if csv_text:
            message.add_attachment(csv_text.encode(), maintype="text", subtype="csv", filename="r.csv")
        (inbox / f"{name}.eml").write_bytes(message.as_bytes())
    (inbox / "c.pdf").write_bytes(b"x")
    store = RosterStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        run_batch(store, "007", mail.mail_files(spark, str(inbox)), "2025-06-01")
    assert store.read("emails").count() == 2 and store.jobs().count() == 2
    assert {r.path.rsplit("/", 1)[1] for r in store.read("rejections").collect()} == {"c.pdf"}
    assert [r.reason for r in store.read("artifact_rejections").collect()] == ["Line with 4 cells: 1,2,3,4"]
    rows = {r.provider_npi: r for r in store.read("records").collect()}
    assert rows["1234567893"].phone_number and rows["1234567893"].provider_specialty == "Surgery" and "9876543213" in rows
    assert "pending" in {r.status for r in store.jobs().collect()}


def test_store_life_cycle(spark, folder, tmp_path):
    """Edit, roll back, edit again, export, fail, expire and copy."""
    store = RosterStore(spark, str(tmp_path / "store"))
    run_batch(store, "b1", mail.mail_files(spark, folder), "2025-06-01")
    at = lambda day: F.lit(f"2025-06-{day:02d}").cast("timestamp")
    job = {r.message_id: r.job_id for r in store.read("emails").collect()}["<a@x>"]
    state = lambda: store.jobs().where(F.col("job_id") == job).first()
    edits = spark.createDataFrame(
        [(job, 1, "Term Reason", "Gone", 1), (job, 1, "Term Reason", "Moved", 2), (job, 99, "TIN", "x", 3)],
        "job_id string, row_idx long, field string, value string, seq long",
    )
    process.edit_cells(store, "e1", edits, "2025-06-02", at(2))
    assert state().current_version_id == f"{job}.2" and store.read("versions").count() == 4
    assert [(r.row_idx, r.value) for r in store.read("edit_rejections").collect()] == [(99, "x")]
    changes = process.version_diff(store, f"{job}.1", f"{job}.2").collect()
    assert [(r.row_idx, r.field, r.new_value) for r in changes] == [(1, "term_reason", "Moved")]
    requests = spark.createDataFrame([(job, f"{job}.1", 1), ("none", "none.1", 1)], "job_id string, version_id string, seq long")
    for _ in range(2):
        process.roll_back(store, "r1", requests, at(3))
    assert (state().current_version_id, state().version_no) == (f"{job}.1", 1)
    told = store.batch("audit_logs", "r1").collect()
    assert [r.before_json for r in told] == [f'{{"current_version_id":"{job}.2"}}']
    process.edit_cells(store, "e2", edits.where("seq = 1"), "2025-06-04", at(4))
    newest = store.batch("versions", "e2").first()
    assert (newest.version_no, newest.parent_version_id) == (3, f"{job}.1") and state().current_version_id == f"{job}.3"

    process.export_jobs(store, "x1", at(5), statuses=("ready", "needs_review"))
    log = {r.job_id: r for r in store.read("exports").collect()}
    assert log[job].version_id == f"{job}.3" and log[job].file_size > 0 and state().status == "exported"
    process.fail_stuck(store, "s1", at(6))
    assert {r.status for r in store.jobs().collect()} <= {"exported", "failed"}
    before = store.jobs().count()
    process.roll_back(store, "r2", requests.where("false"), at(7))
    assert store.jobs().count() == before

    old = store.jobs().where("job_id <> '" + job + "'").withColumn("status", F.lit("ready"))
    store.log_jobs("z1", old)
    process.expire(store, "d1", F.lit("2025-09-01").cast("timestamp"))
    copy = RosterStore(spark, str(tmp_path / "copy"))
    process.copy_live(store, copy, "c1")
    assert {r.job_id for r in copy.jobs().collect()} == {job} and copy.read("versions").count() == 3
