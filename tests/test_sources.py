import base64
import json

import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from worksignal import schemas
from worksignal.functions.dates import sort_day
from worksignal.sources import calendar, citable, inbox, notes, records, tasks, tenants


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8", newline="")


@pytest.fixture
def data(tmp_path):
    coded = base64.b64encode("Grüße\nline\n\nCheers,\nAda".encode()).decode()
    write(tmp_path / "inbox/1.eml", f"Subject: Re: Plan\nFrom: Ada <ada@x.org>\nTo: b@x.org\nDate: Mon, 06 May 2024 23:30:00 -0700\n"
          f"Message-ID: <1@x>\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n{coded}\n")
    write(tmp_path / "inbox/2.eml", "Subject: Odd\nFrom: x\nDate: not a date at all\n\nbody\n")
    write(tmp_path / "inbox/3.eml", "Subject: Multi\nFrom: y@x.org\nDate: Tue, 07 May 2024 01:00:00 +0000\nMIME-Version: 1.0\n"
          "Content-Type: multipart/alternative; boundary=B\n\n--B\nContent-Type: text/html\n\n<p>no</p>\n--B\n"
          "Content-Type: text/plain\n\nplain part\n--B--\n")
    (tmp_path / "inbox/4.eml").write_bytes(b"Subject: \xff\xfe\n\nx")
    write(tmp_path / "inbox/skip.txt", "no mail")
    write(tmp_path / "tenants/acme/inbox/1.eml", "Subject: Own\nFrom: z@x.org\nDate: Tue, 07 May 2024 01:00:00 +0000\n\nhi\n")
    write(tmp_path / "calendar/calendar.ics", "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:a\r\nDTSTART:20240506T090000Z\r\nDTEND:20240506T100000\r\n"
          "SUMMARY:Board \r\n  prep\r\nDESCRIPTION:one\\ntwo\\, three\r\nATTENDEE;CN=Ada;PARTSTAT=ACCEPTED:mailto:ada@x.org\r\nEND:VEVENT\r\n"
          "BEGIN:VEVENT\r\nUID:b\r\nDTSTART;VALUE=DATE:20240507\r\nSTATUS:CANCELLED\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n")
    write(tmp_path / "notes/2024-05-06-week.md", "intro\n# Week\n- [ ] call Bo\n  - [X] done it\n* [ ] no\n")
    write(tmp_path / "notes/loose.md", "nothing")
    write(tmp_path / "tasks/tasks.json", json.dumps([
        {"id": "T-1", "title": "Ship", "status": "todo", "priority": "P1", "due_date": "2024-05-09", "subtasks": [{"title": "a", "done": True}]},
        {"id": "T-2", "title": "Rest"}]))
    write(tmp_path / "tasks/bad.json", "[{]")
    write(tmp_path / "tenants/acme/persona.md", "Ops lead")
    write(tmp_path / "tenants/Bad Name/persona.md", "x")
    write(tmp_path / "persona.md", "Founder")
    return str(tmp_path)


def test_inbox(spark, data):
    mail = inbox.read_inbox(spark, f"{data}/inbox", f"{data}/tenants/acme/inbox").cache()
    good, bad = inbox.quarantined(mail)
    assert rows(good, "tenant_id", "filename", "date_key", "body", "thread_id") == [
        ("acme", "1.eml", "2024-05-07", "hi", "own"),
        ("default", "1.eml", "2024-05-06", "Grüße\nline", "plan"),
        ("default", "2.eml", "unknown", "body", "odd"),
        ("default", "3.eml", "2024-05-07", "plain part", "multi"),
    ]
    assert rows(bad, "filename") == [("4.eml",)]
    first = good.filter("thread_id = 'plan'").first()
    assert first.date_iso == "2024-05-06T23:30:00-07:00"
    assert good.filter("sent_at = TIMESTAMP '2024-05-07 06:30:00'").count() == 1


def test_calendar(spark, data):
    events = calendar.read_calendar(spark, f"{data}/calendar/calendar.ics")
    a = events.filter("uid = 'a'").first()
    assert (a.summary, a.status, a.description, str(a.start), str(a.end), a.date_key) == (
        "Board  prep", "CONFIRMED", "one\ntwo, three", "2024-05-06 09:00:00", "2024-05-06 10:00:00", "2024-05-06")
    assert [tuple(x) for x in a.attendees] == [("Ada", "ada@x.org", "ACCEPTED")]
    b = events.filter("uid = 'b'").first()
    assert (b.start, b.date_key, b.status, b.parse_error) == (None, "unknown", "CANCELLED", "bad DTSTART")
    assert events.count() == 2


def test_notes(spark, data):
    found = {r.note_id: r for r in notes.read_notes(spark, f"{data}/notes").collect()}
    week, loose = found["2024-05-06-week.md"], found["loose.md"]
    assert (week.title, week.created_at) == ("Week", "2024-05-06")
    assert [tuple(x) for x in week.checklist_items] == [("call Bo", False), ("done it", True)]
    assert (loose.title, loose.date_key, loose.checklist_items, loose.linked_entity_ids) == ("loose.md", "unknown", [], [])


def test_tasks_and_personas(spark, data):
    assert rows(tasks.read_tasks(spark, f"{data}/tasks/tasks.json", f"{data}/tasks/bad.json"), "tenant_id", "id", "status") == [
        ("default", "T-1", "todo"), ("default", "T-2", None)]
    personas = tasks.read_personas(spark, f"{data}/persona.md", f"{data}/tenants/acme/persona.md")
    assert rows(personas) == [("acme", "Ops lead"), ("default", "Founder")]
    wanted = spark.createDataFrame([("acme",), ("new",)], "tenant_id string")
    assert rows(tasks.tenants_without_persona(wanted, personas)) == [("new",)]
    assert rows(tenants.list_tenants(spark, data)) == [("acme",), ("default",)]


@pytest.mark.parametrize("bad", ["../x", "A", "a b", "", "-a", "a/b", "a" * 65])
def test_tenant_ids_are_checked(bad):
    with pytest.raises(ValueError):
        tenants.check_tenant_id(bad)
    assert tenants.tenant_root("/d/", "default") == "/d" and tenants.tenant_root("/d", "x-1") == "/d/tenants/x-1"


def test_config_merges_one_level_and_system_wins(spark, tmp_path):
    raw = spark.createDataFrame([
        ("a", '{"map_noise_filter": {"blocked_domains": ["Junk.io"]}, "circuit_breaker_threshold": 99}'), ("b", "{}")],
        "tenant_id string, config_json string")
    write(tmp_path / "system.json", '{"circuit_breaker_threshold": 7}')
    merged = tasks.merge_config(tasks.parse_config_rows(raw), tasks.read_system_config(spark, str(tmp_path / "system.json")))
    a = merged.filter("tenant_id = 'a'").first()
    assert a.use_persona_in_map and a.never_draft_contacts == [] and a.circuit_breaker_threshold == 7 and a.max_qps_per_tenant == 2.0
    assert (a.map_noise_filter.blocked_senders, a.map_noise_filter.blocked_domains) == ([], ["Junk.io"])
    assert rows(tasks.blocked_senders(merged)) == [("a", "domain", "junk.io")]


def test_citable_sources_fall_back(spark):
    mail = spark.createDataFrame([("t", "", "<m@x>", "Hi", "there"), ("t", "", "", None, "b")],
                                 "tenant_id string, filename string, message_id string, subject string, body string")
    note = spark.createDataFrame([("t", "n.md", "", "body")], "tenant_id string, note_id string, title string, body string")
    assert rows(citable.citable_sources(emails=mail, notes=note)) == [
        ("t", "email", "<m@x>", "Hi", "Hi there"), ("t", "email", "unknown", "(no subject)", "b"), ("t", "notes", "n.md", "n.md", " body")]


def entries(spark, *items):
    df = spark.createDataFrame(
        [(t, s, d, n, c) for t, s, d, n, c in items], "tenant_id string, source string, day string, note_id string, item_count bigint")
    return df.select(
        "tenant_id", "source", F.coalesce("note_id", "day").alias("entry_key"), "day", "note_id", "item_count",
        F.lit(None).cast("map<string,double>").alias("stats"), F.lit("persona").alias("map_variant"), F.lit(False).alias("hot"),
        F.lit(False).alias("compacted"), sort_day(F.col("day"), F.lit(False)).alias("sort_day"))


def test_ledger_round_trip(spark, tmp_path):
    path = str(tmp_path / "ledger")
    records.append_ledger(entries(spark, ("a", "email", "2024-05-01", None, 2), ("b", "email", "2024-05-01", None, 3)), path)
    records.append_ledger(entries(spark, ("a", "email", "2024-05-02", None, 4), ("a", "notes", "2024-05-02", "n.md", 1)), path)
    stored = records.read_ledger(spark, path, schemas.LEDGER_ENTRIES)
    assert rows(records.processed_keys(stored)) == [
        ("a", "email", "2024-05-01"), ("a", "email", "2024-05-02"), ("a", "notes", "n.md"), ("b", "email", "2024-05-01")]
    changed = stored.filter("tenant_id = 'a' AND source = 'email'").withColumn("item_count", F.col("item_count") * 10)
    records.replace_ledger(changed, path)
    after = records.read_ledger(spark, path, schemas.LEDGER_ENTRIES)
    assert rows(after, "tenant_id", "source", "day", "item_count") == [
        ("a", "email", "2024-05-01", 20), ("a", "email", "2024-05-02", 40), ("a", "notes", "2024-05-02", 1), ("b", "email", "2024-05-01", 3)]
    assert rows(records.of_tenant(path, spark, schemas.LEDGER_ENTRIES, "b"), "tenant_id", "item_count") == [("b", 3)]


def test_brief_history_and_logs(spark, tmp_path):
    base = str(tmp_path / "briefs")
    for run in ("r1", "r2"):
        records.save_brief(spark.createDataFrame([("t", run)], "tenant_id string, brief string"), base, run)
    assert rows(spark.read.parquet(f"{base}/current"), "brief") == [("r2",)]
    assert rows(spark.read.parquet(f"{base}/history"), "brief") == [("r1",), ("r2",)]
    calls = spark.createDataFrame([(1700000000.0, "t", "p", "m", 12.345, True, 0, None)], schemas.CALL_METRICS)
    records.append_calls(calls, str(tmp_path / "calls"))
    records.append_calls(calls, str(tmp_path / "calls"))
    back = records.read_calls(spark, str(tmp_path / "calls"))
    assert back.count() == 2 and back.first().latency_ms == pytest.approx(12.3, abs=0.06)
    runs = spark.createDataFrame([("x", "e", "v1"), ("y", "e", "v2")], "ts string, eval_name string, variant string")
    records.append_eval_runs(runs, str(tmp_path / "runs"))
    assert rows(records.read_eval_runs(spark, str(tmp_path / "runs"), "e", "v2"), "ts") == [("y",)]


def test_snapshots_are_content_addressed(spark):
    prompts = spark.createDataFrame([("e", "v", "text"), ("e", "v", "text"), ("e", "v", "other")], "eval_name string, variant string, prompt_text string")
    found = records.prompt_snapshots(prompts)
    assert found.count() == 2
    assert records.add_prompt_snapshots(found, found.filter("prompt_text = 'text'")).count() == 1
