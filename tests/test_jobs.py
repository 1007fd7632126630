import json
import re
import sys

import pytest
from conftest import rows
from pyspark import cloudpickle
from pyspark.sql import functions as F

from worksignal.operators.rendering import ledger_lines, ledger_text
from worksignal.plans import jobs
from worksignal.sources import runs
from worksignal.sources.records import latest_briefs

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8", newline="")


def tenant(root, name, day="06"):
    for k, (sender, subject) in enumerate([("Ada <ada@x.org>", f"Pump audit of {name}"), ("Spam <s@noise.example>", "Buy now")]):
        put(root / f"inbox/{k}.eml", f"Subject: {subject}\nFrom: {sender}\nTo: b@x.org\nDate: Mon, {day} May 2024 09:00:00 +0000\n\nhello\n")
    put(root / "calendar/c.ics", f"BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:ev-{name}\r\nDTSTART:202405{day}T090000\r\nDTEND:202405{day}T100000\r\n"
        f"SUMMARY:Pump audit with {name}\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:bad\r\nDTSTART:soon\r\nSUMMARY:x\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n")
    put(root / f"notes/2024-05-{day}-a.md", "# Pump audit\n- [ ] call Bo\n")
    put(root / "tasks/tasks.json", json.dumps([{"id": "T-1", "title": "Pump audit", "status": "todo", "priority": "P0", "due_date": "2024-05-08"}]))


def said(keys, category):
    def answer(system_text, user_text):
        found = re.findall(r"^(?:Subject|Summary|Title): (.*)$", user_text, re.M)
        return json.dumps({**{k: [] for k in keys}, category: [{f: s for f in ("description", "summary", "why", "text", "priority")} for s in found]})

    return answer


ANSWERS = {
    "email": said(("deadlines", "decisions", "action_items", "thread_progressions"), "decisions"),
    "calendar": said(("meetings_needing_prep", "family_calendar_items", "pattern_flags", "notable_events"), "notable_events"),
    "notes": lambda s, u: json.dumps({"note_type": "plan", "decisions": [], "open_items_still_relevant": [], "key_people": []}),
}
BRIEF = {
    "contradictions": lambda s, u: '{"contradictions": []}',
    "synthesis": lambda s, u: json.dumps({"what_matters_today": "- The pump audit is on the ninth of May", "what_might_be_missed": "- Nothing much",
                                          "dispatchable_items": [{"id": "1", "type": "email_reply", "summary": "Ask Ada", "context": "pump"}]}),
    "drafts": lambda s, u: json.dumps({"drafts": [{"id": "1", "draft_text": "Hi Ada"}]}),
}


def test_from_files_to_saved_briefs(spark, tmp_path):
    roots = [tmp_path / "main", tmp_path / "tenants/acme", tmp_path / "tenants/Bad.Name"]
    for root in roots:
        tenant(root, root.name.lower().replace(" ", ""))
    ledger, out = str(tmp_path / "ledger"), str(tmp_path / "briefs")
    found = jobs.read_sources(spark, [str(r) for r in roots])
    assert rows(found["refused"]) == [("Bad.Name",)]
    assert rows(found["quarantine"], "tenant_id", "source", "ref") == [("acme", "calendar", "bad"), ("default", "calendar", "bad")]
    blocked = spark.createDataFrame([(t, "domain", "noise.example") for t in ("acme", "default")], "tenant_id string, kind string, value string")
    rejected = jobs.run_sources(spark, found, ledger, ANSWERS, "2024-05-07", blocked)
    assert rejected.count() == 0
    entries = runs.read_table(spark, ledger, "entries")
    want = [(t, s, k, n) for t in ("acme", "default") for s, k, n in (
        ("calendar", "2024-05-06", 1), ("email", "2024-05-06", 1), ("notes", "2024-05-06-a.md", 1))]
    assert rows(entries, "tenant_id", "source", "entry_key", "item_count") == want
    jobs.run_sources(spark, found, ledger, ANSWERS, "2024-05-07", blocked)
    entries = runs.read_table(spark, ledger, "entries")
    assert rows(entries, "tenant_id", "source", "entry_key", "item_count") == want  # nothing is taken twice

    digests = jobs.run_digests(spark, found, ledger, lambda s, u: "too short" if "Calendar" in u else "word " * 100, "2024-05-07")
    assert rows(digests.filter("accepted = (source <> 'calendar')"), "tenant_id", "source") == [(t, s) for t in ("acme", "default") for s in ("calendar", "email", "notes")]

    config = spark.createDataFrame([("acme", [])], "tenant_id string, never_draft_contacts array<struct<name:string,email:string>>")
    for run_ts in ("2024-05-07T08", "2024-05-08T08"):
        jobs.run_briefs(spark, found, ledger, out, config, BRIEF, "2024-05-07", run_ts)
    stored = spark.read.schema("tenant_id string, brief string, run_ts string").parquet(f"{out}/history")
    last = latest_briefs(stored, "2024-05-08T00").collect()
    assert {(r.tenant_id, r.run_ts) for r in last} == {("acme", "2024-05-07T08"), ("default", "2024-05-07T08")}
    assert all("The pump audit is on the ninth of May" in r.brief and "> Hi Ada" in r.brief for r in last)

    week = {"deadlines": [], "decisions": [{"description": "audit", "priority": "P2"}], "action_items": [], "thread_progressions": []}
    jobs.roll_up(spark, ledger, "2024-07-01", lambda s, u: json.dumps(week))
    rolled = runs.read_table(spark, ledger, "entries")
    assert rows(rolled.filter("source = 'email'"), "entry_key", "compacted", "item_count") == [("2024-W19", True, 1)] * 2
    assert rows(rolled.filter("source = 'calendar'"), "entry_key", "compacted") == [("2024-05-06", False)] * 2  # the answer does not fit
    texts = runs.read_table(spark, ledger, "items").filter("source = 'email'")
    assert rows(texts, "entry_key", "text") == [("2024-W19", "audit P2")] * 2
    assert jobs.run_sources(spark, found, ledger, ANSWERS, "2024-07-01", blocked).count() == 0
    assert runs.read_table(spark, ledger, "entries").filter(F.col("source") == "email").count() == 2


def day_ledger(spark, ledger, days=("2026-06-01", "2026-06-02", "2026-06-03")):
    """One committed run: mail of three days of one week, an item a day, one of them important on each day."""
    entry = [("t", "email", d, d, None, 2, {"unique_senders": 1.0}, "persona", False, False, None) for d in days]
    item = [("t", "email", d, "delta", "decisions", k, json.dumps({"description": text, "priority": p}), text)
            for n, d in enumerate(days) for k, (text, p) in enumerate([(f"plan {n}", "P2"), ("ship", "P1"), ("same", "P3")])]
    item += [("t", "calendar", days[0], "stats", "deep_work_conflicts", 5, json.dumps({"summary": "Focus", "start": "s", "overlap_hours": 1.0}), "Focus s")]
    entry += [("t", "calendar", days[0], days[0], None, 1, {"meeting_count": 1.0}, "persona", False, False, None)]
    run = runs.new_run()
    runs.write_rows(spark.createDataFrame(entry, runs.TABLES["entries"]), ledger, "entries", run)
    runs.write_rows(spark.createDataFrame(item, runs.TABLES["items"]), ledger, "items", run)
    runs.commit(spark, ledger, run)


def contents(spark, ledger):
    entries, items, cover = runs.read_ledger_tables(spark, ledger)
    text = ledger_text(ledger_lines(entries, items, cover))
    return [rows(df) for df in (entries.withColumn("stats", F.to_json("stats")), items, cover.withColumn("stats", F.to_json("stats")), text)]


def test_daily_roll_ups_leave_what_one_leaves(spark, tmp_path):
    daily, once = str(tmp_path / "daily"), str(tmp_path / "once")
    for ledger in (daily, once):
        day_ledger(spark, ledger)
    for day in ("2026-07-02", "2026-07-03", "2026-07-04"):
        jobs.roll_up(spark, daily, day)
    jobs.roll_up(spark, once, "2026-07-04")
    found = contents(spark, daily)
    assert found == contents(spark, once)
    assert [(r[1], r[2], r[5]) for r in found[0]] == [("calendar", "2026-W23", 1), ("email", "2026-W23", 6)]
    text = dict((r[1], r[2]) for r in found[3])
    assert text["email"].count("DECISION [P1]: ship") == 3 and text["email"].count("DECISION [P3]: same") == 1
    # The facts of a covered day keep their details.
    assert "  2026-06-01:\n" in text["calendar"] and "    - DEEP WORK CONFLICT: 'Focus' at s (1.0h overlap)" in text["calendar"]
    jobs.roll_up(spark, daily, "2026-07-05")
    assert contents(spark, daily) == found


def test_a_model_opens_a_week_for_its_late_days(spark, tmp_path):
    ledger, seen = str(tmp_path / "ledger"), spark.sparkContext.accumulator(0)
    day_ledger(spark, ledger)

    def answer(system_text, user_text):
        seen.add(1)
        n = user_text.count("decisions:")
        return json.dumps({"deadlines": [], "decisions": [{"description": f"of {n}", "priority": "P2"}], "action_items": [], "thread_progressions": []})

    for day in ("2026-07-02", "2026-07-04"):
        jobs.roll_up(spark, ledger, day, answer)
    entries, items, cover = runs.read_ledger_tables(spark, ledger)
    # Three items of the first day, then the week's one and six of its late days.
    assert rows(items.filter("source = 'email'"), "entry_key", "ordinal", "text") == [("2026-W23", 0, "of 7 P2")]
    assert rows(entries.filter("source = 'email'"), "entry_key", "item_count") == [("2026-W23", 6)] and cover.count() == 3


@pytest.mark.parametrize("job", ["sources", "weeks"])
def test_a_run_that_dies_anywhere_is_repeated_without_a_trace(spark, tmp_path, monkeypatch, job):
    root, ledger = tmp_path / "main", str(tmp_path / "ledger")
    tenant(root, "main")
    found = jobs.read_sources(spark, [str(root)])

    def work(path):
        if job == "sources":
            jobs.run_sources(spark, found, path, ANSWERS, "2024-05-07")
        else:
            jobs.roll_up(spark, path, "2026-07-03")

    def ready(path):
        if job == "weeks":
            day_ledger(spark, path)
        return path

    work(ready(str(tmp_path / "whole")))
    want, kinds = contents(spark, str(tmp_path / "whole")), {"write_rows": runs.write_rows, "write_replaced": runs.write_replaced, "commit": runs.commit}
    writes = 3 if job == "sources" else 5
    for last in range(writes):
        path, left = ready(f"{ledger}{last}"), [last]

        def dying(write):
            def run(*args, **kwargs):
                if not left[0]:
                    raise RuntimeError("lost")
                left[0] -= 1
                return write(*args, **kwargs)

            return run

        with monkeypatch.context() as patch:
            for name, write in kinds.items():
                patch.setattr(runs, name, dying(write))
            with pytest.raises(RuntimeError):
                work(path)
        work(path)
        assert contents(spark, path) == want


def test_a_tidied_ledger_holds_what_counts(spark, tmp_path):
    ledger, other = str(tmp_path / "ledger"), str(tmp_path / "other")
    day_ledger(spark, ledger)
    jobs.roll_up(spark, ledger, "2026-07-03")
    runs.tidy(spark, ledger, other)
    assert contents(spark, other) == contents(spark, ledger)
    stored = spark.read.parquet(f"{other}/entries").count()
    assert stored == runs.read_table(spark, ledger, "entries").count() < spark.read.parquet(f"{ledger}/entries").count()


def test_a_ledgers_lines_are_computed_once_for_its_text(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    day_ledger(spark, ledger)
    entries, items, _ = runs.read_ledger_tables(spark, ledger)
    text = ledger_text(ledger_lines(entries.persist(), items.persist()))
    # Entries give their own lines and their items' place, items their lines.
    assert text._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation") == 3


def test_an_items_line_is_computed_once(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    day_ledger(spark, ledger)
    entries, items, _ = runs.read_ledger_tables(spark, ledger)
    plan = ledger_lines(entries, items)._jdf.queryExecution().optimizedPlan().toString()
    # A deadline, a decision and an action name their subject.
    assert plan.count("$.source_subject") == 3
