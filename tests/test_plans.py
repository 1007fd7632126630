import json
import re
import sys
import time

import pytest
from pyspark import cloudpickle

from conftest import one, rows
from pyspark.sql import functions as F

from worksignal import schemas
from worksignal.operators import briefs
from worksignal.plans import brief_plan, map_plan, model_stage
from worksignal.session import settle
from worksignal.sources.records import processed_keys

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def mail(spark, *items):
    df = spark.createDataFrame(list(items), "tenant_id string, filename string, date_iso string, from_hdr string, subject string, body string, is_hot boolean")
    return df.withColumn("date_key", F.substring("date_iso", 1, 10)).withColumn("to_hdr", F.lit("me")).withColumn("thread_id", F.lower("subject"))


def answer(system_text, user_text):
    if "BOOM" in user_text:
        raise RuntimeError("no answer")
    found = [{"description": s, "priority": "P1"} for s in re.findall(r"^Subject: (.*)$", user_text, re.M)]
    return json.dumps({"deadlines": found, "decisions": [], "action_items": [], "thread_progressions": [], "mood": "calm"})


def nothing(spark):
    return processed_keys(spark.createDataFrame([], schemas.LEDGER_ENTRIES))


MAIL = [
    ("a", "2.eml", "2024-05-01T10:00:00", "B <b@x.org>", "Second", "text", False),
    ("a", "1.eml", "2024-05-01T09:00:00", "C <c@x.org>", "Re: First", "text", True),
    ("a", "3.eml", "2024-05-02T09:00:00", "C <c@x.org>", "BOOM", "text", False),
    ("b", "1.eml", "2024-05-01T09:00:00", "D <d@x.org>", "Other", "text", False),
]


def test_map_mail(spark):
    entries, items, rejected = map_plan.map_mail(mail(spark, *MAIL), nothing(spark), answer)
    assert rows(entries, "tenant_id", "entry_key", "item_count", "hot", "map_variant") == [
        ("a", "2024-05-01", 2, True, "persona"), ("b", "2024-05-01", 1, False, "persona")]
    assert entries.filter("tenant_id = 'a'").first().stats["reply_count"] == 1.0
    assert rows(items.filter("category = 'deadlines'"), "tenant_id", "ordinal", "text") == [
        ("a", 0, "Re: First P1"), ("a", 1, "Second P1"), ("b", 0, "Other P1")]
    assert rows(items.filter("category = 'mood'"), "text") == [("calm",), ("calm",)]
    assert rows(rejected, "unit_key") == [("2024-05-02",)]
    # The failed day is still open; the others are not asked again.
    later, _, _ = map_plan.map_mail(mail(spark, *MAIL), processed_keys(entries), lambda s, u: answer(s, u.replace("BOOM", "fine")))
    assert rows(later, "tenant_id", "entry_key") == [("a", "2024-05-02")]


def test_a_long_day_is_asked_in_pages(spark):
    day = [("a", f"{k}.eml", f"2024-05-01T09:00:0{k}", "B <b@x.org>", "BOOM" if k == 6 else f"Mail {k}", "text", False) for k in range(8)]
    seen = spark.sparkContext.accumulator(0)

    def count(system_text, user_text):
        assert user_text.startswith("Emails for 2024-05-01:\n\n") and user_text.count("--- Email ") <= 3
        seen.add(1)
        return answer(system_text, user_text)

    whole = [m for m in day if m[4] != "BOOM"]
    entries, items, rejected = map_plan.map_mail(mail(spark, *whole), nothing(spark), count, page_mails=3)
    assert seen.value == 3
    assert rows(entries, "entry_key", "item_count") == [("2024-05-01", 7)] and rejected.count() == 0
    said = items.filter("category = 'deadlines'").orderBy("ordinal").collect()
    assert [r.text for r in said] == [f"{m[4]} P1" for m in whole] and {r.entry_key for r in said} == {"2024-05-01"}
    # One page without an answer leaves the whole day open.
    entries, items, rejected = map_plan.map_mail(mail(spark, *day), nothing(spark), count, page_mails=3)
    assert entries.count() == 0 and items.count() == 0
    assert rows(rejected, "unit_key", "errors") == [("2024-05-01", ["RuntimeError: no answer"])]


def test_tenants_do_not_see_each_other(spark):
    both, _, _ = map_plan.map_mail(mail(spark, *MAIL), nothing(spark), answer)
    alone, _, _ = map_plan.map_mail(mail(spark, *[m for m in MAIL if m[0] == "b"]), nothing(spark), answer)
    assert rows(both.filter("tenant_id = 'b'")) == rows(alone)


def test_unreadable_and_blocked_mail_stays_out(spark):
    all_mail = mail(spark, *MAIL)
    marked = all_mail.withColumn("parse_error", F.when(F.col("tenant_id") == "b", "broken"))
    entries, _, _ = map_plan.map_mail(marked, nothing(spark), answer)
    assert entries.filter("tenant_id = 'b'").count() == 0 and entries.count() > 0
    domain = all_mail.select("tenant_id", F.lit("domain").alias("kind"), F.regexp_extract("from_hdr", "@([^>]+)", 1).alias("value")).distinct()
    assert map_plan.map_mail(all_mail, nothing(spark), answer, blocked=domain)[0].count() == 0


def test_items_by_their_json_type(spark):
    payload = json.dumps({"note_type": "[draft] plan", "open": ["[x] looks like a list", "{so does this", {"text": "a", "deep": ["b", 1]}, None], "n": 3, "o": {"k": "v"}})
    accepted = spark.createDataFrame([("t", "s", "u", payload)], "tenant_id string, stage string, unit_key string, payload string")
    got = rows(model_stage.payload_items(accepted), "category", "ordinal", "text")
    assert got == sorted([("note_type", 0, "[draft] plan"), ("open", 0, "[x] looks like a list"), ("open", 1, "{so does this"),
                          ("open", 2, "a b"), ("n", 0, "3"), ("o", 0, "v")], key=repr)


def test_judge_shows_every_source_and_passes_over_bad_evidence(spark):
    claims = spark.createDataFrame([("t", f"- claim {i:05d}", f"- claim {i:05d}") for i in range(700)], "tenant_id string, claim_id string, text string")
    sources = spark.createDataFrame([("t", "email", f"{i:09d}", "L", "text") for i in range(6000)], "tenant_id string, source string, ref string, label string, text string")
    (unit,) = brief_plan.judge_units(claims, sources).collect()
    lines = unit.user_text.split("\n")
    assert lines[0] == "Claims:" and lines[1] == "0. - claim 00000" and len(lines) == 1 + 700 + 2 + 6000
    reply = json.dumps({"matches": [
        {"claim_index": 3, "evidence": ["no object", {"source_ref": "email:1", "quote": "q"}, 7, None, {"source_ref": "email:2", "quote": "r"}]},
        {"claim_index": "0", "evidence": [{"source_ref": "email:3", "quote": "q"}]}, {"claim_index": 1.5, "evidence": []}, {"claim_index": 2, "evidence": "none"}]})
    accepted = spark.createDataFrame([("t", "judge", "judge", reply)], "tenant_id string, stage string, unit_key string, payload string")
    got = rows(brief_plan.judge_evidence(accepted, claims), "claim_id", "source_ref", "quote")
    assert got == [("- claim 00003", "email:1", "q"), ("- claim 00003", "email:2", "r")]


def test_all_quiet_senders_are_told_of(spark):
    entries, items = _ledger(spark)
    tenant = entries.select("tenant_id").first()[0]
    quiet = spark.range(6000).select(
        F.lit(tenant).alias("tenant_id"), F.lit("N").alias("name"), F.format_string("s%05d@x.example", "id").alias("email"),
        F.lit("2024-05-01").alias("last_seen"), F.lit("2024-04-01").alias("first_seen"), F.lit(9).alias("days_since_last_contact"), F.lit(2).alias("email_count"))
    units = {r.unit_key: r.user_text for r in brief_plan.ledger_digest_units(entries, items, None, "2024-05-10", quiet).collect()}
    assert units["email"].count("@x.example") == 6000 and len(units) == len(set(units))


def test_map_notes_and_calendar(spark):
    notes = spark.createDataFrame([("t", "2024-05-01-a.md", "A", "2024-05-01", "body", [("x", False)])],
                                  "tenant_id string, note_id string, title string, created_at string, body string, checklist_items array<struct<text:string,done:boolean>>"
                                  ).withColumn("date_key", F.col("created_at"))
    reply = json.dumps({"note_type": "mixed", "decisions": [], "open_items_still_relevant": [{"text": "x", "priority": "P0"}], "key_people": []})
    entries, items, _ = map_plan.map_notes(notes, nothing(spark), lambda s, u: reply, "2024-05-04")
    assert rows(entries, "entry_key", "day", "note_id", "item_count") == [("2024-05-01-a.md", "2024-05-01", "2024-05-01-a.md", 1)]
    assert ("stats", "stale_open_items", "x") in rows(items, "section", "category", "text")
    events = spark.createDataFrame([("t", "f", "Deep work", "CONFIRMED", 9, 11), ("t", "m", "Board", "CONFIRMED", 10, 12), ("t", "c", "Gone", "CANCELLED", 9, 10)],
                                   "tenant_id string, uid string, summary string, status string, s int, e int")
    at = lambda c: F.timestamp_add("HOUR", F.col(c), F.lit("2024-05-01 00:00:00").cast("timestamp_ntz"))
    events = events.select("tenant_id", "uid", "summary", "status", F.lit("").alias("location"), F.lit("d").alias("description"), at("s").alias("start"),
                           at("e").alias("end"), F.lit("2024-05-01").alias("date_key"), F.array().cast(schemas.ATTENDEES).alias("attendees"))
    reply = json.dumps({"meetings_needing_prep": [], "family_calendar_items": [], "pattern_flags": [], "notable_events": []})
    entries, items, _ = map_plan.map_calendar(events, nothing(spark), lambda s, u: reply)
    assert entries.first().stats["focus_hours_eroded"] == 1.0
    assert rows(items, "category", "text") == [("declined_or_cancelled", "Gone 2024-05-01 CANCELLED"), ("deep_work_conflicts", "Board 2024-05-01T10:00:00")]


def _ledger(spark):
    entries, items, _ = map_plan.map_mail(mail(
        spark, ("a", "1.eml", "2024-05-09T09:00:00", "B <b@x.org>", "Kestrel renewal slips", "text", False)), nothing(spark), answer)
    note = spark.createDataFrame([("a", "notes", "n.md", "2024-05-08", "n.md", 1)], "tenant_id string, source string, entry_key string, day string, note_id string, item_count bigint")
    note = note.select("*", F.lit(None).cast("map<string,double>").alias("stats"), F.lit("persona").alias("map_variant"), F.lit(False).alias("hot"),
                       F.lit(False).alias("compacted"), F.col("day").cast("date").alias("sort_day"))
    fact = spark.createDataFrame([("a", "notes", "n.md", "delta", "decisions", 0, '{"description": "Kestrel renewal is on", "priority": "P1"}', "Kestrel renewal is on")], schemas.LEDGER_ITEMS)
    return settle(entries.unionByName(note.select(*entries.columns))), settle(items.unionByName(fact))


def test_briefs_for_all_tenants(spark):
    entries, items = _ledger(spark)
    tasks = spark.createDataFrame([("a", "T-1", "Kestrel renewal", "todo", "P0", "2024-05-11", None, None, None), ("a", "T-2", "Hire engineer", "todo", "P1", "2024-05-01", None, None, None)],
                                  "tenant_id string, id string, title string, status string, priority string, due_date string, created_at string, blocked_by string, subtasks array<struct<title:string,done:boolean>>")
    config = spark.createDataFrame([("a", [("Kim", "")])], "tenant_id string, never_draft_contacts array<struct<name:string,email:string>>")
    seen = {}

    def contradictions(s, u):
        return json.dumps({"contradictions": [{"entity": "T-1: late", "sources": ["email", "notes"], "description": "slips or not"},
                                              {"entity": "T-7", "sources": ["email"], "description": "made up"}]})

    def synthesis(s, u):
        assert "TASK SIGNALS:" in u and "- T-1: late (email, notes): slips or not" in u and "made up" not in u
        assert "### 2024-05-09 (YESTERDAY) (1 emails)" in u and "[notes, n.md] Kestrel renewal is on" in u
        return json.dumps({"what_matters_today": "Kestrel renewal. ", "what_might_be_missed": "Nothing",
                           "dispatchable_items": [{"id": "1", "type": "email_reply", "summary": "Ask Kim", "context": ""},
                                                  {"id": "2", "type": "email_reply", "summary": "Ask Bo", "context": "now"}]})

    def drafts(s, u):
        assert "Bo" in u and "Kim" not in u
        return json.dumps({"drafts": [{"id": "2", "draft_text": "Hi Bo"}]})

    out = brief_plan.write_briefs(entries, items, None, tasks, config, {"contradictions": contradictions, "synthesis": synthesis, "drafts": drafts}, "2024-05-10")
    assert one(out["briefs"], "brief")[0] == (
        "# Daily Brief\n\n> ⚠️ **Data freshness notice**\n> - calendar: no data available at all.\n> - notes: most recent data is from 2024-05-08 (2 days ago).\n\n"
        "## What Matters Today\n\nKestrel renewal.\n\n## What You Might Be Missing\n\nNothing\n\n## Quick Dispatches\n\n"
        "**Ask Kim**\n*(surfaced for you to handle directly — not drafted)*\n\n**Ask Bo**\n> Hi Bo\n")
    assert rows(out["uncovered"], "task_id") == [("T-2",)]
    assert rows(out["dropped_contradictions"], "entity", "reason") == [("T-7", "unknown entity")]

    told = lambda s, u: json.dumps({"what_matters_today": "A", "what_might_be_missed": "B"})
    listed = lambda s, u: json.dumps({"dispatchable_items": [{"id": "9", "type": "x", "summary": "NARRATIVE" if "what_matters_today:\nA" in u else "no", "context": ""}]})
    staged = brief_plan.write_briefs(entries, items, None, tasks, config, {
        "contradictions": contradictions, "narrative": told, "dispatch": listed, "drafts": lambda s, u: '{"drafts": []}'}, "2024-05-10", "staged")
    assert "**NARRATIVE**" in one(staged["briefs"], "brief")[0]


SOURCES = [("t", "email", "0001.eml", "Mail", "Pump two leak cleared by the night shift"), ("t", "notes", "n.md", "Note", "Pump leak cleared, audit pending"),
           ("t", "calendar", "ev", "Event", "Quarterly audit of Brightwater"), ("t", "task", "T", "Task", "Unrelated words only"), ("t", "email", "2.eml", "M2", "More words again")]


def test_cite_and_read_back(spark):
    sources = spark.createDataFrame(SOURCES, "tenant_id string, source string, ref string, label string, text string")
    text = "# Daily Brief\n\n## What Matters Today\n\n- Pump leak cleared\n- Pump leak cleared\n- Brightwater visit soon\n\n## Quick Dispatches\n\n**Leak cleared press**\n> Hi\n> there\n\n**None**\n*(surfaced for you to handle directly — not drafted)*\n"
    brief = spark.createDataFrame([("t", text)], "tenant_id string, brief string")

    def judge(s, u):
        index = re.search(r"^(\d+)\. - Brightwater visit soon$", u, re.M).group(1)
        return json.dumps({"matches": [{"claim_index": int(index), "evidence": [{"source_ref": "ev", "quote": "audit of Brightwater"}, {"source_ref": "zz", "quote": "x"}]}]})

    cited, stats = brief_plan.cite(brief, sources, judge)
    got = one(cited, "brief")[0]
    tag = " _[source: email: 0001.eml, notes: n.md]_"
    assert got == text.replace("- Pump leak cleared", "- Pump leak cleared" + tag).replace(
        "- Brightwater visit soon", "- Brightwater visit soon _[source: calendar: ev (inferred)]_").replace("**Leak cleared press**", "**Leak cleared press**" + tag)
    assert one(stats) == ("t", 3, 1, 1)
    bullets = {r.bullet_no: r for r in briefs.brief_bullets(cited, "What Matters Today").collect()}
    assert bullets[2].text == "- Brightwater visit soon" and [tuple(c) for c in bullets[2].citations] == [("calendar", "ev", "llm")]
    labels = briefs.labelled_citations(briefs.brief_bullets(cited, "What Matters Today"), sources.filter("ref <> 'ev'"))
    assert ("ev", "ev", "llm") in rows(labels, "ref", "label", "matched_via") and ("n.md", "Note", "keyword") in rows(labels, "ref", "label", "matched_via")
    drafts = briefs.brief_drafts(cited).orderBy("draft_no").collect()
    assert [(d.summary, d.drafted, d.draft_text, len(d.citations)) for d in drafts] == [("Leak cleared press", True, "Hi\nthere", 2), ("None", False, "", 0)]


def test_structured_items(spark):
    sources = spark.createDataFrame(SOURCES, "tenant_id string, source string, ref string, label string, text string")
    context = spark.createDataFrame([("t", "ctx")], "tenant_id string, text string")
    reply = json.dumps({"items": [{"id": "i1", "type": "action", "title": "A", "summary": "Pump leak cleared", "priority": "P4", "due_date": "2024-05-10"},
                                  {"id": "i2", "type": "information", "title": "B", "summary": "Something else", "priority": "P1", "due_date": None}]})
    found = brief_plan.write_structured(context, sources, lambda s, u: reply, "2024-05-10")
    assert rows(found, "id", "date_urgency", "priority_disagreement", "source_refs") == [
        ("i1", "due_today", True, ["email:0001.eml", "notes:n.md"]), ("i2", "no_date", False, [])]


def test_source_digest_requests(spark):
    entries, items = _ledger(spark)
    units = {r.unit_key: r.user_text for r in brief_plan.ledger_digest_units(entries, items, None, "2024-05-10").collect()}
    assert units["email"].startswith("TODAY'S DATE: 2024-05-10 (Friday)\n\n---\n\nDETERMINISTIC SENDER STALENESS")
    assert "- DEADLINE [P1]: Kestrel renewal slips (date: unspecified, from: )" in units["email"]
    assert "### 2024-05-08 — n.md\n- DECISION [P1]: Kestrel renewal is on" in units["notes"]


def test_a_model_merges_stale_weeks(spark):
    from worksignal.operators import compaction

    entries, items = _ledger(spark)
    _, stale = compaction.split_by_age(entries, "2024-07-01")
    reply = json.dumps({"deadlines": [{"description": "merged", "priority": "P1"}], "decisions": [], "action_items": [], "thread_progressions": []})
    merged, rejected = map_plan.merged_weeks(stale, items, lambda s, u: reply)
    assert rows(merged, "source", "entry_key", "text") == [("email", "2024-W19", "merged P1")]
    assert rows(rejected, "unit_key") == [("notes|2024-W19",)]
    kept, new_items, cover = compaction.compact(entries, items, "2024-07-01", week_items=merged)
    assert rows(kept, "source", "entry_key", "compacted") == [("email", "2024-W19", True), ("notes", "n.md", False)]
    assert ("email", "merged P1") in rows(new_items, "source", "text") and rows(cover, "day") == [("2024-05-09",)]


def test_remembered_answers_survive_a_death_and_are_asked_once(spark, tmp_path):
    from pyspark.sql import functions as F

    counts = {name: spark.sparkContext.accumulator(0) for name in ("all", "bad")}

    def answer(system_text, user_text):
        counts["all"].add(1)
        if user_text.startswith("bad"):
            counts["bad"].add(1)
            return "nothing"
        if user_text.startswith("error"):
            raise ValueError("busy")
        return '{"found": [{"n": 1}]}'

    units = [("t", f"u{k}", f"text {k % 20}") for k in range(60)] + [("t", "b", "bad"), ("t", "e", "error"), ("t", "none", None)]
    reqs = model_stage.requests(spark.createDataFrame(units, "tenant_id string, unit_key string, user_text string"), "s", "be brief")
    memory = model_stage.Remembered(answer, str(tmp_path / "answers"), "m", wave=4)
    infer, left = model_stage.infer, [3]

    def dying(*args):
        left[0] -= 1
        if left[0] < 0:
            raise RuntimeError("lost")
        return infer(*args)

    model_stage.infer = dying
    try:
        with pytest.raises(RuntimeError):
            model_stage.ask_and_check(reqs, memory, {"found": ("n",)})
    finally:
        model_stage.infer = infer
    stored = model_stage.stored_answers(spark, memory.path)
    kept, before = stored.filter("response LIKE '{%'").count(), counts["all"].value
    assert 0 < kept <= before < 22
    accepted, rejected = model_stage.ask_and_check(reqs, memory, {"found": ("n",)})
    assert accepted.count() == 60 and rows(rejected, "unit_key") == [("b",), ("e",), ("none",)]
    # 20 texts, the bad one, the failing one and the empty one: what was stored and fits is not asked again.
    assert counts["all"].value == before + 23 - kept
    first = counts["all"].value
    again, _ = model_stage.ask_and_check(reqs, memory, {"found": ("n",)})
    assert rows(again) == rows(accepted) and counts["all"].value == first + 3
    other = model_stage.ask(reqs.filter("unit_key = 'u1'"), memory._replace(model="other"))
    assert other.count() == 1 and counts["all"].value == first + 4
    assert model_stage.stored_answers(spark, memory.path).filter(F.col("model") == "other").count() == 1


def test_a_wave_reads_its_own_requests(spark, tmp_path, monkeypatch):
    units = spark.createDataFrame([("t", f"u{k}", f"text {k}") for k in range(30)], "tenant_id string, unit_key string, user_text string")
    infer, read = model_stage.infer, []

    def watched(reqs, answer):
        read.append(set(reqs.inputFiles()))
        return infer(reqs, answer)

    monkeypatch.setattr(model_stage, "infer", watched)
    memory = model_stage.Remembered(lambda s, u: u.upper(), str(tmp_path / "answers"), "m", wave=10)
    told = model_stage.ask(model_stage.requests(units, "s", ""), memory)
    assert rows(told, "unit_key", "response") == sorted((f"u{k}", f"TEXT {k}") for k in range(30))
    assert len(read) > 1 and all(read) and sum(map(len, read)) == len(set().union(*read))
    assert len(model_stage.stored_answers(spark, memory.path).inputFiles()) == len(read)


def test_many_waves_are_few_jobs_and_a_death_loses_one_wave(spark, tmp_path, monkeypatch):
    units = spark.createDataFrame([("t", f"u{k}", f"text {k:03d}") for k in range(200)], "tenant_id string, unit_key string, user_text string")
    infer, asked = model_stage.infer, []

    def answer(system_text, user_text):
        return user_text.upper()

    def dying(reqs, answer):
        asked.append(reqs.count())
        last = reqs.agg({"user_text": "max"}).first()[0]

        def die(system_text, user_text):
            if user_text == last:
                time.sleep(8)  # until the other tasks are over
                raise SystemExit
            return answer(system_text, user_text)

        return infer(reqs, die if len(asked) == 6 else answer)

    monkeypatch.setattr(model_stage, "infer", dying)
    reqs = model_stage.requests(units, "s", "")
    memory = model_stage.Remembered(answer, str(tmp_path / "answers"), "m", wave=8)
    with pytest.raises(Exception):
        model_stage.ask(reqs, memory)
    stored = model_stage.stored_answers(spark, memory.path)
    assert len(asked) == 6 and sum(asked) == 200 and 200 - 8 <= stored.count() < 200
    told = model_stage.ask(reqs, memory)
    assert rows(told, "unit_key", "response") == sorted((f"u{k}", f"TEXT {k:03d}") for k in range(200))
    assert stored.sparkSession.read.parquet(memory.path).count() == 200 and sum(asked[6:]) <= 8
    asked.clear()
    few = model_stage.ask(model_stage.requests(units.limit(30), "s", "briefly"), memory._replace(wave=10), tasks=2)
    assert few.count() == 30 and len(asked) <= 3


def test_responses_are_checked_once(spark):
    told = spark.createDataFrame([("t", "s", k, r, e) for k, r, e in (
        ("good", 'so: {"found": [{"n": 1}, "x"], "none": {}}', None), ("empty", "{}", None), ("bare", "no JSON", None),
        ("none", None, None), ("failed", None, "Timeout"))], "tenant_id string, stage string, unit_key string, response string, error string")
    accepted, rejected = model_stage.check(told, {"found": ()})
    assert rows(accepted, "unit_key", "payload") == [("good", '{"found": [{"n": 1}, "x"], "none": {}}')]
    assert dict(rows(rejected, "unit_key", F.col("errors")[0])) == {
        "empty": "Missing top-level key: 'found'", "bare": "Not a JSON text", "none": "No response", "failed": "Timeout"}
    assert rows(model_stage.payload_items(accepted), "category", "ordinal", "payload") == [("found", 0, '{"n":1}'), ("found", 1, "x"), ("none", 0, "{}")]
    for df in (accepted, rejected):
        assert "RLIKE" not in df._jdf.queryExecution().optimizedPlan().toString()
