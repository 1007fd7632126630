import datetime

from conftest import one, rows
from pyspark.sql import functions as F

from worksignal.operators import calendar_signals, mail_signals, note_signals, task_signals

DAY = "2024-05-06"


def events(spark, *items):
    """Events of one day from (uid, summary, from, to, status) with times as HH:MM."""
    df = spark.createDataFrame(list(items), "uid string, summary string, s string, e string, status string")
    def at(c):
        return F.when(F.col(c).isNotNull(), F.concat(F.lit(DAY + " "), F.col(c), F.lit(":00"))).cast("timestamp_ntz")
    return df.select(F.lit("t").alias("tenant_id"), F.lit(DAY).alias("date_key"), "uid", "summary", "status",
                     at("s").alias("start"), at("e").alias("end"))


def stats(spark, *items):
    return calendar_signals.day_calendar_stats(events(spark, *items)).first()


def test_full_partial_and_touching_overlap(spark):
    focus = ("f", "Deep Work", "09:00", "11:00", "CONFIRMED")
    full = stats(spark, focus, ("m", "Sync", "08:00", "12:00", "CONFIRMED"))
    assert (full.focus_hours_eroded, full.focus_hours_protected) == (2.0, 0.0)
    part = stats(spark, focus, ("m", "Sync", "10:30", "12:00", "CONFIRMED"))
    assert (part.focus_hours_eroded, part.focus_hours_protected) == (0.5, 1.5)
    touch = stats(spark, focus, ("m", "Sync", "11:00", "12:00", "CONFIRMED"))
    assert (touch.focus_hours_eroded, touch.focus_hours_protected) == (0.0, 2.0)


def test_overlaps_count_per_meeting_and_protected_stays_positive(spark):
    s = stats(spark, ("f", "focus time", "09:00", "10:00", None), ("a", "A", "09:00", "10:00", None), ("b", "B", "09:00", "10:00", None))
    assert (s.focus_hours_eroded, s.focus_hours_protected, s.meeting_count) == (2.0, 0.0, 2)


def test_each_pair_is_found_once_over_many_slots(spark):
    found = calendar_signals.focus_conflicts(events(
        spark, ("f", "Deep work", "09:10", "15:20", "CONFIRMED"), ("m", "Long", "08:05", "18:40", "CONFIRMED"),
        ("n", "Short", "09:05", "09:12", "CONFIRMED"), ("z", "Empty", "10:00", "10:00", "CONFIRMED")))
    assert [(r.meeting_uid, round(r.overlap_hours, 4)) for r in found.orderBy("meeting_uid").collect()] == [("m", 6.1667), ("n", 0.0333)]


def test_unconfirmed_events_are_listed_not_counted(spark):
    items = [("a", "1:1 Bo", "09:00", "10:00", "CONFIRMED"), ("b", "Board", "09:00", "10:00", "TENTATIVE"),
             ("c", "Lunch", "12:00", "13:00", None), ("d", "Gone", None, None, "CANCELLED"), ("e", "Open", "14:00", None, "CONFIRMED")]
    s = stats(spark, *items)
    assert (s.meeting_count, s.meeting_hours, s.declined_or_cancelled_count) == (2, 1.0, 2)
    assert s.meeting_hours_by_category == {"one_on_one": 1.0, "other": 0.0}
    assert rows(calendar_signals.declined_events(events(spark, *items)), "uid", "date", "status") == [
        ("b", DAY, "TENTATIVE"), ("d", "unknown", "CANCELLED")]


def test_back_to_back_looks_at_the_next_meeting_even_hours_later(spark):
    s = stats(spark, ("a", "A", "09:00", "10:00", None), ("b", "B", "10:00", "10:30", None), ("c", "C", "10:15", "14:00", None),
              ("d", "D", "13:00", "13:30", None), ("e", "E", "15:00", "16:00", None))
    assert s.back_to_back_count == 3


def mail(spark, *items):
    df = spark.createDataFrame(list(items), "from_hdr string, date_key string, subject string, body string")
    return df.select(F.lit("t").alias("tenant_id"), F.concat("date_key", F.lit("T09:00:00")).alias("date_iso"), "date_key", "from_hdr",
                     F.monotonically_increasing_id().cast("string").alias("filename"), "subject", "body")


def test_quiet_senders(spark):
    found = mail_signals.quiet_senders(mail(
        spark, ("Old Name <a@x>", "2024-05-01", "", ""), ("New <A@X>", "2024-05-02", "", ""), ("b@x.org", "2024-05-05", "", ""),
        ("c@x.org", "unknown", "", ""), ("Solo <s@x.org>", "2024-05-02", "", "")))
    # Addresses without a dot are still addresses; the earliest mail names the sender.
    assert {(r.email, r.name, r.email_count) for r in found.collect()} == {("a@x", "Old Name", 2), ("s@x.org", "Solo", 1)}


def test_day_mail_stats(spark):
    found = mail_signals.day_mail_stats(mail(
        spark, ("A <a@x.org>", DAY, "RE: x", "abc"), ("a@X.org", DAY, " Fwd: y", "ab"), ("b@x.org", DAY, "Reply", "")))
    assert one(found) == ("t", DAY, 3, 2, 2, 1, 2)  # 5 / 3 characters


def test_noise_filter_ignores_case_and_other_tenants(spark):
    emails = mail(spark, ("N <News@Junk.io>", DAY, "", ""), ("B <b@ok.org>", DAY, "", ""), ("c@JUNK.io", DAY, "", ""), ("nobody", DAY, "", ""))
    blocked = spark.createDataFrame([("t", "sender", "b@ok.org"), ("other", "domain", "junk.io")], "tenant_id string, kind string, value string")
    assert rows(mail_signals.drop_blocked(emails, blocked), "from_hdr") == [("N <News@Junk.io>",), ("c@JUNK.io",), ("nobody",)]
    mine = spark.createDataFrame([("t", "domain", "junk.io")], "tenant_id string, kind string, value string")
    assert rows(mail_signals.drop_blocked(emails, mine), "from_hdr") == [("B <b@ok.org>",), ("nobody",)]


def test_note_stats(spark):
    notes = spark.createDataFrame(
        [("t", "a.md", "2024-05-01", [("x", False), ("y", True)]), ("t", "b.md", "unknown", [("z", False)])],
        "tenant_id string, note_id string, created_at string, checklist_items array<struct<text:string,done:boolean>>"
    ).withColumn("date_key", F.col("created_at"))
    found = {r.note_id: r for r in note_signals.note_stats(notes, DAY).collect()}
    assert [tuple(i) for i in found["a.md"].stale_open_items] == [("x", 5)]
    assert (found["a.md"].checklist_open, found["a.md"].checklist_done) == (1, 1)
    assert (found["b.md"].checklist_open, found["b.md"].stale_open_items) == (1, [])


def tasks(spark, *items):
    return spark.createDataFrame(
        [("t", i, "Title " + i, st, p, due, cr, None, [("s", d) for d in subs] if subs is not None else None) for i, st, p, due, cr, subs in items],
        "tenant_id string, id string, title string, status string, priority string, due_date string, created_at string, blocked_by string, "
        "subtasks array<struct<title:string,done:boolean>>")


def test_task_buckets_and_edges(spark):
    found = task_signals.task_signals(tasks(
        spark, ("a", "todo", "P1", "2024-05-05", None, None), ("b", "done", "P0", "2024-05-01", "2024-01-01", []),
        ("c", None, None, "2024-05-13", None, None), ("d", "todo", "P9", "2024-05-14", None, None), ("e", "todo", "P0", DAY, None, None),
        ("f", "blocked", "P2", None, None, None), ("g", "in-progress", "P2", None, "2024-04-29T23:00:00-07:00", [True, False, False]),
        ("h", "todo", "P2", None, "2024-04-30", []), ("i", "todo", "P3", "2024-05-01", "2024-04-01", [True, True, False]),
        ("j", "todo", "P3", None, "2024-04-01", [True, False, False, False, False, False])), DAY)
    assert rows(found, "bucket", "id", "days") == sorted([
        ("overdue", "a", 1), ("overdue", "i", 5), ("due_soon", "c", 7), ("due_soon", "e", 0), ("blocked", "f", None),
        ("stalled", "g", 7), ("stalled", "j", 35)], key=repr)
    assert found.filter("id = 'j'").first().progress_ratio == 0.17
    assert found.filter("id = 'f'").first().blocked_by == "unspecified"
    assert [r.id for r in task_signals.ordered_signals(found.filter("bucket = 'due_soon'")).collect()] == ["e", "c"]
    flagged = task_signals.flagged_tasks(found.unionByName(found.limit(0)))
    assert flagged.count() == 7


def test_disagreement_needs_urgency_and_low_priority(spark):
    items = spark.createDataFrame([("a", "P4", DAY), ("b", "P4", "2024-05-08"), ("c", "P1", "2024-05-01"), ("d", None, "2024-05-01")],
                                  "id string, priority string, due_date string")
    found = task_signals.annotate_items(items, DAY)
    assert rows(found.filter("priority_disagreement"), "id", "date_urgency") == [("a", "due_today")]
