"""Tables as text. Each renderer yields line rows; `fold_lines` joins them in order.

Line rows carry what orders them, so a text is assembled without ever sorting a whole tenant in
one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksignal.functions.constants import EXCERPT_TEXT_CHARS
from worksignal.functions.dates import day_label
from worksignal.functions.payload import field, field_or, filled_field_or
from worksignal.functions.text import each, kept, not_blank
from worksignal.operators.ordered import fold_lines, fold_ordered, fold_runs, ordinal, range_buckets
from worksignal.operators.task_signals import priority_rank
from worksignal.schemas import COVERED_FACTS

_DAY = ["tenant_id", "date_key"]
_ISO = "yyyy-MM-dd'T'HH:mm:ss"


def _say(*parts) -> Column:
    """Concatenate columns and literal texts."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _text(col) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def _email_lines(emails: DataFrame) -> DataFrame:
    numbered = ordinal(
        emails, _DAY, F.substring("date_iso", 1, 16), [F.col("date_iso"), F.col("filename")]
    )
    line = _say(
        "--- Email ", F.col("ordinal").cast("string"), " ---\nFrom: ", _text("from_hdr"), "\nTo: ", _text("to_hdr"),
        "\nSubject: ", _text("subject"), "\nDate: ", _text("date_iso"), "\nThread: ", _text("thread_id"),
        "\nBody:\n", _text("body"), "\n",
    )
    return numbered.select(*_DAY, "ordinal", line.alias("line"))


def email_context(emails: DataFrame) -> DataFrame:
    """(tenant_id, date_key, text): a day's mail, numbered in order of time."""
    return fold_lines(_email_lines(emails), _DAY)


def email_pages(emails: DataFrame, size: int) -> DataFrame:
    """(tenant_id, date_key, run, text): a day's mail in pages of `size`, numbered through, pages from 0."""
    return fold_runs(_email_lines(emails), _DAY, size)


def event_context(events: DataFrame) -> DataFrame:
    """(tenant_id, date_key, text): a day's calendar events in order of start."""
    numbered = ordinal(
        events, _DAY, F.date_trunc("HOUR", F.col("start").cast("timestamp")),
        [F.col("start").asc_nulls_first(), F.col("uid")],
    )
    names = F.array_join(F.transform("attendees", lambda a: a["name"]), ", ")
    none = F.lit("none")
    line = _say(
        "--- Event ", F.col("ordinal").cast("string"), " ---\nSummary: ", _text("summary"),
        "\nStatus: ", _text("status"),
        "\nStart: ", F.coalesce(F.date_format("start", _ISO), F.lit("unknown")),
        "\nEnd: ", F.coalesce(F.date_format("end", _ISO), F.lit("unknown")),
        "\nLocation: ", F.coalesce(not_blank(F.col("location")), none),
        "\nAttendees: ", F.coalesce(not_blank(names), F.lit("none listed")),
        "\nDescription: ", F.coalesce(not_blank(F.col("description")), none), "\n",
    )
    return fold_lines(numbered.select(*_DAY, "ordinal", line.alias("line")), _DAY)


def note_context(notes: DataFrame, stats: DataFrame) -> DataFrame:
    """(tenant_id, note_id, text): a note with its checklist facts."""
    facts = stats.select(
        "tenant_id", "note_id",
        F.to_json(F.struct("checklist_open", "checklist_done", "stale_open_items")).alias("facts"),
    )
    text = _say(
        "Title: ", _text("title"), "\nCreated: ", _text("created_at"), "\nBody:\n", _text("body"),
        "\n\nPrecomputed checklist stats (ground truth, do not recompute):\n", F.col("facts"),
    )
    return notes.join(facts, ["tenant_id", "note_id"]).select("tenant_id", "note_id", text.alias("text"))


def _number(stats: Column, name: str, whole: bool = True) -> Column:
    value = F.coalesce(F.element_at(stats, name), F.lit(0.0))
    return value.cast("bigint").cast("string") if whole else value.cast("string")


def _stats_line(source: Column, stats: Column) -> Column:
    """The one-line summary of an entry's facts."""
    meetings = _number(stats, "meeting_count")
    hours = F.when(meetings == "0", F.lit("0")).otherwise(_number(stats, "meeting_hours", False))
    mail = _say(
        "- Senders: ", _number(stats, "unique_senders"), " unique | Replies: ", _number(stats, "reply_count"),
        " | New threads: ", _number(stats, "new_thread_count"),
        " | Avg body length: ", _number(stats, "avg_body_chars"), " chars",
    )
    calendar = _say(
        "- Meetings: ", meetings, " (", hours, "h) | Focus time protected: ",
        _number(stats, "focus_hours_protected", False), "h, eroded: ", _number(stats, "focus_hours_eroded", False),
        "h | Back-to-back: ", _number(stats, "back_to_back_count"),
        " | Declined/cancelled: ", _number(stats, "declined_or_cancelled_count"),
    )
    notes = _say("- Checklist: ", _number(stats, "checklist_open"), " open, ", _number(stats, "checklist_done"), " done")
    return F.when(source == "email", mail).when(source == "calendar", calendar).when(source == "notes", notes)


def _item_line(source: Column, section: Column, category: Column, payload: Column) -> Column:
    """One item's line, NULL for categories that are not shown."""
    def tagged(word, text):
        return _say(f"- {word} [", field_or(payload, "priority", "?"), "]: ", text)

    described = field_or(payload, "description", "None")
    subject = field_or(payload, "source_subject", "")
    summary = field_or(payload, "summary", "None")
    deadline = _say(tagged("DEADLINE", described), " (date: ", filled_field_or(payload, "date", "unspecified"), ", from: ", subject, ")")
    decision = _say(tagged("DECISION", described), " (from: ", subject, ")")
    action = _say(tagged("ACTION", described), " (owner: ", filled_field_or(payload, "owner", "unspecified"), ", from: ", subject, ")")
    thread = _say("- THREAD '", field_or(payload, "thread", "None"), "': ", field_or(payload, "progression", "None"))
    relevant = _say(tagged("STILL RELEVANT", field_or(payload, "text", "None")), " — ", field_or(payload, "why", ""))
    shown = {
        ("email", "deadlines"): deadline,
        ("email", "decisions"): decision,
        ("email", "action_items"): action,
        ("email", "thread_progressions"): thread,
        ("calendar", "meetings_needing_prep"): _say("- PREP NEEDED: ", summary, " — ", field_or(payload, "why", "")),
        ("calendar", "family_calendar_items"): _say("- FAMILY: ", summary, " — ", field_or(payload, "note", "")),
        ("calendar", "pattern_flags"): _say("- PATTERN: ", described),
        ("calendar", "notable_events"): _say("- NOTABLE: ", summary, " — ", field_or(payload, "why_notable", "")),
        ("notes", "decisions"): tagged("DECISION", described),
        ("notes", "open_items_still_relevant"): relevant,
        ("notes", "key_people"): _say("- PEOPLE: ", field_or(payload, "name", "None"), " — ", field_or(payload, "context", "")),
        ("calendar", "deep_work_conflicts"): _say(
            "  - DEEP WORK CONFLICT: '", field_or(payload, "summary", ""), "' at ", field_or(payload, "start", ""),
            " (", field_or(payload, "overlap_hours", "0.0"), "h overlap)"),
        ("calendar", "declined_or_cancelled"): _say(
            "  - DECLINED/CANCELLED: '", field_or(payload, "summary", ""), "' on ", field_or(payload, "date", "")),
        ("notes", "stale_open_items"): _say(
            "  - OPEN ", field_or(payload, "days_open", "0"), "d: ", field_or(payload, "text", "")),
        ("notes", "note_type"): _say("- Type: ", payload),
    }
    line = F.lit(None).cast("string")
    for (kind, name), text in shown.items():
        line = F.when((source == kind) & (category == name), text).otherwise(line)
    return line


_CATEGORY_ORDER = (
    "deep_work_conflicts", "declined_or_cancelled", "stale_open_items", "note_type",
    "deadlines", "decisions", "action_items", "thread_progressions",
    "meetings_needing_prep", "family_calendar_items", "pattern_flags", "notable_events",
    "open_items_still_relevant", "key_people",
)


def ledger_lines(entries: DataFrame, items: DataFrame, cover: DataFrame | None = None, reference_date=None) -> DataFrame:
    """(tenant_id, source, sort_day, entry_key, part, place, line) of a whole ledger.

    With a reference day each daily entry says how old it is.
    """
    keys = ["tenant_id", "source", "entry_key"]
    base = entries.select(*keys, "sort_day", "day", "note_id", "item_count", "stats", "hot", "compacted")
    rolled = F.coalesce("compacted", F.lit(False))
    aged = F.col("day") if reference_date is None else _say(F.col("day"), " (", day_label(F.col("day"), reference_date), ")")
    label = F.when(rolled, _say("Week of ", F.col("day"))).otherwise(aged)
    hot = F.when(F.coalesce("hot", F.lit(False)), F.lit(" [JUST ARRIVED]")).otherwise(F.lit(""))
    note = F.when(rolled, F.lit("")).otherwise(_say(" — ", _text("note_id")))
    unit = F.when(F.col("source") == "email", F.lit(" emails)")).otherwise(F.lit(" events)"))
    header = F.when(F.col("source") == "notes", _say("### ", label, note)).otherwise(
        _say("### ", label, " (", F.coalesce("item_count", F.lit(0)).cast("string"), unit, hot)
    )

    def rows(df, part, place, line):
        return df.select(*keys, "sort_day", F.lit(part).alias("part"), place.alias("place"), line.alias("line"))

    def fixed(part, line):
        return F.struct(F.lit(part).alias("part"), F.lit("").alias("place"), line.alias("line"))

    first, facts, last = fixed(0, header), fixed(1, _stats_line(F.col("source"), F.col("stats"))), fixed(9, F.lit(""))
    own = F.when(F.col("stats").isNull(), F.array(first, last)).otherwise(F.array(first, facts, last))
    parts = [base.select(*keys, "sort_day", each(own).alias("own")).select(*keys, "sort_day", "own.*")]
    order = F.array_position(F.array(*[F.lit(c) for c in _CATEGORY_ORDER]), F.col("category"))
    within = F.concat(F.lpad(order.cast("string"), 3, "0"), F.lit("|"), F.lpad(F.col("ordinal").cast("string"), 20, "0"))
    of_day = F.col("section").startswith(COVERED_FACTS)
    line = _item_line(F.col("source"), F.col("section"), F.col("category"), F.col("payload"))
    said = items.withColumn("line", kept(line, lambda text: text.isNotNull())).filter("line IS NOT NULL")
    if cover is not None:
        covered = cover.join(base.select(*keys, "sort_day"), keys)
        # Below every character of a day or note, so that a unit's lines stay together.
        place = F.concat_ws("\u0001", "day", "note_id")
        parts.append(rows(covered.filter("note_id IS NOT NULL"), 2, F.col("note_id"), _say("  Note covered: ", F.col("note_id"))))
        daily = covered.filter("stats IS NOT NULL")
        parts.append(rows(daily, 3, place, _say("  ", F.col("day"), ":\n  ", _stats_line(F.col("source"), F.col("stats")))))
        details = said.filter(of_day).withColumn("unit", F.substring("section", len(COVERED_FACTS) + 1, 1 << 30))
        whose = covered.select(*keys, "sort_day", F.when(F.col("source") == "notes", F.col("note_id")).otherwise(F.col("day")).alias("unit"), place.alias("whose"))
        parts.append(rows(details.join(whose, [*keys, "unit"]), 3, F.concat_ws("\u0001", "whose", F.lit(""), within), _say("  ", F.col("line"))))
    shown = said.filter(~of_day).join(base.select(*keys, "sort_day"), keys)
    parts.append(rows(shown, 4, within, F.col("line")))
    return reduce(DataFrame.unionByName, parts)


def ledger_text(lines: DataFrame) -> DataFrame:
    """(tenant_id, source, text) of ledger lines in chronological order."""
    keys = ["tenant_id", "source"]
    order = [F.col("sort_day").asc_nulls_last(), F.col("entry_key"), F.col("part"), F.col("place"), F.col("line")]
    # Unknown days sort last, so the bucket puts them behind every real day.
    bucket = F.struct(F.coalesce("sort_day", F.lit("9999-12-31").cast("date")), "entry_key")
    return fold_ordered(lines, keys, bucket, order)


def staleness_lines(quiet: DataFrame) -> DataFrame:
    line = _say(
        "- ", F.col("name"), " <", F.col("email"), ">: last heard from ", F.col("last_seen"), " (",
        F.col("days_since_last_contact").cast("string"), " days ago), ", F.col("email_count").cast("string"),
        " emails total in this window (first: ", F.col("first_seen"), ")",
    )
    return quiet.select("tenant_id", (-F.col("days_since_last_contact")).cast("bigint").alias("rank"),
                        F.col("email").alias("place"), line.alias("line"))


_BUCKET_TITLES = {
    "overdue": "OVERDUE:",
    "due_soon": "DUE SOON (within 7 days):",
    "blocked": "BLOCKED:",
    "stalled": "STALLED (open a while, little progress):",
}


def signal_lines(signals: DataFrame) -> DataFrame:
    """Lines of task signals per bucket, each non-empty bucket under its title."""
    days = F.col("days").cast("string")
    done = _say(F.col("subtasks_done").cast("string"), "/", F.col("subtasks_total").cast("string"), " subtasks")
    head = _say("  - [", F.col("priority"), "] ", F.col("id"), " ", F.col("title"), " — ")
    percent = F.floor(F.col("progress_ratio") * 100).cast("string")
    line = (
        F.when(F.col("bucket") == "overdue", _say(head, days, "d overdue (due ", _text("due_date"), "), ", done, " done"))
        .when(F.col("bucket") == "due_soon", _say(head, "due in ", days, "d (", _text("due_date"), ")"))
        .when(F.col("bucket") == "blocked", _say(
            head, "blocked ", F.coalesce(_say(days, "d"), F.lit("unknown duration")), ": ", _text("blocked_by")))
        .otherwise(_say(head, "open ", days, "d, ", done, " (", F.coalesce(percent, F.lit("0")), "%)"))
    )
    place = F.array_position(F.array(*[F.lit(b) for b in _BUCKET_TITLES]), F.col("bucket"))
    urgency = F.when(F.col("bucket") == "due_soon", F.coalesce("days", F.lit(0))).otherwise(-F.coalesce("days", F.lit(0)))
    # Bucket, priority and urgency as one rising number.
    rank = (place * 1000 + priority_rank(F.col("priority")) + 1) * F.lit(10000000).cast("bigint") + urgency
    titles = F.create_map(*[F.lit(x) for pair in _BUCKET_TITLES.items() for x in pair])
    headers = signals.select("tenant_id", "bucket").distinct().select(
        "tenant_id", (place * F.lit(10000000000).cast("bigint")).alias("rank"), F.lit("").alias("place"),
        F.element_at(titles, F.col("bucket")).alias("line"),
    )
    body = signals.select("tenant_id", rank.alias("rank"), F.col("id").alias("place"), line.alias("line"))
    return headers.unionByName(body)


def mention_lines(mentions: DataFrame) -> DataFrame:
    """Lines of the cross-reference index: each task, then its mentions."""
    task = F.col("task_id")
    kinds = F.array(F.lit("email"), F.lit("calendar"), F.lit("notes"))
    heads = mentions.groupBy("tenant_id", "task_id").agg(F.min("title").alias("title"), F.min("priority").alias("priority"))
    head = _say("- ", task, ": ", F.col("title"), " (priority ", F.col("priority"), ")")
    body = _say("    [", F.col("source"), ", ", F.col("day"), "] ", F.substring("excerpt", 1, EXCERPT_TEXT_CHARS))
    zero = F.lit(0).cast("bigint")
    return heads.select("tenant_id", zero.alias("rank"), F.concat(task, F.lit("|0")).alias("place"), head.alias("line")).unionByName(
        mentions.select(
            "tenant_id", zero.alias("rank"),
            F.concat_ws("|", task, F.array_position(kinds, F.col("source")).cast("string"), "day").alias("place"),
            body.alias("line"),
        )
    )


def contradiction_lines(contradictions: DataFrame) -> DataFrame:
    line = _say("- ", F.col("entity"), " (", F.array_join("sources", ", "), "): ", F.col("description"))
    return contradictions.select(
        "tenant_id", F.lit(0).cast("bigint").alias("rank"), F.col("claim_id").alias("place"), line.alias("line")
    )


def freshness_lines(fresh: DataFrame) -> DataFrame:
    """Freshness as indented JSON lines, one per source."""
    body = F.to_json(F.struct("most_recent_day", "days_stale", "is_stale"), {"ignoreNullFields": "false"})
    return fresh.select(
        "tenant_id", F.lit(0).cast("bigint").alias("rank"), F.col("source").alias("place"),
        _say('  "', F.col("source"), '": ', body).alias("line"),
    )


def or_sentence(lines: DataFrame, tenants: DataFrame, sentence: str) -> DataFrame:
    """Lines, and the fixed sentence for tenants that have none."""
    empty = tenants.select("tenant_id").distinct().join(lines.select("tenant_id").distinct(), "tenant_id", "left_anti")
    return lines.unionByName(
        empty.select("tenant_id", F.lit(0).cast("bigint").alias("rank"), F.lit("").alias("place"), F.lit(sentence).alias("line"))
    )


NO_QUIET_SENDERS = "(No senders with an established thread have gone quiet.)"
NO_SIGNALS = "(No overdue, due-soon, blocked, or stalled tasks.)"
NO_MENTIONS = "(none — no flagged tasks found mentioned in multiple sources)"
NO_CONTRADICTIONS = "(none detected)"


def lines_text(lines: DataFrame) -> DataFrame:
    """(tenant_id, text) of (tenant_id, rank, place, line) rows."""
    order = [F.col("rank"), F.col("place"), F.col("line")]
    ranged = range_buckets(lines, ["tenant_id", "rank", "place", "line"])
    ordered = ordinal(ranged, ["tenant_id"], F.col("range_bucket"), order)
    return fold_lines(ordered, ["tenant_id"])
