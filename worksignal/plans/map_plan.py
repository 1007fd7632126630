"""From source rows to ledger rows: select new units, compute facts, ask the model, accept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksignal.functions.constants import MAP_SCHEMAS, SOURCES
from worksignal.functions.dates import rounded, sort_day
from worksignal.functions.payload import leaf_text
from worksignal.operators import calendar_signals, days, mail_signals, note_signals, rendering
from worksignal.operators.ordered import fold_lines, ordinal
from worksignal.plans import model_stage
from worksignal.session import settle

_DAY = ["tenant_id", "date_key"]
PAGE_MAILS = 1000


def new_days(
    items: DataFrame, processed: DataFrame, source: str,
    digest_days: int | None = None, holdout_days: int | None = None, reprocess_hot: bool = False,
) -> DataFrame:
    """(tenant_id, date_key, item_count, hot) of the days to process now.

    By default a day the ledger has is left alone, even when late items arrive for it.
    """
    batches = days.windowed_days(days.day_batches(items), digest_days, holdout_days).filter("NOT held_out").drop("held_out")
    if reprocess_hot:
        return days.unprocessed_or_hot(batches, processed, source)
    return days.unprocessed(batches, processed, source)


def _as_map(columns: list[str]) -> Column:
    return F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])


_MAIL = ["unique_senders", "reply_count", "new_thread_count", "avg_body_chars"]
_CALENDAR = [
    "meeting_count", "meeting_hours", "focus_hours_scheduled", "focus_hours_protected",
    "focus_hours_eroded", "back_to_back_count", "declined_or_cancelled_count",
]


def mail_facts(emails: DataFrame) -> DataFrame:
    """(tenant_id, unit_key, item_count, stats)."""
    stats = mail_signals.day_mail_stats(emails)
    return stats.select("tenant_id", F.col("date_key").alias("unit_key"), F.col("email_count").alias("item_count"),
                        _as_map(_MAIL).alias("stats"))


def calendar_facts(events: DataFrame) -> DataFrame:
    stats = calendar_signals.day_calendar_stats(events)
    return stats.select("tenant_id", F.col("date_key").alias("unit_key"), F.col("event_count").alias("item_count"),
                        _as_map(_CALENDAR).alias("stats"))


def note_facts(stats: DataFrame) -> DataFrame:
    return stats.select(
        "tenant_id", F.col("note_id").alias("unit_key"),
        (F.col("checklist_open") + F.col("checklist_done")).alias("item_count"),
        _as_map(["checklist_open", "checklist_done"]).alias("stats"),
    )


def _fact_items(rows: DataFrame, source: str, unit: str, category: str, place: Column, fields: list[Column]) -> DataFrame:
    payload = F.to_json(F.struct(*fields))
    return rows.select(
        "tenant_id", F.lit(source).alias("source"), F.col(unit).alias("entry_key"), F.lit("stats").alias("section"),
        F.lit(category).alias("category"), place.cast("bigint").alias("ordinal"), payload.alias("payload"),
        leaf_text(payload).alias("text"),
    )


def calendar_fact_items(events: DataFrame) -> DataFrame:
    """A day's conflicts and declined events as ledger items."""
    iso = F.date_format("start", "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(F.col("start").cast("timestamp"))
    conflicts = _fact_items(
        calendar_signals.focus_conflicts(events), "calendar", "date_key", "deep_work_conflicts", micros,
        [F.col("summary"), iso.alias("start"), rounded(F.col("overlap_hours")).alias("overlap_hours")],
    )
    declined = _fact_items(
        calendar_signals.declined_events(events), "calendar", "date_key", "declined_or_cancelled",
        F.abs(F.xxhash64("uid")), [F.col("summary"), F.col("date"), F.col("status")],
    )
    return conflicts.unionByName(declined)


def note_fact_items(stats: DataFrame) -> DataFrame:
    open_items = stats.select("tenant_id", "note_id", F.posexplode("stale_open_items").alias("pos", "item"))
    return _fact_items(
        open_items, "notes", "note_id", "stale_open_items", F.col("pos"),
        [F.col("item.text").alias("text"), F.col("item.days_open").alias("days_open")],
    )


def mail_units(emails: DataFrame, todo: DataFrame, page_mails: int = PAGE_MAILS) -> DataFrame:
    """Request units of the days to process, days of more than `page_mails` in pages."""
    context = rendering.email_pages(days.of_days(emails, todo), page_mails)
    text = F.concat(F.lit("Emails for "), F.col("date_key"), F.lit(":\n\n"), F.col("text"))
    return context.select("tenant_id", model_stage.page_key(F.col("date_key"), F.col("run")).alias("unit_key"), text.alias("user_text"))


def calendar_units(events: DataFrame, todo: DataFrame, facts: DataFrame) -> DataFrame:
    context = rendering.event_context(days.of_days(events, todo)).withColumnRenamed("date_key", "unit_key")
    text = F.concat(
        F.lit("Calendar events for "), F.col("unit_key"), F.lit(":\n\n"), F.col("text"),
        F.lit("\n\nPrecomputed stats (ground truth, do not recompute):\n"), F.to_json("stats"),
    )
    return context.join(facts, ["tenant_id", "unit_key"]).select("tenant_id", "unit_key", text.alias("user_text"))


def note_units(notes: DataFrame, stats: DataFrame) -> DataFrame:
    context = rendering.note_context(notes, stats)
    return context.select("tenant_id", F.col("note_id").alias("unit_key"), F.col("text").alias("user_text"))


def accept(
    responses: DataFrame, facts: DataFrame, source: str, variant: str,
    unit_days: DataFrame, fact_items: DataFrame | None = None, page: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, items, rejected) of a source's responses.

    `unit_days` gives (tenant_id, unit_key, day, note_id, hot). Only accepted units enter the ledger. With `page`, units were
    asked in pages of so many items.
    """
    accepted, rejected = model_stage.check(responses, MAP_SCHEMAS[(source, variant)])
    if page is not None:
        pages = facts.select("tenant_id", "unit_key", F.ceil(F.col("item_count") / page).alias("n_pages"))
        accepted, rejected = model_stage.whole_units(accepted, rejected, pages)
    keys = ["tenant_id", "unit_key"]
    done = accepted.select(*keys) if page is None else accepted.select(*keys).distinct()
    entries = done.join(facts, keys).join(unit_days, keys).select(
        "tenant_id", F.lit(source).alias("source"), F.col("unit_key").alias("entry_key"), "day", "note_id",
        F.col("item_count").cast("bigint").alias("item_count"), "stats", F.lit(variant).alias("map_variant"),
        "hot", F.lit(False).alias("compacted"), sort_day(F.col("day"), F.lit(False)).alias("sort_day"),
    )
    extracted = model_stage.payload_items(accepted).select(
        "tenant_id", F.lit(source).alias("source"), F.col("unit_key").alias("entry_key"), F.lit("delta").alias("section"),
        "category", "ordinal", "payload", "text",
    )
    parts = [extracted]
    if fact_items is not None:
        mine = done.select("tenant_id", F.col("unit_key").alias("entry_key"))
        parts.append(fact_items.join(mine, ["tenant_id", "entry_key"], "left_semi"))
    return entries, reduce(DataFrame.unionByName, parts), rejected


def _told(reqs: DataFrame, answer, source: str, variant: str) -> DataFrame:
    return model_stage.ask(reqs, answer, fits=model_stage.satisfies(MAP_SCHEMAS[(source, variant)]))


def day_units(todo: DataFrame) -> DataFrame:
    return todo.select("tenant_id", F.col("date_key").alias("unit_key"), F.col("date_key").alias("day"),
                       F.lit(None).cast("string").alias("note_id"), "hot")


def note_day_units(notes: DataFrame) -> DataFrame:
    return notes.select("tenant_id", F.col("note_id").alias("unit_key"), F.col("created_at").alias("day"),
                        "note_id", F.lit(False).alias("hot"))


def readable(rows: DataFrame) -> DataFrame:
    """Rows that could be read; `quarantined` in the sources tells of the others."""
    return rows.filter("parse_error IS NULL") if "parse_error" in rows.columns else rows


def map_mail(emails, processed, answer, system_text="", variant="persona", blocked=None, page_mails=PAGE_MAILS, **window):
    """The mail map stage from rows to (entries, items, rejected).

    A day of more than `page_mails` is asked in pages, so no request grows with a day's mail.

    Mail that could not be read and, with `blocked` (tenant_id, kind, value), mail of blocked
    senders is left out first.
    """
    emails = readable(emails)
    if blocked is not None:
        emails = mail_signals.drop_blocked(emails, blocked)
    todo = settle(new_days(emails, processed, "email", **window))
    reqs = model_stage.requests(mail_units(emails, todo, page_mails), "email", system_text)
    facts = settle(mail_facts(days.of_days(emails, todo)))
    return accept(_told(reqs, answer, "email", variant), facts, "email", variant, day_units(todo), page=page_mails)


def map_calendar(events, processed, answer, system_text="", variant="persona", **window):
    events = readable(events)
    todo = settle(new_days(events, processed, "calendar", **window))
    chosen = days.of_days(events, todo)
    facts = settle(calendar_facts(chosen))
    reqs = model_stage.requests(calendar_units(events, todo, facts), "calendar", system_text)
    return accept(_told(reqs, answer, "calendar", variant), facts, "calendar", variant, day_units(todo), calendar_fact_items(chosen))


def map_notes(notes, processed, answer, reference_date, system_text="", variant="persona"):
    todo = days.unprocessed(notes, processed, "notes", "note_id")
    stats = note_signals.note_stats(todo, reference_date)
    reqs = model_stage.requests(note_units(todo, stats), "notes", system_text)
    return accept(_told(reqs, answer, "notes", variant), note_facts(stats), "notes", variant, note_day_units(todo), note_fact_items(stats))


# --- rolling weeks up by model ---


def week_units(stale: DataFrame, items: DataFrame, opened: DataFrame | None = None) -> DataFrame:
    """One request unit for each stale (tenant, source, week): its extracted items, day by day.

    `stale` is from `split_by_age`, `opened` from `opened_weeks`: what such a week held comes after its late
    days. The unit's key is the source and the week.
    """
    keys = ["tenant_id", "source", "week"]
    units = stale.select("tenant_id", "source", "entry_key", "week", "day")
    if opened is not None:
        units = units.unionByName(opened.select("tenant_id", "source", "entry_key", "week", "day"))
    weekly = items.filter("section = 'delta'").join(units, ["tenant_id", "source", "entry_key"])
    order = [F.col("day"), F.col("entry_key"), F.col("category"), F.col("ordinal"), F.col("payload")]
    numbered = ordinal(weekly, keys, F.struct("day", "entry_key", "category"), order)
    line = F.concat_ws(" ", F.col("day"), F.concat("category", F.lit(":")), F.col("payload"))
    text = fold_lines(numbered.withColumn("line", line), keys)
    return text.select(
        "tenant_id", F.concat_ws("|", "source", "week").alias("unit_key"),
        F.concat(F.lit("Items of week "), F.col("week"), F.lit(":\n\n"), F.col("text")).alias("user_text"),
    )


def merged_weeks(
    stale: DataFrame, items: DataFrame, answer, system_text="", variant="persona", opened: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(week_items, rejected): a model's merged items for `compact`. A rejected week keeps its days."""
    accepted, rejected = [], []
    units = settle(week_units(stale, items, opened))
    for source in SOURCES[:3]:
        own = units.filter(F.col("unit_key").startswith(f"{source}|"))
        good, bad = model_stage.ask_and_check(model_stage.requests(own, "weeks", system_text), answer, MAP_SCHEMAS[(source, variant)])
        accepted.append(model_stage.payload_items(good))
        rejected.append(bad)
    found = reduce(DataFrame.unionByName, accepted)
    return found.select(
        "tenant_id", F.substring_index("unit_key", "|", 1).alias("source"), F.substring_index("unit_key", "|", -1).alias("entry_key"),
        F.lit("delta").alias("section"), "category", "ordinal", "payload", "text",
    ), reduce(DataFrame.unionByName, rejected)
