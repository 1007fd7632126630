"""Facts computed from calendar events: overlaps, back-to-back meetings, hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksignal.functions.constants import (
    CEREMONY_WORDS,
    EXTERNAL_WORDS,
    FOCUS_WORDS,
    LUNCH_WORDS,
    MEETING_CATEGORIES,
    ONE_ON_ONE_WORDS,
)
from worksignal.functions.dates import as_hours, micros_between, rounded
from worksignal.functions.text import any_of
from worksignal.operators.ordered import next_value

_DAY = ["tenant_id", "date_key"]
_SLOT_SECONDS = 900


def meeting_category(summary: Column) -> Column:
    return (
        F.when(any_of(summary, ONE_ON_ONE_WORDS), F.lit("one_on_one"))
        .when(any_of(summary, EXTERNAL_WORDS), F.lit("external"))
        .when(any_of(summary, CEREMONY_WORDS), F.lit("internal_ceremony"))
        .otherwise(F.lit("other"))
    )


def classified(events: DataFrame) -> DataFrame:
    """Events with `kind`: declined, focus, lunch or meeting; anything not CONFIRMED is declined."""
    kind = (
        F.when(F.coalesce("status", F.lit("CONFIRMED")) != "CONFIRMED", F.lit("declined"))
        .when(any_of(F.col("summary"), FOCUS_WORDS), F.lit("focus"))
        .when(any_of(F.col("summary"), LUNCH_WORDS), F.lit("lunch"))
        .otherwise(F.lit("meeting"))
    )
    return events.withColumn("kind", kind).withColumn("micros", micros_between(F.col("start"), F.col("end")))


def _slots(start: Column, end: Column) -> Column:
    """Numbers of the time slots an interval touches in the day from its start on.

    Two intervals that start on one day begin to overlap within it.
    """
    first = F.floor(F.unix_micros(start.cast("timestamp")) / (_SLOT_SECONDS * 1000000))
    last = F.floor((F.unix_micros(end.cast("timestamp")) - 1) / (_SLOT_SECONDS * 1000000))
    return F.sequence(first, F.least(F.greatest(first, last), first + 86400 // _SLOT_SECONDS))


def focus_conflicts(events: DataFrame) -> DataFrame:
    """Every confirmed meeting overlapping a confirmed focus block of its day.

    Both sides are laid out over quarter-hour slots and joined on the slot, so a crowded day is
    spread over its slots. A pair meeting in several slots counts in the one it begins in.
    """
    timed = classified(events).filter(F.col("start") < F.col("end"))
    slotted = timed.withColumn("slot", F.explode(_slots(F.col("start"), F.col("end"))))
    focus = slotted.filter("kind = 'focus'").select(
        *_DAY, "slot", F.col("uid").alias("focus_uid"), F.col("start").alias("fs"), F.col("end").alias("fe")
    )
    meetings = slotted.filter("kind = 'meeting'").select(
        *_DAY, "slot", F.col("uid").alias("meeting_uid"), "summary",
        F.col("start").alias("ms"), F.col("end").alias("me"),
    )
    both_start = F.greatest("fs", "ms")
    begins_here = F.floor(F.unix_micros(both_start.cast("timestamp")) / (_SLOT_SECONDS * 1000000)) == F.col("slot")
    pairs = focus.join(meetings, [*_DAY, "slot"]).filter(
        (F.col("fs") < F.col("me")) & (F.col("ms") < F.col("fe")) & begins_here
    )
    return pairs.select(
        *_DAY,
        "focus_uid",
        "meeting_uid",
        "summary",
        F.col("ms").alias("start"),
        micros_between(both_start, F.least("fe", "me")).alias("overlap_micros"),
    ).withColumn("overlap_hours", as_hours(F.col("overlap_micros")))


def back_to_back(events: DataFrame) -> DataFrame:
    """(tenant_id, date_key, back_to_back_count): meetings starting before the one ahead has ended."""
    meetings = classified(events).filter("kind = 'meeting' AND start IS NOT NULL AND end IS NOT NULL")
    following = next_value(
        meetings.select(*_DAY, "uid", "start", "end"),
        _DAY,
        F.date_trunc("HOUR", F.col("start").cast("timestamp")),
        [F.col("start"), F.col("uid")],
        "start",
        "next_start",
    )
    return following.groupBy(*_DAY).agg(
        F.count_if(F.col("next_start") <= F.col("end")).alias("back_to_back_count")
    )


def declined_events(events: DataFrame) -> DataFrame:
    declined = classified(events).filter("kind = 'declined'")
    return declined.select(
        *_DAY, "uid", "summary",
        F.coalesce(F.date_format("start", "yyyy-MM-dd"), F.lit("unknown")).alias("date"), "status",
    )


def day_calendar_stats(events: DataFrame) -> DataFrame:
    """One row of facts per tenant and day, hours to two places.

    The day's conflicts and declined events are rows of their own (`focus_conflicts`,
    `declined_events`), not arrays.
    """
    kinds = classified(events)
    meeting, focus = F.col("kind") == "meeting", F.col("kind") == "focus"
    category = meeting_category(F.col("summary"))
    base = kinds.groupBy(*_DAY).agg(
        F.count("*").alias("event_count"),
        F.count_if(meeting).alias("meeting_count"),
        F.coalesce(F.sum(F.when(meeting, F.col("micros"))), F.lit(0)).alias("meeting"),
        F.coalesce(F.sum(F.when(focus, F.col("micros"))), F.lit(0)).alias("focus"),
        F.count_if(F.col("kind") == "declined").alias("declined_or_cancelled_count"),
        *[F.sum(F.when(meeting & (category == c), F.col("micros"))).alias(f"in_{c}") for c in MEETING_CATEGORIES],
    )
    eroded = focus_conflicts(events).groupBy(*_DAY).agg(F.sum("overlap_micros").alias("eroded"))
    joined = base.join(eroded, _DAY, "left").join(back_to_back(events), _DAY, "left")
    lost = F.coalesce("eroded", F.lit(0))
    by_category = F.map_filter(
        F.create_map(*[x for c in MEETING_CATEGORIES for x in (F.lit(c), rounded(as_hours(F.col(f"in_{c}"))))]),
        lambda _, hours: hours.isNotNull(),
    )
    return joined.select(
        *_DAY,
        "event_count",
        "meeting_count",
        rounded(as_hours(F.col("meeting"))).alias("meeting_hours"),
        rounded(as_hours(F.col("focus"))).alias("focus_hours_scheduled"),
        rounded(as_hours(F.greatest(F.lit(0), F.col("focus") - lost))).alias("focus_hours_protected"),
        rounded(as_hours(lost)).alias("focus_hours_eroded"),
        F.coalesce("back_to_back_count", F.lit(0)).cast("bigint").alias("back_to_back_count"),
        "declined_or_cancelled_count",
        by_category.alias("meeting_hours_by_category"),
    )
