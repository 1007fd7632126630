"""Rolling old ledger entries up into ISO weeks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksignal.functions.constants import RETENTION_DAYS
from worksignal.functions.dates import as_date, iso_week, sort_day, strict_day
from worksignal.functions.payload import field
from worksignal.schemas import COVERED_FACTS

_WEEK = ["tenant_id", "source", "week"]
_UNIT = ["tenant_id", "source", "entry_key"]
#: Places of a day's items within its week.
_DAY_PLACES = 1 << 40


def split_by_age(entries: DataFrame, reference_date, retention_days: int = RETENTION_DAYS) -> tuple[DataFrame, DataFrame]:
    """(kept, stale): stale are daily entries strictly older than the retention.

    Weeks already rolled up and entries whose day is no date are kept as they are.
    """
    cutoff = F.date_sub(as_date(reference_date), retention_days)
    day = strict_day(F.col("day"))
    old = ~F.coalesce("compacted", F.lit(False)) & F.coalesce(day < cutoff, F.lit(False))
    return entries.filter(~old), entries.filter(old).withColumn("week", iso_week(day))


def opened_weeks(kept: DataFrame, stale: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, opened): opened are the weeks rolled up before to which stale days belong, with their `week`.

    Days of one week grow stale one after the other, so a week is opened as often as it has days.
    """
    due = stale.select(*_WEEK).distinct()
    named = kept.withColumn("week", F.when(F.coalesce("compacted", F.lit(False)), F.col("entry_key")))
    return named.join(due, _WEEK, "left_anti").drop("week"), named.join(due, _WEEK, "left_semi")


def _of(items: DataFrame, units: DataFrame) -> DataFrame:
    """Items of the units (days, notes or opened weeks), with their unit's week and day."""
    return items.join(units.select(*_UNIT, "week", "day"), _UNIT)


def merged_items(stale: DataFrame, items: DataFrame, opened: DataFrame | None = None) -> DataFrame:
    """Each week's extracted items, merged without a model.

    Items alike in category and text become one, the first of the week; P0 and P1 items stay individually,
    since their recurrence is a signal. Merging is a grouping, so a week of any size is spread by
    text. What an opened week holds is merged with its late days' items: the place of an item in its
    week tells its day, so merging in steps gives what merging at once does.
    """
    # Order within a week follows the day and the item's own place.
    place = F.datediff(strict_day(F.col("day")), F.lit("1970-01-01").cast("date")) * F.lit(_DAY_PLACES).cast("bigint") + F.col("ordinal")
    weekly = _of(items.filter("section = 'delta'"), stale).withColumn("ordinal", place)
    if opened is not None:
        weekly = weekly.unionByName(_of(items.filter("section = 'delta'"), opened))
    important = F.coalesce(field(F.col("payload"), "priority").isin("P0", "P1"), F.lit(False))
    common = weekly.filter(~important).groupBy(*_WEEK, "category", "text").agg(F.min(F.struct("ordinal", "payload")).alias("first"))
    both = common.select(*_WEEK, "category", "text", "first.ordinal", "first.payload").unionByName(
        weekly.filter(important).select(*_WEEK, "category", "text", "ordinal", "payload")
    )
    return both.select(
        "tenant_id", "source", F.col("week").alias("entry_key"), F.lit("delta").alias("section"), "category", "ordinal", "payload", "text"
    )


def covered_facts(stale: DataFrame, items: DataFrame) -> DataFrame:
    """The details of each day's or note's facts, under its week; the section tells whose they are."""
    section = F.concat(F.lit(COVERED_FACTS), F.col("entry_key"))
    facts = _of(items.filter("section = 'stats'"), stale).withColumn("section", section)
    return facts.select("tenant_id", "source", F.col("week").alias("entry_key"), "section", "category", "ordinal", "payload", "text")


def compact(
    entries: DataFrame,
    items: DataFrame,
    reference_date,
    retention_days: int = RETENTION_DAYS,
    week_items: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, items, cover) after the roll-up.

    A week that was rolled up before and has late days now is opened, merged with them and replaced, so
    any sequence of roll-ups leaves one entry a week, and without a model the same entries and items as one
    roll-up at its end.

    `week_items` are a model's merged items, keyed by week in `entry_key`; they stand for all of the week,
    what was rolled up before included. A week it has no row for keeps what it has. Without it every
    stale week is merged by `merged_items`. Counts are conserved, and `cover` keeps each newly covered
    day's or note's key and facts.
    """
    kept, stale = split_by_age(entries, reference_date, retention_days)
    if week_items is not None:
        answered = week_items.select("tenant_id", "source", F.col("entry_key").alias("week")).distinct()
        kept = kept.unionByName(stale.join(answered, _WEEK, "left_anti").drop("week"))
        stale = stale.join(answered, _WEEK, "left_semi")
    kept, opened = opened_weeks(kept, stale)
    new_items = merged_items(stale, items, opened) if week_items is None else week_items
    counted = stale.select(*_WEEK, "item_count").unionByName(opened.select(*_WEEK, "item_count"))
    weeks = counted.groupBy(*_WEEK).agg(F.sum("item_count").alias("item_count")).select(
        "tenant_id",
        "source",
        F.col("week").alias("entry_key"),
        F.col("week").alias("day"),
        F.lit(None).cast("string").alias("note_id"),
        "item_count",
        F.lit(None).cast("map<string,double>").alias("stats"),
        F.lit(None).cast("string").alias("map_variant"),
        F.lit(False).alias("hot"),
        F.lit(True).alias("compacted"),
        sort_day(F.col("week"), F.lit(True)).alias("sort_day"),
    )
    replaced = stale.select(*_UNIT).unionByName(opened.select(*_UNIT))
    others = items.join(replaced, _UNIT, "left_anti")
    facts = _of(items.filter(F.col("section").startswith(COVERED_FACTS)), opened).select(*items.columns)
    facts = facts.unionByName(covered_facts(stale, items).select(*items.columns))
    cover = stale.select("tenant_id", "source", F.col("week").alias("entry_key"), "day", "note_id", "item_count", "stats")
    return kept.unionByName(weeks), others.unionByName(new_items.select(*items.columns)).unionByName(facts), cover
