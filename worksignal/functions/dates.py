"""Day keys, ISO weeks and day arithmetic. The reference day is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from worksignal.functions.constants import DUE_SOON_DAYS

_DAY = "^\\d{4}-\\d{2}-\\d{2}$"


def as_date(value) -> Column:
    """A reference day given as a column, date or ISO string."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def strict_day(col: Column) -> Column:
    """A bare ISO day as DATE, NULL for anything else."""
    return F.when(col.rlike(_DAY), F.try_to_date(col, "yyyy-MM-dd"))


def leading_day(col: Column) -> Column:
    """The ISO day a string starts with, NULL where there is none."""
    return F.try_to_date(F.nullif(F.regexp_extract(col, "^(\\d{4}-\\d{2}-\\d{2})", 1), F.lit("")), "yyyy-MM-dd")


def due_day(col: Column) -> Column:
    """A task's date: a bare day or an ISO timestamp, whose own local day counts."""
    return F.try_to_date(F.substring(col, 1, 10), "yyyy-MM-dd")


def iso_week(day: Column) -> Column:
    """`YYYY-Www` of a DATE."""
    return F.concat(
        F.extract(F.lit("YEAROFWEEK"), day).cast("string"),
        F.lit("-W"),
        F.lpad(F.weekofyear(day).cast("string"), 2, "0"),
    )


def week_monday(week: Column) -> Column:
    """The Monday of a `YYYY-Www` key."""
    year = F.regexp_extract(week, "^(\\d{4})-W(\\d{2})$", 1)
    number = F.regexp_extract(week, "^(\\d{4})-W(\\d{2})$", 2)
    fourth = F.make_date(F.nullif(year, F.lit("")).cast("int"), F.lit(1), F.lit(4))
    return F.date_add(F.trunc(fourth, "week"), (F.nullif(number, F.lit("")).cast("int") - 1) * 7)


def sort_day(day: Column, compacted: Column) -> Column:
    """Where an entry sorts: its day, or the Monday of a rolled-up week."""
    return F.when(F.coalesce(compacted, F.lit(False)), week_monday(day)).otherwise(strict_day(day))


def today_text(reference) -> Column:
    return F.date_format(as_date(reference), "yyyy-MM-dd (EEEE)")


def day_label(day: Column, reference) -> Column:
    """How old a day is, in words; days that are no dates and future days pass through."""
    age = F.datediff(as_date(reference), strict_day(day))
    return (
        F.when(age == 0, F.lit("TODAY"))
        .when(age == 1, F.lit("YESTERDAY"))
        .when(age > 1, F.concat(age.cast("string"), F.lit(" DAYS AGO — NOT today")))
        .otherwise(day)
    )


def date_urgency(due: Column, reference) -> Column:
    left = F.datediff(strict_day(due), as_date(reference))
    return (
        F.when(left.isNull(), F.lit("no_date"))
        .when(left < 0, F.lit("overdue"))
        .when(left == 0, F.lit("due_today"))
        .when(left <= DUE_SOON_DAYS, F.lit("due_soon"))
        .otherwise(F.lit("later"))
    )


def rounded(col: Column) -> Column:
    """Two places, rounding the exact binary value with ties to even, as Python's `round` does."""
    return F.call_function("format_number", col, F.lit("0.00")).cast("double")


def micros_between(start: Column, end: Column) -> Column:
    """Whole microseconds of an interval, 0 where an end is missing. Sums of them are exact."""
    return F.coalesce(F.timestamp_diff("MICROSECOND", start, end), F.lit(0).cast("bigint"))


def as_hours(micros: Column) -> Column:
    return micros / F.lit(3.6e9)


def hours_between(start: Column, end: Column) -> Column:
    """Float hours of an interval, 0 where an end is missing."""
    return as_hours(micros_between(start, end))
