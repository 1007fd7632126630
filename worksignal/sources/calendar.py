"""Calendar scan: iCalendar files read as one row per event block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worksignal.functions.text import not_blank, strip
from worksignal.session import spread
from worksignal.sources.tenants import tenant_of_path

_BLOCK_START = "BEGIN:VEVENT"


def _lines_named(lines: Column, name: str) -> Column:
    return F.filter(lines, lambda line: line.rlike(f"(?i)^{name}(;[^:]*)?:"))


def _value(line: Column) -> Column:
    return F.regexp_replace(line, "^[^:]*:", "")


def _last(lines: Column, name: str) -> Column:
    """Value of a property's last line, NULL where the event has none."""
    return _value(F.get(F.reverse(_lines_named(lines, name)), F.lit(0)))


def _wall_clock(value: Column) -> Column:
    """A DATE-TIME value as written, a trailing Z ignored."""
    iso = F.regexp_replace(
        strip(value), "^(\\d{4})(\\d{2})(\\d{2})T(\\d{2})(\\d{2})(\\d{2})Z?$", "$1-$2-$3T$4:$5:$6"
    )
    return F.when(strip(value).rlike("^\\d{8}T\\d{6}Z?$"), iso.try_cast("timestamp_ntz"))


def _attendee(line: Column) -> Column:
    params = F.substring_index(line, ":", 1)
    address = F.regexp_replace(strip(_value(line)), "(?i)^mailto:", "")
    name = not_blank(strip(F.regexp_extract(params, "(?i).*;CN=([^;]*)", 1)))
    status = F.when(
        params.rlike("(?i);PARTSTAT="), F.regexp_extract(params, "(?i).*;PARTSTAT=([^;]*)", 1)
    ).otherwise(F.lit("NEEDS-ACTION"))
    return F.struct(
        F.coalesce(name, address).alias("name"), address.alias("email"), status.alias("partstat")
    )


def parse_event_blocks(raw: DataFrame, hot: bool = False) -> DataFrame:
    """Events from (tenant_id, block) rows, a block being what follows a BEGIN:VEVENT line.

    An event whose start or end cannot be read keeps its row, with `parse_error` set.
    """
    text = F.regexp_replace(F.regexp_replace("block", "\\r\\n", "\n"), "\\n[ \\t]", "")
    body = F.split(F.split(text, "\\nEND:VEVENT", 2)[0], "\\n")
    parsed = spread(raw).filter(F.col("block").rlike("\\nEND:VEVENT")).select(
        "tenant_id", body.alias("lines")
    )
    lines = F.col("lines")

    def text_of(name):
        return F.coalesce(strip(_last(lines, name)), F.lit(""))

    starts, ends = _last(lines, "DTSTART"), _last(lines, "DTEND")
    description = F.replace(
        F.replace(_last(lines, "DESCRIPTION"), F.lit("\\n"), F.lit("\n")), F.lit("\\,"), F.lit(",")
    )
    rows = parsed.select(
        "tenant_id",
        text_of("UID").alias("uid"),
        text_of("SUMMARY").alias("summary"),
        F.coalesce(strip(_last(lines, "STATUS")), F.lit("CONFIRMED")).alias("status"),
        F.coalesce(strip(description), F.lit("")).alias("description"),
        text_of("LOCATION").alias("location"),
        _wall_clock(starts).alias("start"),
        _wall_clock(ends).alias("end"),
        F.transform(_lines_named(lines, "ATTENDEE"), _attendee).alias("attendees"),
        F.when(starts.isNotNull() & _wall_clock(starts).isNull(), F.lit("bad DTSTART"))
        .when(ends.isNotNull() & _wall_clock(ends).isNull(), F.lit("bad DTEND"))
        .alias("parse_error"),
    )
    return rows.select(
        "tenant_id", "uid", "summary", "status", "description", "location", "start", "end",
        F.coalesce(F.date_format("start", "yyyy-MM-dd"), F.lit("unknown")).alias("date_key"),
        "attendees", F.lit(hot).alias("is_hot"), "parse_error",
    )


def read_calendar(spark: SparkSession, *paths: str, hot: bool = False) -> DataFrame:
    """All events of the given `.ics` files.

    The block marker serves as the record separator, so a large file is split over tasks.
    """
    blocks = (
        spark.read.option("lineSep", _BLOCK_START)
        .text(list(paths))
        .select(tenant_of_path(F.col("_metadata.file_path")).alias("tenant_id"), F.col("value").alias("block"))
    )
    return parse_event_blocks(blocks, hot)
