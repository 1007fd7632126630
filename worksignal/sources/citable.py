"""Everything a brief's claim can cite, as one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksignal.functions.text import not_blank


def _text(*parts) -> F.Column:
    return F.concat_ws(" ", *parts)


def citable_sources(
    emails: DataFrame | None = None,
    events: DataFrame | None = None,
    notes: DataFrame | None = None,
    tasks: DataFrame | None = None,
) -> DataFrame:
    """(tenant_id, source, ref, label, text) rows of the given source tables."""
    unknown = F.lit("unknown")
    parts = []
    if emails is not None:
        parts.append(emails.select(
            "tenant_id", F.lit("email").alias("source"),
            F.coalesce(not_blank(F.col("filename")), not_blank(F.col("message_id")), unknown).alias("ref"),
            F.coalesce("subject", F.lit("(no subject)")).alias("label"),
            _text("subject", "body").alias("text"),
        ))
    if events is not None:
        people = F.flatten(F.transform("attendees", lambda a: F.array(a["name"], a["email"], a["partstat"])))
        parts.append(events.select(
            "tenant_id", F.lit("calendar").alias("source"),
            F.coalesce(not_blank(F.col("uid")), unknown).alias("ref"),
            F.coalesce("summary", F.lit("(no summary)")).alias("label"),
            _text("summary", "description", "location", people).alias("text"),
        ))
    if notes is not None:
        parts.append(notes.select(
            "tenant_id", F.lit("notes").alias("source"),
            F.coalesce(not_blank(F.col("note_id")), unknown).alias("ref"),
            F.coalesce(not_blank(F.col("title")), not_blank(F.col("note_id")), F.lit("(note)")).alias("label"),
            _text("title", "body").alias("text"),
        ))
    if tasks is not None:
        parts.append(tasks.select(
            "tenant_id", F.lit("task").alias("source"),
            F.coalesce(not_blank(F.col("id")), unknown).alias("ref"),
            F.coalesce(not_blank(F.col("title")), not_blank(F.col("id")), F.lit("(task)")).alias("label"),
            _text("title", "description").alias("text"),
        ))
    return reduce(DataFrame.unionByName, parts)


def browse_emails(emails: DataFrame) -> DataFrame:
    """A tenant's mail as listed to its owner."""
    return emails.select(
        "tenant_id", "subject", "from_hdr", "to_hdr", "date_iso", "date_key", "body", "filename"
    ).orderBy("tenant_id", "date_key", "filename")


def browse_events(events: DataFrame) -> DataFrame:
    return events.select(
        "tenant_id", "uid", "summary", "description", "location", "date_key", "start", "end",
        F.transform("attendees", lambda a: F.coalesce(not_blank(a["name"]), a["email"])).alias("attendees"),
    ).orderBy("tenant_id", F.col("start").asc_nulls_first(), "uid")


def browse_notes(notes: DataFrame) -> DataFrame:
    return notes.select("tenant_id", "note_id", "title", "date_key", "body").orderBy(
        "tenant_id", "date_key", "note_id"
    )
