"""Consistency checks of a tenant's own data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksignal.functions.constants import WEEKDAYS
from worksignal.operators.matching import keyword_matches, matched_claims, stored_index, unmatched
from worksignal.session import discard, settle

_WEEKDAY = "(?i)\\b(" + "|".join(WEEKDAYS) + ")\\b"


def weekday_mentions(text: Column) -> Column:
    """Weekday names in a text, lower-cased, in order, repeats kept."""
    return F.transform(F.regexp_extract_all(text, F.lit(_WEEKDAY), F.lit(1)), lambda d: F.lower(d))


def as_claims(sources: DataFrame) -> DataFrame:
    """Sources in the role of claims; the claim id names kind and ref."""
    return sources.select("tenant_id", F.concat_ws(":", "source", "ref").alias("claim_id"), "source", "ref", "text")


def exclusive_sources(sources: DataFrame, subject: str, others: tuple[str, ...], index: DataFrame | None = None) -> DataFrame:
    """Sources of kind `subject` whose content matches no source of the other kinds; `index` is that of all `sources`, if at hand."""
    claims = as_claims(sources.filter(F.col("source") == subject))
    matched = matched_claims(claims, (sources if index is None else index).filter(F.col("source").isin(*others)))
    return unmatched(claims, matched).select("tenant_id", "source", "ref")


def date_inconsistencies(events: DataFrame, sources: DataFrame, days: list[str]) -> DataFrame:
    """Mail and notes about an event naming a weekday that falls on another of the given days.

    Events: (tenant_id, uid, summary, description, date_key). The days name each weekday once.
    """
    claims = events.filter("date_key <> 'unknown'").select(
        "tenant_id",
        F.col("uid").alias("claim_id"),
        F.concat_ws(" ", F.coalesce("summary", F.lit("")), F.coalesce("description", F.lit(""))).alias("text"),
        "summary",
        "date_key",
    )
    narrative = sources.filter(F.col("source").isin("email", "notes"))
    names = F.create_map(*[
        x for day in days for x in (F.lower(F.date_format(F.lit(day).cast("date"), "EEEE")), F.lit(day))
    ])
    said = narrative.select("tenant_id", "source", "ref", F.explode(weekday_mentions(F.col("text"))).alias("claimed_weekday"))
    return (
        keyword_matches(claims, narrative)
        .join(claims.select("tenant_id", "claim_id", "summary", "date_key"), ["tenant_id", "claim_id"])
        .join(said, ["tenant_id", "source", "ref"])
        .withColumn("claimed_date", F.element_at(names, F.col("claimed_weekday")))
        .filter("claimed_date IS NOT NULL AND claimed_date <> date_key")
        .select(
            "tenant_id", F.col("summary").alias("event_summary"), F.col("date_key").alias("event_date"),
            F.col("ref").alias("source_ref"), "claimed_weekday", "claimed_date",
        )
    )


def dataset_quality(
    sources: DataFrame, conflicts: DataFrame, inconsistencies: DataFrame
) -> DataFrame:
    """One row per tenant: enough exclusive mail, an exclusive note, a real conflict, dates agree.

    The sources are indexed once; each part is settled, and what it stored goes, before the next begins.
    """
    def counted(df, name):
        return df.groupBy("tenant_id").agg(F.count("*").alias(name))

    totals = sources.groupBy("tenant_id").agg(
        F.count_if(F.col("source") == "email").alias("total"),
        F.count_if(F.col("source") == "notes").alias("notes_total"),
    )
    index, path = stored_index(sources)
    exclusive = settle(counted(exclusive_sources(sources, "email", ("calendar", "notes", "task"), index), "exclusive"))
    notes_exclusive = settle(counted(exclusive_sources(sources, "notes", ("email",), index), "notes_exclusive"))
    discard(sources.sparkSession, path)
    joined = totals
    for part in (exclusive, notes_exclusive, counted(conflicts, "n_conflicts"), counted(inconsistencies, "n_inconsistencies")):
        joined = joined.join(part, "tenant_id", "left")
    filled = joined.na.fill(0, ["exclusive", "notes_exclusive", "n_conflicts", "n_inconsistencies"])
    min_required = F.ceil(F.col("total") / 2)
    return filled.select(
        "tenant_id", "exclusive", "total", min_required.alias("min_required"),
        (F.col("exclusive") >= min_required).alias("exclusive_ok"),
        "notes_exclusive", "notes_total",
        (F.col("notes_exclusive") >= 1).alias("notes_exclusive_ok"),
        (F.col("n_conflicts") > 0).alias("has_conflict"),
        (F.col("n_inconsistencies") == 0).alias("date_consistent"),
    )
