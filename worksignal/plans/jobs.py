"""Whole jobs: from folders of files to a ledger, and from the ledger to saved briefs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksignal.functions.checks import long_enough, narrates_schema
from worksignal.functions.constants import RETENTION_DAYS
from worksignal.operators.compaction import compact, opened_weeks, split_by_age
from worksignal.operators.mail_signals import quiet_senders
from worksignal.plans import brief_plan, map_plan, model_stage
from worksignal.session import settle
from worksignal.sources import calendar, citable, inbox, notes, records, runs, tasks
from worksignal.sources.tenants import valid_tenants

Answer = Callable[[str, str], str]


def read_sources(spark: SparkSession, roots: list[str]) -> dict[str, DataFrame]:
    """All tables of the given tenant roots; rows of tenants with a disallowed id are in `refused`.

    Each root holds the folders inbox, calendar, notes and tasks and may hold tenant_config.json.
    Unreadable mail and events are in `quarantine`.
    """
    def below(name):
        return [f"{root.rstrip('/')}/{name}" for root in roots]

    found = {
        "email": inbox.read_inbox(spark, *below("inbox")),
        "calendar": calendar.read_calendar(spark, *below("calendar")),
        "notes": notes.read_notes(spark, *below("notes")),
        "tasks": tasks.read_tasks(spark, *below("tasks")),
    }
    names = reduce(DataFrame.union, [df.select("tenant_id") for df in found.values()]).distinct()
    out = {name: valid_tenants(df) for name, df in found.items()}
    out["refused"] = names.join(valid_tenants(names), "tenant_id", "left_anti")
    broken = [
        out[name].filter("parse_error IS NOT NULL").select("tenant_id", F.lit(name).alias("source"), ref.alias("ref"), "parse_error")
        for name, ref in (("email", F.col("filename")), ("calendar", F.col("uid")))
    ]
    out["quarantine"] = broken[0].union(broken[1])
    return out


def run_sources(
    spark: SparkSession, sources: dict[str, DataFrame], ledger: str, answers: dict[str, Answer], reference_date,
    blocked: DataFrame | None = None, digest_days: int | None = None, holdout_days: int | None = None,
) -> DataFrame:
    """Add the new days and notes of all tenants to the ledger; returns the rejected units.

    `answers` maps email, calendar and notes to a callable. Rejected units stay new. The rows count
    together, by the run's commit at the end.
    """
    entries, _, cover = runs.read_ledger_tables(spark, ledger)
    known = settle(records.processed_keys(entries, cover))
    window = {"digest_days": digest_days, "holdout_days": holdout_days}
    done = [
        map_plan.map_mail(sources["email"], known, answers["email"], blocked=blocked, **window),
        map_plan.map_calendar(sources["calendar"], known, answers["calendar"], **window),
        map_plan.map_notes(sources["notes"], known, answers["notes"], reference_date),
    ]
    new_entries, new_items, rejected = (reduce(DataFrame.unionByName, [d[k] for d in done]) for k in range(3))
    run = runs.new_run()
    runs.write_rows(settle(new_items), ledger, "items", run)
    runs.write_rows(settle(new_entries), ledger, "entries", run)
    runs.commit(spark, ledger, run, "sources")
    return rejected


def roll_up(
    spark: SparkSession, ledger: str, reference_date, answer: Answer | None = None, retention_days: int = RETENTION_DAYS
) -> None:
    """Replace stale days by ISO weeks, merged by a model where `answer` is given.

    May be run every day: days that grow stale are merged into their week. Sources of tenants without
    stale days are not touched. All changes count together, by the run's commit at the end.
    """
    entries, items, cover = runs.read_ledger_tables(spark, ledger)
    _, stale = split_by_age(entries, reference_date, retention_days)
    keys = ["tenant_id", "source"]
    due = settle(stale.select(*keys).distinct())
    entries, items = (settle(df.join(due, keys, "left_semi")) for df in (entries, items))
    merged = None
    if answer is not None:
        kept, stale = split_by_age(entries, reference_date, retention_days)
        _, opened = opened_weeks(kept, stale)
        merged, _ = map_plan.merged_weeks(stale, items, answer, opened=opened)
        merged = settle(merged)
    run, tables = runs.new_run(), compact(entries, items, reference_date, retention_days, merged)
    for name, rows in zip(("entries", "items", "cover"), tables):
        runs.write_rows(settle(rows), ledger, name, run)
    runs.write_replaced(due, ledger, ["entries", "items"], run)
    runs.commit(spark, ledger, run, "weeks")


def run_digests(
    spark: SparkSession, sources: dict[str, DataFrame], ledger: str, answer: Answer, reference_date, out: str | None = None, run_ts: str | None = None
) -> DataFrame:
    """(tenant_id, source, digest, accepted): one summary for each source's ledger; a short one or one that tells of its format is not accepted.

    With `out` and `run_ts` the accepted ones are saved with their history.
    """
    entries, items, cover = runs.read_ledger_tables(spark, ledger)
    quiet = quiet_senders(map_plan.readable(sources["email"]))
    units = brief_plan.ledger_digest_units(entries, items, cover, reference_date, quiet)

    def fits(text):
        return F.coalesce(long_enough(text) & ~narrates_schema(text), F.lit(False))

    told = model_stage.ask(model_stage.requests(units, "digest", ""), answer, fits=fits)
    text = F.col("response")
    fine = fits(text)
    digests = told.select("tenant_id", F.col("unit_key").alias("source"), text.alias("digest"), fine.alias("accepted"))
    if out is not None:
        records.save_digests(digests.filter("accepted"), out, run_ts or str(reference_date))
    return digests


def run_briefs(
    spark: SparkSession, sources: dict[str, DataFrame], ledger: str, out: str, config: DataFrame, answers: dict[str, Answer],
    reference_date, run_ts: str, variant: str = "single_call", judge: Answer | None = None,
) -> dict[str, DataFrame]:
    """Write, cite and save the brief of every tenant in the ledger; returns all results."""
    entries, items, cover = runs.read_ledger_tables(spark, ledger)
    found = brief_plan.write_briefs(entries, items, cover, sources["tasks"], config, answers, reference_date, variant)
    cited_from = citable.citable_sources(
        map_plan.readable(sources["email"]), map_plan.readable(sources["calendar"]), sources["notes"], sources["tasks"]
    )
    cited, stats = brief_plan.cite(settle(found["briefs"]), settle(cited_from), judge)
    records.save_brief(cited, out, run_ts)
    return {**found, "cited": cited, "citation_stats": stats}
