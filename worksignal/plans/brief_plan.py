"""From ledgers and tasks to briefs, citations and structured items."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksignal.functions.constants import (
    CONTRADICTION_SCHEMA,
    DRAFT_SCHEMA,
    JUDGE_SCHEMA,
    JUDGE_TEXT_CHARS,
    SOURCES,
    STRUCTURED_SCHEMA,
    SYNTHESIS_SCHEMA,
)
from worksignal.functions.dates import today_text
from worksignal.functions.payload import field
from worksignal.operators import briefs, crossref, grounding, ledger_health, matching, rendering, task_signals
from worksignal.operators.ordered import fold_lines, ordinal, range_buckets
from worksignal.plans import model_stage
from worksignal.session import settle

_SECTIONS = (
    "EMAIL LEDGER:", "CALENDAR LEDGER:", "NOTES LEDGER:", "TASK SIGNALS:",
    "CROSS-REFERENCE INDEX (tasks found in multiple sources):", "CONTRADICTIONS DETECTED:", "DATA FRESHNESS:",
)


def ledger_digest_units(entries, items, cover, reference_date, quiet=None) -> DataFrame:
    """Request units of the per-source summary: today, quiet senders for mail, the ledger."""
    text = rendering.ledger_text(rendering.ledger_lines(entries, items, cover))
    today = F.concat(F.lit("TODAY'S DATE: "), today_text(reference_date), F.lit("\n\n---\n\n"))
    if quiet is None:
        joined = text.withColumn("report", F.lit(rendering.NO_QUIET_SENDERS))
    else:
        lines = rendering.or_sentence(rendering.staleness_lines(quiet), entries.select("tenant_id"), rendering.NO_QUIET_SENDERS)
        report = rendering.lines_text(lines).select("tenant_id", F.col("text").alias("report"))
        joined = text.join(report, "tenant_id", "left")
    mail = F.when(
        F.col("source") == "email",
        F.concat(F.lit("DETERMINISTIC SENDER STALENESS:\n\n"), F.col("report"), F.lit("\n\n---\n\n")),
    ).otherwise(F.lit(""))
    title = F.concat(F.lit("Chronological "), F.initcap("source"), F.lit(" Ledger:\n\n"))
    return joined.select("tenant_id", F.col("source").alias("unit_key"),
                         F.concat(today, mail, title, F.col("text")).alias("user_text"))


def synthesis_context(entries, items, cover, signals, mentions, contradictions, fresh, reference_date) -> DataFrame:
    """(tenant_id, text): everything a brief is written from, section by section."""
    tenants = fresh.select("tenant_id").distinct()

    def section(number, lines):
        return lines.select("tenant_id", F.lit(number).alias("section"), F.col("rank").cast("bigint"), "place", "line")

    ledger = rendering.ledger_lines(entries, items, cover, reference_date)
    number = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source"))
    far = F.lit("9999-12-31").cast("date")
    ledger_part = ledger.select(
        "tenant_id", number.cast("int").alias("section"),
        F.datediff(F.coalesce("sort_day", far), F.lit("1970-01-01").cast("date")).cast("bigint").alias("rank"),
        F.concat_ws("|", "entry_key", F.col("part").cast("string"), "place").alias("place"), "line",
    )
    parts = [
        ledger_part,
        section(4, rendering.or_sentence(rendering.signal_lines(signals), tenants, rendering.NO_SIGNALS)),
        section(5, rendering.or_sentence(rendering.mention_lines(mentions), tenants, rendering.NO_MENTIONS)),
        section(6, rendering.or_sentence(rendering.contradiction_lines(contradictions), tenants, rendering.NO_CONTRADICTIONS)),
        section(7, rendering.freshness_lines(fresh)),
    ]
    titles = F.array(*[F.lit(("\n" if i else "") + t) for i, t in enumerate(_SECTIONS)])
    heads = tenants.select("tenant_id", F.posexplode(titles).alias("pos", "line")).select(
        "tenant_id", (F.col("pos") + 1).cast("int").alias("section"), F.lit(-(10**12)).cast("bigint").alias("rank"),
        F.lit("").alias("place"), "line",
    )
    today = tenants.select(
        "tenant_id", F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("rank"), F.lit("").alias("place"),
        F.concat(F.lit("TODAY'S DATE: "), today_text(reference_date), F.lit("\n\n---\n")).alias("line"),
    )
    lines = reduce(DataFrame.unionByName, [today, heads, *parts])
    bucket = F.struct("section", "rank")
    ordered = ordinal(lines, ["tenant_id"], bucket,
                      [F.col("section"), F.col("rank"), F.col("place"), F.col("line")])
    return fold_lines(ordered, ["tenant_id"])


def contradiction_units(mentions: DataFrame, multi_source: DataFrame) -> DataFrame:
    """One unit per tenant with tasks found in several sources; other tenants need no call."""
    chosen = mentions.join(multi_source.select("tenant_id", "task_id"), ["tenant_id", "task_id"], "left_semi")
    text = rendering.lines_text(rendering.mention_lines(chosen))
    return text.select("tenant_id", F.lit("contradictions").alias("unit_key"),
                       F.concat(F.lit("Cross-source task mentions:\n\n"), F.col("text")).alias("user_text"))


def contradiction_claims(items: DataFrame) -> DataFrame:
    """Claims of accepted contradiction responses."""
    rows = items.filter("category = 'contradictions'")
    return rows.select(
        "tenant_id", F.concat_ws("-", "unit_key", F.lpad(F.col("ordinal").cast("string"), 8, "0")).alias("claim_id"),
        field(F.col("payload"), "entity").alias("entity"),
        F.from_json(field(F.col("payload"), "sources"), "array<string>").alias("sources"),
        field(F.col("payload"), "description").alias("description"),
    )


def synthesis_rows(accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(narrative, dispatchable items) of accepted responses; both narrative parts are required."""
    payload = F.col("payload")
    matters, missed = field(payload, "what_matters_today"), field(payload, "what_might_be_missed")
    narrative = accepted.filter(matters.isNotNull() & missed.isNotNull()).select(
        "tenant_id", matters.alias("what_matters_today"), missed.alias("what_might_be_missed")
    )
    return narrative, dispatch_rows(accepted)


def dispatch_rows(accepted: DataFrame) -> DataFrame:
    items = model_stage.payload_items(accepted).filter("category = 'dispatchable_items'")
    payload = F.col("payload")
    return items.select(
        "tenant_id", field(payload, "id").alias("id"), field(payload, "type").alias("type"),
        field(payload, "summary").alias("summary"), field(payload, "context").alias("context"), "ordinal",
    )


def draft_units(items: DataFrame) -> DataFrame:
    """One request per tenant for drafts of its items, a JSON line for each."""
    lines = items.select("tenant_id", F.col("ordinal").alias("rank"), F.col("id").alias("place"),
                         F.to_json(F.struct("id", "type", "summary", "context")).alias("line"))
    return rendering.lines_text(lines).select(
        "tenant_id", F.lit("drafts").alias("unit_key"),
        F.concat(F.lit("Dispatchable items:\n\n"), F.col("text")).alias("user_text"),
    )


def draft_rows(accepted: DataFrame) -> DataFrame:
    items = model_stage.payload_items(accepted).filter("category = 'drafts'")
    return items.select("tenant_id", field(F.col("payload"), "id").alias("id"),
                        field(F.col("payload"), "draft_text").alias("draft_text"), "ordinal")


def write_briefs(
    entries: DataFrame, items: DataFrame, cover: DataFrame | None, tasks: DataFrame, config: DataFrame,
    answer: dict[str, Callable[[str, str], str]], reference_date, variant: str = "single_call",
) -> dict[str, DataFrame]:
    """All stages of the brief for every tenant at once.

    `answer` maps a stage (contradictions, synthesis, narrative, dispatch, drafts) to a callable.
    The staged variant asks for the narrative first and for dispatchable items with it at hand.
    """
    signals = settle(task_signals.task_signals(tasks, reference_date))
    flagged = task_signals.flagged_tasks(signals)
    mentions = settle(crossref.task_mentions(flagged, crossref.ledger_texts(entries, items)))
    expected = ledger_health.expected_sources(entries, SOURCES)
    fresh = settle(ledger_health.freshness(entries, expected, reference_date))

    multi = crossref.multi_source_tasks(mentions)
    asked = model_stage.requests(contradiction_units(mentions, multi), "contradictions", "")
    accepted, _ = model_stage.ask_and_check(asked, answer["contradictions"], CONTRADICTION_SCHEMA)
    kept, dropped = grounding.ground_contradictions(
        contradiction_claims(model_stage.payload_items(accepted)), multi
    )
    kept = settle(kept)

    context = synthesis_context(entries, items, cover, signals, mentions, kept, fresh, reference_date)
    units = settle(context.select("tenant_id", F.lit("brief").alias("unit_key"), F.col("text").alias("user_text")))
    if variant == "single_call":
        told, _ = model_stage.ask_and_check(model_stage.requests(units, "synthesis", ""), answer["synthesis"], SYNTHESIS_SCHEMA)
        narrative, dispatches = synthesis_rows(told)
    else:
        told, _ = model_stage.ask_and_check(model_stage.requests(units, "narrative", ""), answer["narrative"], {})
        narrative, _ = synthesis_rows(told)
        known = F.concat(
            F.col("user_text"), F.lit("\n\n---\n\nNARRATIVE ALREADY WRITTEN:\nwhat_matters_today:\n"),
            F.col("what_matters_today"), F.lit("\n\nwhat_might_be_missed:\n"), F.col("what_might_be_missed"),
        )
        second = units.join(narrative, "tenant_id").select("tenant_id", "unit_key", known.alias("user_text"))
        listed, _ = model_stage.ask_and_check(model_stage.requests(second, "dispatch", ""), answer["dispatch"], SYNTHESIS_SCHEMA)
        dispatches = dispatch_rows(listed)

    allowed = grounding.draftable(dispatches, config)
    drafted, _ = model_stage.ask_and_check(model_stage.requests(draft_units(allowed), "drafts", ""), answer["drafts"], DRAFT_SCHEMA)
    with_drafts = grounding.attach_drafts(dispatches, draft_rows(drafted))
    dispatch_text = dispatches.groupBy("tenant_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "summary", "context"))), " ").alias("d")
    )
    texts = narrative.join(dispatch_text, "tenant_id", "left").select(
        "tenant_id", F.concat_ws(" ", "what_matters_today", "what_might_be_missed", "d").alias("text")
    )
    return {
        "briefs": briefs.assemble_briefs(narrative, with_drafts, fresh),
        "signals": signals,
        "mentions": mentions,
        "freshness": fresh,
        "contradictions": kept,
        "dropped_contradictions": dropped,
        "uncovered": grounding.uncovered_tasks(texts, flagged),
    }


def numbered_claims(claims: DataFrame) -> DataFrame:
    """Claims with `n`, from 1 in the order of their ids."""
    ranged = range_buckets(claims, ["tenant_id", "claim_id"])
    return ordinal(ranged, ["tenant_id"], F.col("range_bucket"), [F.col("claim_id")], "n").drop("range_bucket")


def judge_units(claims: DataFrame, sources: DataFrame, numbered: DataFrame | None = None) -> DataFrame:
    """One request per tenant for the claims no keyword match was found for; `numbered` as in `numbered_claims`."""
    numbered = numbered_claims(claims) if numbered is None else numbered
    zero = F.lit(0).cast("bigint")
    said = numbered.select("tenant_id", zero.alias("rank"), F.lpad(F.col("n").cast("string"), 12, "0").alias("place"),
                           F.concat((F.col("n") - 1).cast("string"), F.lit(". "), F.col("text")).alias("line"))
    shown = sources.join(claims.select("tenant_id").distinct(), "tenant_id", "left_semi").select(
        "tenant_id", F.lit(2).cast("bigint").alias("rank"), F.concat_ws("|", "source", "ref").alias("place"),
        F.concat(F.lit("["), F.col("source"), F.lit(":"), F.col("ref"), F.lit("] "), F.col("label"), F.lit(" — "),
                 F.substring("text", 1, JUDGE_TEXT_CHARS)).alias("line"),
    )
    head = claims.select("tenant_id").distinct().select(
        "tenant_id", F.lit(1).cast("bigint").alias("rank"), F.lit("").alias("place"),
        F.lit("\nCandidate sources:").alias("line"),
    )
    text = rendering.lines_text(said.unionByName(head).unionByName(shown))
    return text.select("tenant_id", F.lit("judge").alias("unit_key"),
                       F.concat(F.lit("Claims:\n"), F.col("text")).alias("user_text"))


def judge_evidence(accepted: DataFrame, claims: DataFrame, numbered: DataFrame | None = None) -> DataFrame:
    """(tenant_id, claim_id, source_ref, quote) of accepted judge responses."""
    numbered = (numbered_claims(claims) if numbered is None else numbered).select(
        "tenant_id", "claim_id", (F.col("n") - 1).alias("claim_index")
    )
    matches = model_stage.payload_items(accepted).filter("category = 'matches'").select(
        "tenant_id", "payload", F.try_parse_json("payload").alias("parsed")
    )
    # Only a whole number is an index, and only the objects of a list are evidence: others are passed over one by one.
    index = F.try_variant_get("parsed", "$.claim_index", "variant")
    whole = F.when(F.schema_of_variant(index) == "BIGINT", F.try_variant_get("parsed", "$.claim_index", "bigint"))
    kinds = F.transform(F.try_variant_get("parsed", "$.evidence", "array<variant>"), F.schema_of_variant)
    raw = F.from_json(field(F.col("payload"), "evidence"), "array<string>")
    listed = matches.select("tenant_id", whole.alias("claim_index"), F.explode(F.arrays_zip(raw.alias("e"), kinds.alias("kind"))).alias("z"))
    matches = listed.filter(F.col("z.kind").startswith("OBJECT")).select(
        "tenant_id", "claim_index", F.from_json("z.e", "struct<source_ref:string,quote:string>").alias("e")
    )
    return matches.join(numbered, ["tenant_id", "claim_index"]).select("tenant_id", "claim_id", "e.*")


def judged_matches(claims, sources, common, judge) -> DataFrame:
    """Matches a model proposes for the claims, as far as its evidence holds."""
    numbered = settle(numbered_claims(claims))  # numbered once, for the requests and for reading the answers
    reqs = model_stage.requests(judge_units(claims, sources, numbered), "judge", "")
    accepted, _ = model_stage.ask_and_check(reqs, judge, JUDGE_SCHEMA)
    rated = grounding.ground_evidence(
        judge_evidence(accepted, claims, numbered), claims, grounding.last_per_ref(sources), common
    )
    good = rated.filter("reason IS NULL").select("tenant_id", "claim_id", "source", F.col("source_ref").alias("ref")).distinct()
    return good.withColumn("n_matched", F.lit(1)).withColumn("n_keywords", F.lit(1))


def cite(brief_rows: DataFrame, sources: DataFrame, judge: Callable[[str, str], str] | None = None):
    """(cited briefs, citation counts) of (tenant_id, brief) rows."""
    lines = briefs.numbered_lines(brief_rows, ["tenant_id"])
    claims = briefs.claims_of(lines)
    index = settle(matching.source_index(sources))
    matches = settle(matching.keyword_matches(claims, index))
    tags = briefs.citation_tags(matches)
    judged = None
    if judge is not None:
        judged = judged_matches(matching.unmatched(claims, matches), sources, matching.common_terms(index), judge)
        tags = tags.unionByName(briefs.citation_tags(judged, inferred=True))
    cited = briefs.cited_briefs(briefs.annotate_lines(lines, tags), ["tenant_id"])
    return cited, matching.citation_stats(briefs.claim_lines(lines), matches, judged)


def structured_items(accepted: DataFrame, sources: DataFrame, reference_date) -> DataFrame:
    """Items of accepted structured responses with urgency, disagreement and sources."""
    payload = F.col("payload")
    items = model_stage.payload_items(accepted).filter("category = 'items'").select(
        "tenant_id", F.concat_ws("-", "unit_key", F.lpad(F.col("ordinal").cast("string"), 8, "0")).alias("claim_id"),
        *[field(payload, f).alias(f) for f in ("id", "type", "title", "summary", "priority", "due_date", "related_task_id")],
    )
    claims = items.select("tenant_id", "claim_id", F.col("summary").alias("text"))
    matches = matching.keyword_matches(claims, sources)
    return briefs.item_citations(task_signals.annotate_items(items, reference_date), matches)


def write_structured(context: DataFrame, sources: DataFrame, answer, reference_date) -> DataFrame:
    units = context.select("tenant_id", F.lit("items").alias("unit_key"), F.col("text").alias("user_text"))
    accepted, _ = model_stage.ask_and_check(model_stage.requests(units, "structured", ""), answer, STRUCTURED_SCHEMA)
    return structured_items(accepted, sources, reference_date)
