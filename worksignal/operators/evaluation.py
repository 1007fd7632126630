"""Scoring extractions and comparing variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksignal.functions.checks import bloat_ceiling, forbidden_keywords, missing_keywords
from worksignal.functions.constants import BLOAT_LIMITS
from worksignal.functions.text import contains_ci


def extraction_bloat(entries: DataFrame, items: DataFrame, source: str) -> DataFrame:
    """Entries of one source with more extracted items than their input can plausibly hold.

    `entries` give `item_count`, the size of the input.
    """
    floor, per_item = BLOAT_LIMITS[source]
    keys = ["tenant_id", "source", "entry_key"]
    totals = items.filter((F.col("section") == "delta") & (F.col("source") == source)).groupBy(*keys).agg(
        F.count("*").alias("n_items")
    )
    ceiling = bloat_ceiling(F.col("item_count"), floor, per_item)
    return (
        entries.filter(F.col("source") == source)
        .join(totals, keys, "left")
        .withColumn("n_items", F.coalesce("n_items", F.lit(0)))
        .withColumn("ceiling", ceiling)
        .filter("n_items > ceiling")
        .select(*keys, "item_count", "n_items", "ceiling")
    )


def _any_category(categories: Column, category: Column) -> Column:
    return F.coalesce(F.array_contains(categories, category), F.lit(True))


def score_scenarios(scenarios: DataFrame, entries: DataFrame, items: DataFrame) -> DataFrame:
    """Pass or fail of each scenario (tenant_id, source, name, entry_key, required_keywords,
    forbidden_keywords, expected_category).

    Required words are looked for in the expected categories only, forbidden ones everywhere.
    Facts (section stats) count for calendar and notes. A scenario whose entry is missing fails.
    A word counts item by item: each alternative is looked for in each item, and the finds are
    combined per scenario, so no entry's text is glued together.
    """
    keys = ["tenant_id", "source", "entry_key"]
    present = entries.select(*keys).distinct().withColumn("has_entry", F.lit(True))
    wanted = scenarios.withColumn("n_required", F.coalesce(F.size("required_keywords"), F.lit(0)))
    facts = (F.col("section") == "stats") & (F.col("source") != "email")
    in_scope = facts | ((F.col("section") == "delta") & _any_category(F.col("expected_category"), F.col("category")))
    in_any = facts | (F.col("section") == "delta")
    joined = wanted.join(items.select(*keys, "section", "category", "text"), keys)
    no_sets = F.array().cast("array<int>")
    hits = F.when(
        in_scope,
        F.array_compact(F.transform(
            "required_keywords",
            lambda alts, i: F.when(F.exists(alts, lambda a: contains_ci(F.col("text"), a)), i),
        )),
    ).otherwise(no_sets)
    bad = F.when(in_any, forbidden_keywords(F.col("text"), F.col("forbidden_keywords")))
    found = joined.select(
        "tenant_id", "name",
        F.coalesce(hits, no_sets).alias("hits"),
        F.coalesce(F.size(bad) > 0, F.lit(False)).alias("bad"),
    )
    required = found.select("tenant_id", "name", F.explode("hits").alias("hit")).distinct().groupBy(
        "tenant_id", "name").agg(F.count("*").alias("n_found"))
    spoiled = found.groupBy("tenant_id", "name").agg(F.bool_or("bad").alias("spoiled"))
    rated = (
        wanted.join(present, keys, "left")
        .join(required, ["tenant_id", "name"], "left")
        .join(spoiled, ["tenant_id", "name"], "left")
    )
    missing = F.col("n_required") - F.coalesce("n_found", F.lit(0))
    is_negative = F.size(F.coalesce("forbidden_keywords", F.array().cast("array<string>"))) > 0
    detail = (
        F.when(F.col("has_entry").isNull(), F.lit("no entry"))
        .when(is_negative & F.coalesce("spoiled", F.lit(False)), F.lit("forbidden keyword found"))
        .when(~is_negative & (missing > 0), F.concat(F.lit("missing keywords: "), missing.cast("string")))
        .otherwise(F.lit("OK"))
    )
    return rated.select(
        "tenant_id", "source", "name", "entry_key", (detail == "OK").alias("passed"), detail.alias("detail")
    )


def keyword_gaps(texts: DataFrame, required: Column) -> DataFrame:
    """Texts with the required keyword sets they lack."""
    return texts.withColumn("missing", missing_keywords(F.col("text"), required))


def found_priority(items: DataFrame, probes: DataFrame) -> DataFrame:
    """The priority of the first extracted item mentioning each probe's `match_on`.

    Probes: (tenant_id, source, name, entry_key, match_on). Categories are tried in the order
    deadlines, decisions, action items.
    """
    ranks = F.array(F.lit("deadlines"), F.lit("decisions"), F.lit("action_items"))
    keys = ["tenant_id", "source", "entry_key"]
    hits = (
        probes.join(items.filter("section = 'delta'"), keys)
        .withColumn("rank", F.array_position(ranks, F.col("category")))
        .filter((F.col("rank") > 0) & contains_ci(F.col("text"), F.col("match_on")))
        .groupBy("tenant_id", "name")
        .agg(F.min_by(F.struct(F.get_json_object("payload", "$.priority").alias("priority")),
                      F.struct("rank", "ordinal")).alias("first"))
    )
    return probes.join(hits, ["tenant_id", "name"], "left").select(
        "tenant_id", "name", F.coalesce("first.priority", F.lit("not_found")).alias("priority")
    )


def trial_accuracy(trials: DataFrame) -> DataFrame:
    """(eval_name, variant, scenario, n_trials, n_correct, accuracy) of rows holding `expected` and `result`.

    A row with no result stands for a scenario that was never tried: its accuracy is 0.
    """
    right = F.count_if(F.col("result").eqNullSafe(F.col("expected")) & F.col("result").isNotNull())
    scored = trials.groupBy("eval_name", "variant", "scenario").agg(
        F.count("result").alias("n_trials"), right.alias("n_correct")
    )
    return scored.withColumn("accuracy", F.coalesce(F.try_divide("n_correct", "n_trials"), F.lit(0.0)))


def variant_accuracy(scored: DataFrame) -> DataFrame:
    """Trial-weighted accuracy of each variant."""
    return (
        scored.groupBy("eval_name", "variant")
        .agg(F.sum("n_trials").alias("n_trials"), F.sum("n_correct").alias("n_correct"))
        .withColumn("aggregate_accuracy", F.coalesce(F.try_divide("n_correct", "n_trials"), F.lit(0.0)))
    )


def variant_averages(trials: DataFrame) -> DataFrame:
    """Average dispatchables and latency of each variant over trials (eval_name, variant, n_dispatchables, latency_ms)."""
    return trials.groupBy("eval_name", "variant").agg(
        F.count("*").alias("n_trials"), F.avg("n_dispatchables").alias("avg_dispatchables"), F.avg("latency_ms").alias("avg_latency_ms")
    )


def compare_variants(accuracies: DataFrame, base: str, other: str, margin: float = 0.10) -> DataFrame:
    """Verdict per evaluation: does `other` beat `base` by at least the margin?"""
    def of(variant):
        return F.max(F.when(F.col("variant") == variant, F.col("aggregate_accuracy")))

    both = accuracies.groupBy("eval_name").agg(of(base).alias("base_accuracy"), of(other).alias("other_accuracy"))
    delta = F.col("other_accuracy") - F.col("base_accuracy")
    return both.withColumn("delta", delta).withColumn(
        "verdict",
        F.when(F.abs(delta) < margin, F.lit("no meaningful difference"))
        .when(delta > 0, F.lit("improved"))
        .otherwise(F.lit("hurt")),
    )


def run_records(scored: DataFrame, runs: DataFrame) -> DataFrame:
    """Evaluation records: `runs` (eval_name, variant, …) with their scenarios as a map.

    A run has a fixed registry of scenarios, which bounds the map.
    """
    keys = ["eval_name", "variant"]
    entry = F.struct("scenario", F.struct("n_trials", "n_correct", "accuracy").alias("score"))
    per_run = scored.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("scenarios"))
    return runs.join(per_run, keys).join(
        variant_accuracy(scored).select(*keys, "aggregate_accuracy"), keys
    )
