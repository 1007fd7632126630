import os

from conftest import one, rows
from pyspark.sql import functions as F

from worksignal.operators import call_log, dataset_checks, evaluation
from worksignal.session import shared_dir


def test_scenarios(spark):
    items = spark.createDataFrame([
        ("calendar", "d", "delta", "notable_events", "Kestrel budget cut"), ("calendar", "d", "delta", "pattern_flags", "welding"),
        ("calendar", "d", "stats", "deep_work_conflicts", "Board review"), ("email", "d", "stats", "x", "Board review")],
        "source string, entry_key string, section string, category string, text string").select(F.lit("t").alias("tenant_id"), "*")
    entries = items.select("tenant_id", "source", "entry_key").distinct()
    scenarios = spark.createDataFrame([
        ("calendar", "both", "d", [["KESTREL"], ["bay 7", "Budget"]], None, ["notable_events"]),
        ("calendar", "scoped", "d", [["welding"]], None, ["notable_events"]),
        ("calendar", "facts count", "d", [["board review"]], None, ["notable_events"]),
        ("email", "facts do not", "d", [["board review"]], None, None),
        ("calendar", "absent", "z", [["x"]], None, None),
        ("calendar", "clean", "d", None, ["blake"], None),
        ("calendar", "dirty", "d", None, ["blake", "WELD"], ["notable_events"])],
        "source string, name string, entry_key string, required_keywords array<array<string>>, forbidden_keywords array<string>, expected_category array<string>"
    ).select(F.lit("t").alias("tenant_id"), "*")
    assert rows(evaluation.score_scenarios(scenarios, entries, items), "name", "detail") == sorted([
        ("both", "OK"), ("scoped", "missing keywords: 1"), ("facts count", "OK"), ("facts do not", "missing keywords: 1"), ("absent", "no entry"),
        ("clean", "OK"), ("dirty", "forbidden keyword found")])


def test_accuracy_and_verdict(spark):
    trials = spark.createDataFrame([("e", "a", "s1", "P0", "P0"), ("e", "a", "s1", "P0", "P1"), ("e", "a", "s2", "P1", "P1"), ("e", "b", "s1", "P0", "P0"),
                                    ("e", "b", "s3", "P0", None)], "eval_name string, variant string, scenario string, expected string, result string")
    scored = evaluation.trial_accuracy(trials)
    assert rows(scored, "variant", "scenario", "accuracy") == [("a", "s1", 0.5), ("a", "s2", 1.0), ("b", "s1", 1.0), ("b", "s3", 0.0)]
    verdict = one(evaluation.compare_variants(evaluation.variant_accuracy(scored), "a", "b"), "verdict")
    assert verdict == ("improved",)
    records = evaluation.run_records(scored, spark.createDataFrame([("e", "a", "m")], "eval_name string, variant string, model string"))
    assert records.first().scenarios["s1"].accuracy == 0.5


def test_found_priority_and_bloat(spark):
    items = spark.createDataFrame([("action_items", 0, "Ask Dario", "P2"), ("deadlines", 1, "dario call", "P0"), ("deadlines", 2, "Dario", "P1"), ("thread_progressions", 0, "Ines", "P0")],
                                  "category string, ordinal bigint, text string, priority string").select(
        F.lit("t").alias("tenant_id"), F.lit("email").alias("source"), F.lit("d").alias("entry_key"), F.lit("delta").alias("section"), "category", "ordinal", "text",
        F.to_json(F.struct("priority")).alias("payload"))
    probes = spark.createDataFrame([("a", "DARIO"), ("b", "ines")], "name string, match_on string").select(
        F.lit("t").alias("tenant_id"), F.lit("email").alias("source"), "name", F.lit("d").alias("entry_key"), "match_on")
    assert rows(evaluation.found_priority(items, probes), "name", "priority") == [("a", "P0"), ("b", "not_found")]
    entries = spark.createDataFrame([("t", "email", "d", 1)], "tenant_id string, source string, entry_key string, item_count int")
    many = items.crossJoin(spark.range(3))
    assert evaluation.extraction_bloat(entries, items, "email").count() == 0
    assert one(evaluation.extraction_bloat(entries, many, "email"), "n_items", "ceiling") == (12, 8)


def test_failure_runs_cross_hours_and_need_the_threshold(spark):
    outcomes = [True, False, False, False, True, False, False, False, False, False]
    calls = spark.createDataFrame([(i, "p", "m", ok) for i, ok in enumerate(outcomes)], "call_id int, provider string, model string, success boolean").withColumn(
        "ts", F.timestamp_add("MINUTE", F.col("call_id") * 25, F.lit("2024-05-01 00:00:00").cast("timestamp")))
    assert rows(call_log.failure_runs(calls, 3), "n_failures") == [(3,), (5,)]
    assert rows(call_log.failure_runs(calls), "n_failures") == [(5,)]


def test_dataset_checks(spark):
    sources = spark.createDataFrame([
        ("email", "e1", "Harbour tour north pier with Lena on Monday"), ("email", "e2", "Wholly different payroll matter"),
        ("notes", "n1", "Harbour tour north pier walk"), ("notes", "n2", "Private thoughts"), ("task", "t1", "Order parts")],
        "source string, ref string, text string").select(F.lit("t").alias("tenant_id"), "source", "ref", F.lit("l").alias("label"), "text")
    assert rows(dataset_checks.exclusive_sources(sources, "email", ("calendar", "notes", "task")), "ref") == [("e2",)]
    events = spark.createDataFrame([("t", "ev", "Harbour tour north pier", "", "2024-05-04")], "tenant_id string, uid string, summary string, description string, date_key string")
    wrong = dataset_checks.date_inconsistencies(events, sources, ["2024-05-04", "2024-05-05", "2024-05-06"])
    assert rows(wrong, "source_ref", "claimed_weekday", "claimed_date") == [("e1", "monday", "2024-05-06")]
    quality = dataset_checks.dataset_quality(sources, events.select("tenant_id"), wrong).first()
    assert (quality.exclusive, quality.min_required, quality.exclusive_ok, quality.notes_exclusive, quality.has_conflict, quality.date_consistent) == (1, 1, True, 1, True, False)


def test_dataset_quality_leaves_no_index(spark):
    sources = spark.createDataFrame([
        ("email", "e1", "Harbour tour north pier"), ("email", "e2", "Wholly different payroll matter"), ("notes", "n1", "Harbour tour north pier walk")],
        "source string, ref string, text string").select(F.lit("t").alias("tenant_id"), "source", "ref", F.lit("l").alias("label"), "text")
    none = sources.limit(0).select("tenant_id")

    def stored():
        return {name for name in os.listdir(shared_dir(spark).removeprefix("file:")) if name.startswith(("source-index", "claim-words"))}

    before = stored()
    quality = dataset_checks.dataset_quality(sources, none, none)
    assert stored() == before
    assert rows(quality, "exclusive", "notes_exclusive", "has_conflict") == [(1, 0, False)]
