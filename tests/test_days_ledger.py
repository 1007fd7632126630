from conftest import one, rows
from pyspark.sql import functions as F
from test_sources import entries

from worksignal import schemas
from worksignal.operators import compaction, days, ledger_health
from worksignal.plans.map_plan import new_days
from worksignal.sources.records import processed_keys


def batches(spark, *day_counts, tenant="t"):
    df = spark.createDataFrame([(tenant, d) for d, n in day_counts for _ in range(n)], "tenant_id string, date_key string")
    return df


def five(spark):
    return days.day_batches(batches(spark, *[(f"2024-05-0{i}", i) for i in range(1, 6)]))


def held(df):
    return [r.date_key for r in df.filter("held_out").orderBy("date_key").collect()]


def test_window_and_holdout(spark):
    b = five(spark)
    assert rows(days.windowed_days(b, 2), "date_key", "item_count") == [("2024-05-04", 4), ("2024-05-05", 5)]
    assert held(days.windowed_days(b, holdout_days=2)) == ["2024-05-04", "2024-05-05"]
    assert held(days.windowed_days(b, holdout_days=5)) == [] == held(days.windowed_days(b, holdout_days=9))
    both = days.windowed_days(b, 3, 2)
    assert held(both) == ["2024-05-04", "2024-05-05"] and both.count() == 3
    assert held(days.windowed_days(b, 2, 2)) == []


def test_two_passes_equal_one(spark):
    items = batches(spark, ("2024-05-01", 1), ("2024-05-02", 2), ("2024-05-03", 1))
    nothing = processed_keys(entries(spark, ("x", "email", "2020-01-01", None, 1)))
    first = new_days(items, nothing, "email", holdout_days=1)
    ledger = first.select("tenant_id", F.lit("email").alias("source"), F.col("date_key").alias("unit_key"))
    second = new_days(items, ledger, "email")
    assert rows(second, "date_key") == [("2024-05-03",)]
    assert rows(first.unionByName(second)) == rows(new_days(items, nothing, "email"))


def test_late_items_for_a_done_day_are_left_alone_unless_asked(spark):
    cold = batches(spark, ("2024-05-01", 1), ("2024-05-02", 1))
    merged = days.merge_hot(cold, batches(spark, ("2024-05-01", 1), ("2024-05-03", 1)))
    done = processed_keys(entries(spark, ("t", "email", "2024-05-01", None, 1), ("u", "email", "2024-05-02", None, 1)))
    assert rows(new_days(merged, done, "email"), "date_key", "item_count", "hot") == [("2024-05-02", 1, False), ("2024-05-03", 1, True)]
    assert rows(new_days(merged, done, "email", reprocess_hot=True), "date_key") == [("2024-05-01",), ("2024-05-02",), ("2024-05-03",)]


def item(spark, *values):
    df = spark.createDataFrame(list(values), "source string, entry_key string, ordinal bigint, text string, priority string")
    return df.select(F.lit("t").alias("tenant_id"), "source", "entry_key", F.lit("delta").alias("section"), F.lit("decisions").alias("category"),
                     "ordinal", F.to_json(F.struct(F.col("text").alias("description"), "priority")).alias("payload"), "text")


def test_compaction(spark):
    ledger = entries(spark, ("t", "email", "2024-04-01", None, 2), ("t", "email", "2024-04-03", None, 3), ("t", "email", "2024-04-10", None, 4),
                     ("t", "email", "2024-05-05", None, 5), ("t", "email", "unknown", None, 1), ("t", "notes", "2024-04-02", "a.md", 1),
                     ("t", "notes", "2024-04-02", "b.md", 6))
    items = item(spark, ("email", "2024-04-01", 0, "same", "P3"), ("email", "2024-04-03", 0, "same", "P3"), ("email", "2024-04-01", 1, "hot", "P0"),
                 ("email", "2024-04-03", 1, "hot", "P0"), ("email", "2024-05-05", 0, "same", "P3"))
    after, merged, cover = compaction.compact(ledger, items, "2024-05-10", 30)
    assert rows(after, "source", "entry_key", "item_count", "compacted") == sorted([
        ("email", "2024-W14", 5, True), ("email", "2024-04-10", 4, False), ("email", "2024-05-05", 5, False), ("email", "unknown", 1, False),
        ("notes", "2024-W14", 7, True)], key=repr)
    assert str(after.filter("source = 'email' AND compacted").first().sort_day) == "2024-04-01"
    assert rows(merged, "entry_key", "text") == sorted([("2024-W14", "same"), ("2024-W14", "hot"), ("2024-W14", "hot"), ("2024-05-05", "same")], key=repr)
    assert rows(cover, "entry_key", "day", "note_id", "item_count") == sorted([
        ("2024-W14", "2024-04-01", None, 2), ("2024-W14", "2024-04-03", None, 3), ("2024-W14", "2024-04-02", "a.md", 1), ("2024-W14", "2024-04-02", "b.md", 6)],
        key=repr)
    total = lambda df: df.agg(F.sum("item_count")).first()[0]
    assert total(after) == total(ledger)
    keys = rows(processed_keys(after, cover), "source", "unit_key")
    assert ("email", "2024-04-01") in keys and ("notes", "b.md") in keys and ("email", "2024-W14") not in keys
    again, _, _ = compaction.compact(after, merged, "2024-05-10", 30)
    assert rows(again) == rows(after)


def test_a_week_without_a_model_answer_keeps_its_days(spark):
    ledger = entries(spark, ("t", "email", "2024-04-01", None, 2), ("t", "email", "2024-04-08", None, 3))
    answered = item(spark, ("email", "2024-W14", 0, "merged", "P1"))
    after, items, _ = compaction.compact(ledger, answered.limit(0), "2024-06-01", 30, answered)
    assert rows(after, "entry_key") == [("2024-04-08",), ("2024-W14",)]
    assert rows(items, "text") == [("merged",)]


def test_freshness(spark):
    ledger = entries(spark, ("t", "email", "2024-05-09", None, 1), ("t", "notes", "2024-05-01", "n", 1), ("t", "notes", "unknown", "m", 1))
    expected = ledger_health.expected_sources(ledger, ["email", "calendar", "notes"])
    assert rows(ledger_health.freshness(ledger, expected, "2024-05-10"), "source", "most_recent_day", "days_stale", "is_stale") == [
        ("calendar", None, None, True), ("email", "2024-05-09", 1, False), ("notes", "2024-05-01", 9, True)]


def test_mixed_variants(spark):
    ledger = entries(spark, *[("t", "email", f"2024-05-0{i}", None, 1) for i in range(1, 5)])
    mixed = ledger.withColumn("map_variant", F.when(F.col("day") < "2024-05-03", F.lit("persona")))
    assert one(ledger_health.mixed_variants(mixed)) == ("t", "email", 2, "persona: 2, unversioned: 2")
    assert ledger_health.mixed_variants(ledger).count() == 0
    rolled = mixed.withColumn("compacted", F.col("map_variant").isNull())
    assert ledger_health.mixed_variants(rolled).count() == 0
    assert "2 different" in ledger_health.variant_warning(ledger_health.mixed_variants(mixed)).first().warning


def test_a_large_folder_is_written_by_several_tasks(spark, tmp_path):
    from worksignal.sources import records

    rows_ = spark.range(4000).select(
        F.lit("t").alias("tenant_id"), F.lit("email").alias("source"), F.format_string("%05d", "id").alias("entry_key"), F.lit("delta").alias("section"),
        F.lit("c").alias("category"), F.col("id").alias("ordinal"), F.lit("{}").alias("payload"), F.lit("x").alias("text"))
    path = str(tmp_path / "items")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these few bytes would go to one task
    records.append_ledger(rows_, path, rows_per_file=100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    stored = records.read_ledger(spark, path, schemas.LEDGER_ITEMS)
    assert stored.count() == 4000 and stored.select(F.input_file_name()).distinct().count() > 1
    records.replace_ledger(rows_.limit(10), path)
    assert records.read_ledger(spark, path, schemas.LEDGER_ITEMS).count() == 10
