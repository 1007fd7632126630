"""Day windows, incremental processing and ledger upkeep over events."""

from pyspark.sql import functions as F

from worksignal.catalog.registry import query, table
from worksignal.catalog.shapes import user_days
from worksignal.functions.dates import day_label, iso_week, sort_day
from worksignal.operators import compaction, days, ledger_health
from worksignal.plans import map_plan
from worksignal.operators.ordered import next_value, ordinal
from worksignal.plans.map_plan import new_days
from worksignal.sources.records import latest_briefs, processed_keys

_DAYS = """
SELECT CAST(user_id AS VARCHAR) AS tenant_id, strftime(ts, '%Y-%m-%d') AS date_key, count(*) AS item_count FROM events GROUP BY 1, 2
"""


@query("digest_window", f"""
SELECT tenant_id, date_key, item_count, rn <= 2 AND 2 < least(n, 7) AS held_out FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY date_key DESC) AS rn, count(*) OVER (PARTITION BY tenant_id) AS n
  FROM ({_DAYS})) WHERE rn <= 7
""")
def digest_window_q(spark, sf):
    return days.windowed_days(days.day_batches(user_days(spark, sf)), 7, 2).drop("hot")


@query("holdout", f"""
SELECT tenant_id, date_key FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY date_key DESC) AS rn, count(*) OVER (PARTITION BY tenant_id) AS n
  FROM ({_DAYS})) WHERE rn <= 25 AND 25 < n
""")
def holdout_q(spark, sf):
    held = days.windowed_days(days.day_batches(user_days(spark, sf)), holdout_days=25).filter("held_out")
    return held.select("tenant_id", "date_key")


def _entries(spark, sf):
    """Ledger entries of events: one per user, event type (as source) and day."""
    return table(spark, sf, "events").groupBy(
        F.col("user_id").cast("string").alias("tenant_id"), F.col("event_type").alias("source"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
    ).agg(F.count("*").alias("item_count")).select(
        "tenant_id", "source", F.col("day").alias("entry_key"), "day", F.lit(None).cast("string").alias("note_id"), "item_count",
        F.create_map(F.lit("events"), F.col("item_count").cast("double")).alias("stats"),
        F.lit("persona").alias("map_variant"), F.lit(False).alias("hot"), F.lit(False).alias("compacted"),
        sort_day(F.col("day"), F.lit(False)).alias("sort_day"),
    )


@query("incremental_diff", """
SELECT CAST(user_id AS VARCHAR) AS tenant_id, strftime(ts, '%Y-%m-%d') AS date_key, count(*) AS item_count FROM events e
WHERE NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'click'
                  AND CAST(p.ts AS DATE) = CAST(e.ts AS DATE)) GROUP BY 1, 2
""")
def incremental_diff_q(spark, sf):
    ledger = processed_keys(_entries(spark, sf).filter("source = 'click'"))
    return new_days(user_days(spark, sf), ledger, "click").drop("hot")


@query("hot_merge", """
SELECT CAST(user_id AS VARCHAR) AS tenant_id, strftime(ts, '%Y-%m-%d') AS date_key, count(*) AS item_count,
       bool_or(event_type = 'purchase') AS hot FROM events GROUP BY 1, 2
""")
def hot_merge_q(spark, sf):
    rows = user_days(spark, sf)
    return days.day_batches(days.merge_hot(rows.filter("event_type <> 'purchase'"), rows.filter("event_type = 'purchase'")))


_ENTRIES_SQL = """
SELECT CAST(user_id AS VARCHAR) AS tenant_id, event_type AS source, CAST(ts AS DATE) AS d, count(*) AS item_count FROM events GROUP BY 1, 2, 3
"""


@query("weekly_compaction", f"""
SELECT tenant_id, source, CASE WHEN old THEN strftime(d, '%G-W%V') ELSE strftime(d, '%Y-%m-%d') END AS entry_key,
       CAST(sum(item_count) AS BIGINT) AS item_count, old AS compacted,
       CAST(min(CASE WHEN old THEN CAST(date_trunc('week', d) AS DATE) ELSE d END) AS DATE) AS sort_day
FROM (SELECT *, d < DATE '2024-01-30' - 14 AS old FROM ({_ENTRIES_SQL})) GROUP BY tenant_id, source, 3, old
""")
def weekly_compaction_q(spark, sf):
    entries, _, _ = compaction.compact(_entries(spark, sf), _items(spark, sf), "2024-01-30", 14)
    return entries.select("tenant_id", "source", "entry_key", "item_count", "compacted", "sort_day")


@query("compaction_cover", f"""
SELECT tenant_id, source, strftime(d, '%G-W%V') AS entry_key, strftime(d, '%Y-%m-%d') AS day, item_count FROM ({_ENTRIES_SQL})
WHERE d < DATE '2024-01-30' - 14
""")
def compaction_cover_q(spark, sf):
    _, _, cover = compaction.compact(_entries(spark, sf), _items(spark, sf), "2024-01-30", 14)
    return cover.select("tenant_id", "source", "entry_key", "day", "item_count")


def _items(spark, sf):
    """One extracted item per event; purchases are important and so never merged."""
    priority = F.when(F.col("event_type") == "purchase", F.lit("P1")).otherwise(F.lit("P3"))
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("tenant_id"), F.col("event_type").alias("source"),
        F.date_format("ts", "yyyy-MM-dd").alias("entry_key"), F.lit("delta").alias("section"), F.lit("decisions").alias("category"),
        F.col("event_id").alias("ordinal"),
        F.to_json(F.struct(F.col("props").alias("description"), priority.alias("priority"))).alias("payload"),
        F.col("props").alias("text"),
    )


@query("compaction_items", """
SELECT CAST(user_id AS VARCHAR) AS tenant_id, event_type AS source,
       CASE WHEN old THEN strftime(d, '%G-W%V') ELSE strftime(d, '%Y-%m-%d') END AS entry_key, props AS text,
       count(*) AS n_events, CASE WHEN old AND event_type <> 'purchase' THEN 1 ELSE count(*) END AS n_items
FROM (SELECT *, CAST(ts AS DATE) AS d, CAST(ts AS DATE) < DATE '2024-01-30' - 14 AS old FROM events) GROUP BY 1, 2, 3, 4, old, event_type
""")
def compaction_items_q(spark, sf):
    source = _items(spark, sf)
    _, items, _ = compaction.compact(_entries(spark, sf), source, "2024-01-30", 14)
    merged = items.groupBy("tenant_id", "source", "entry_key", "text").agg(F.count("*").alias("n_items"))
    day = F.col("entry_key").cast("date")
    key = F.when(day < F.date_sub(F.lit("2024-01-30").cast("date"), 14), iso_week(day)).otherwise(F.col("entry_key"))
    before = source.groupBy("tenant_id", "source", key.alias("entry_key"), "text").agg(F.count("*").alias("n_events"))
    return before.join(merged, ["tenant_id", "source", "entry_key", "text"], "left")


@query("weekly_merge_requests", """
SELECT tenant_id, source || '|' || week AS unit_key, 'Items of week ' || week || ':' || chr(10) || chr(10)
  || string_agg(day || ' decisions: ' || payload, chr(10) ORDER BY day, event_id) AS user_text FROM (
  SELECT CAST(user_id AS VARCHAR) AS tenant_id, event_type AS source, strftime(ts, '%G-W%V') AS week, strftime(ts, '%Y-%m-%d') AS day, event_id,
    CAST(json_object('description', props, 'priority', CASE WHEN event_type = 'purchase' THEN 'P1' ELSE 'P3' END) AS VARCHAR) AS payload
  FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-30' - 14) GROUP BY tenant_id, source, week
""")
def weekly_merge_requests_q(spark, sf):
    _, stale = compaction.split_by_age(_entries(spark, sf), "2024-01-30", 14)
    return map_plan.week_units(stale, _items(spark, sf))


@query("variant_consistency", """
SELECT tenant_id, count(*) AS n_variants, string_agg(v || ': ' || n, ', ' ORDER BY v) AS breakdown FROM (
  SELECT CAST(user_id AS VARCHAR) AS tenant_id, CASE WHEN event_type = 'error' THEN 'unversioned' ELSE event_type END AS v, count(*) AS n
  FROM (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS d FROM events) GROUP BY 1, 2) GROUP BY 1 HAVING count(*) > 1
""")
def variant_consistency_q(spark, sf):
    entries = _entries(spark, sf).withColumn("map_variant", F.when(F.col("source") != "error", F.col("source")))
    return ledger_health.mixed_variants(entries.withColumn("source", F.lit("email"))).drop("source")


@query("freshness", """
SELECT u.tenant_id, s.source, strftime(max(e.ts), '%Y-%m-%d') AS most_recent_day,
       CAST(date_diff('day', CAST(max(e.ts) AS DATE), DATE '2024-01-30') AS INT) AS days_stale,
       coalesce(date_diff('day', CAST(max(e.ts) AS DATE), DATE '2024-01-30') > 1, true) AS is_stale
FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS tenant_id FROM events) u
CROSS JOIN (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view', 'fax']) AS source) s
LEFT JOIN events e ON CAST(e.user_id AS VARCHAR) = u.tenant_id AND e.event_type = s.source GROUP BY 1, 2
""")
def freshness_q(spark, sf):
    entries = _entries(spark, sf)
    expected = ledger_health.expected_sources(entries, ["click", "error", "purchase", "signup", "view", "fax"])
    return ledger_health.freshness(entries, expected, "2024-01-30")


@query("day_labels", """
SELECT day, n, CASE WHEN age = 0 THEN 'TODAY' WHEN age = 1 THEN 'YESTERDAY' WHEN age > 1 THEN age || ' DAYS AGO — NOT today' ELSE day END AS label
FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, date_diff('day', CAST(ts AS DATE), DATE '2024-01-28') AS age FROM events GROUP BY 1, 3)
""")
def day_labels_q(spark, sf):
    per_day = table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return per_day.withColumn("label", day_label(F.col("day"), "2024-01-28"))


@query("iso_weeks", """
SELECT strftime(o_orderdate, '%G-W%V') AS week, CAST(min(date_trunc('week', o_orderdate)) AS DATE) AS monday, count(*) AS n FROM orders GROUP BY 1
""")
def iso_weeks_q(spark, sf):
    weeks = table(spark, sf, "orders").groupBy(iso_week(F.col("o_orderdate").cast("date")).alias("week")).agg(F.count("*").alias("n"))
    return weeks.select("week", sort_day(F.col("week"), F.lit(True)).alias("monday"), "n")


@query("latest_per_tenant", """
SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id
""")
def latest_per_tenant_q(spark, sf):
    return latest_briefs(table(spark, sf, "conversations").select("conv_id", "turn", "text"), None, "conv_id", "turn")


@query("latest_brief_as_of", """
SELECT CAST(user_id AS VARCHAR) AS tenant_id, arg_max(props, (strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), event_id)) AS brief, strftime(max(ts), '%Y-%m-%d') AS day FROM events
WHERE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') <= '2024-01-20' GROUP BY 1
""")
def latest_brief_as_of_q(spark, sf):
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.format_string(" %012d", "event_id"))
    history = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("tenant_id"), F.col("props").alias("brief"), stamp.alias("run_ts")
    )
    return latest_briefs(history, "2024-01-20").select("tenant_id", "brief", F.substring("run_ts", 1, 10).alias("day"))


@query("ordinals_in_groups", """
SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS ordinal,
       strftime(lead(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id), '%Y-%m-%d %H:%M:%S') AS next_ts FROM events
""")
def ordinals_in_groups_q(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "ts")
    bucket = F.date_trunc("HOUR", F.col("ts").cast("timestamp"))
    numbered = ordinal(events, ["event_type"], bucket, [F.col("ts"), F.col("event_id")])
    following = next_value(numbered, ["event_type"], bucket, [F.col("ts"), F.col("event_id")], "ts", "next_ts")
    return following.select("event_id", "ordinal", F.date_format("next_ts", "yyyy-MM-dd HH:mm:ss").alias("next_ts"))
