"""The streaming jobs run to the end of the given events, in the shared folder."""

from pyspark.sql import functions as F

from worksignal.catalog.registry import query, table
from worksignal.catalog.shapes import mail
from worksignal.plans.map_plan import mail_facts
from worksignal.session import fresh_path
from worksignal.sources import runs
from worksignal.streaming import day_stream, progress, quiet_sender


def _event_stream(spark, sf):
    """Events as a stream; the event time must be TIMESTAMP."""
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


@query("closed_days_stream", """
SELECT CAST(user_id AS VARCHAR) AS tenant_id, strftime(ts, '%Y-%m-%d') AS date_key, count(*) AS item_count FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 2 DAY GROUP BY 1, 2
""")
def closed_days_stream_q(spark, sf):
    stream = _event_stream(spark, sf).withColumn("tenant_id", F.col("user_id").cast("string"))
    closed = day_stream.closed_days(stream, "ts", 2)
    return day_stream.settle(closed, fresh_path(spark, "closed-days"), fresh_path(spark, "closed-days-state"))


@query("week_counts_stream", """
SELECT event_type AS tenant_id, CAST(date_trunc('week', ts) AS DATE) AS week_start, count(*) AS item_count FROM events
WHERE date_trunc('week', ts) + INTERVAL 7 DAY <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 5 DAY GROUP BY 1, 2
""")
def week_counts_stream_q(spark, sf):
    stream = _event_stream(spark, sf).withColumn("tenant_id", F.col("event_type"))
    weeks = day_stream.week_counts(stream, "ts", 5)
    return day_stream.settle(weeks, fresh_path(spark, "weeks"), fresh_path(spark, "weeks-state"))


@query("first_of_each_stream", """
SELECT CAST(user_id AS VARCHAR) AS tenant_id, event_type, count(*) > 0 AS seen FROM events GROUP BY 1, 2
""")
def first_of_each_stream_q(spark, sf):
    stream = _event_stream(spark, sf).select(F.col("user_id").cast("string").alias("tenant_id"), "event_type", "ts")
    first = day_stream.first_of_each(stream, "ts", "60 days", ["tenant_id", "event_type"])
    rows = day_stream.settle(first, fresh_path(spark, "first"), fresh_path(spark, "first-state"))
    return rows.groupBy("tenant_id", "event_type").agg((F.count("*") == 1).alias("seen"))


@query("ledger_stream", """
SELECT CAST(user_id AS VARCHAR) AS tenant_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS item_count, count(*) FILTER (WHERE event_type = 'click') AS reply_count,
       bool_or(event_type = 'purchase') AS hot
FROM events GROUP BY 1, 2
""")
def ledger_stream_q(spark, sf):
    stream = _event_stream(spark, sf).select(
        F.col("user_id").cast("string").alias("tenant_id"), F.date_format("ts", "yyyy-MM-dd").alias("date_key"),
        F.concat(F.col("event_type"), F.lit("@example.org")).alias("from_hdr"),
        F.when(F.col("event_type") == "click", F.lit("re: it")).otherwise(F.lit("it")).alias("subject"), F.col("props").alias("body"),
        (F.col("event_type") == "purchase").alias("is_hot"),
    )
    path = fresh_path(spark, "ledger")
    for attempt in ("first", "replay"):  # the second run finds every day done and adds nothing
        state = fresh_path(spark, f"ledger-{attempt}")
        day_stream.run_ledger_stream(stream, path, state, "email", mail_facts)
    return runs.read_table(spark, path, "entries").select(
        "tenant_id", "day", "item_count", F.col("stats.reply_count").cast("bigint").alias("reply_count"), "hot"
    )


@query("quiet_sender_stream", """
SELECT event_type AS tenant_id, CAST(user_id AS VARCHAR) AS email, count(*) AS item_count, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen
FROM events GROUP BY 1, 2 HAVING max(ts) <= (SELECT max(ts) FROM events) - INTERVAL 3 DAY
""")
def quiet_sender_stream_q(spark, sf):
    stream = _event_stream(spark, sf).select(
        F.col("event_type").alias("tenant_id"), F.col("user_id").cast("string").alias("email"), F.col("ts").alias("seen")
    )
    quiet = quiet_sender.quiet_sender_stream(stream, 3)
    rows = day_stream.settle(quiet, fresh_path(spark, "quiet"), fresh_path(spark, "quiet-state"))
    shown = "yyyy-MM-dd HH:mm:ss"
    return rows.select("tenant_id", "email", "item_count", F.date_format("first_seen", shown).alias("first_seen"),
                       F.date_format("last_seen", shown).alias("last_seen"))


@query("late_events_stream", """
WITH parts AS (SELECT *, CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN 'first' ELSE 'late' END AS run FROM events),
mark AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 DAY AS w FROM parts WHERE run = 'first')
SELECT run, count(*) AS n_arrived, count(*) FILTER (WHERE run = 'late' AND ts <= (SELECT w FROM mark)) AS n_late,
       count(DISTINCT event_id) FILTER (WHERE NOT (run = 'late' AND ts <= (SELECT w FROM mark))) AS n_kept FROM parts GROUP BY run
""")
def late_events_stream_q(spark, sf):
    """The newest events arrive first and the others after them, too late to count: the log of progress says how many."""
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    arrivals, log, out, state = (fresh_path(spark, f"late-{name}") for name in ("arrivals", "log", "out", "state"))
    found = []
    for run, part in (("first", F.col("ts") >= "2024-01-20"), ("late", F.col("ts") < "2024-01-20")):
        events.filter(part).write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(events.schema).parquet(arrivals)
        day_stream.settle(day_stream.first_of_each(stream, "ts", "2 days", ["event_id"]), out, state, f"{log}/{run}")
        told = progress.read_progress(spark, f"{log}/{run}")
        found.append(told.agg(F.sum("input_rows").alias("n_arrived"), F.sum("late_rows").alias("n_late")).withColumn("run", F.lit(run)))
    kept = spark.read.schema(events.schema).parquet(out)
    kept = kept.groupBy(F.when(F.col("ts") >= "2024-01-20", "first").otherwise("late").alias("run")).agg(F.count("*").alias("n_kept"))
    return found[0].union(found[1]).join(kept, "run", "left").select("run", "n_arrived", "n_late", F.coalesce("n_kept", F.lit(0)).alias("n_kept"))
