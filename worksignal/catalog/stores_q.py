"""What is written comes back: briefs, the call log, snapshots of runs; listings and the notes stage."""

import json

from pyspark.sql import functions as F

from worksignal import schemas
from worksignal.catalog.registry import MAIL_SQL, query, table
from worksignal.catalog.shapes import mail, order_tasks
from worksignal.functions.constants import TENANT_PATTERN
from worksignal.catalog.sources_q import _NOTES_SQL, _notes
from worksignal.plans import map_plan
from worksignal.session import fresh_path
from worksignal.sources.citable import browse_emails, browse_notes
from worksignal.sources.notes import parse_notes
from worksignal.sources.records import append_calls, append_eval_runs, processed_keys, read_calls, read_eval_runs, save_brief, save_items
from worksignal.sources.tenants import valid_tenants


@query("browse_emails", f"""
SELECT subject, name || ' <' || email || '>' AS from_hdr, 'Owner <owner@example.org>' AS to_hdr, date_iso, date_key, body,
       printf('%012d.eml', event_id) AS filename FROM ({MAIL_SQL})
""")
def browse_emails_q(spark, sf):
    return browse_emails(mail(spark, sf)).drop("tenant_id")


@query("browse_notes", f"""
SELECT note_id, CASE WHEN undated THEN note_id ELSE 'Order ' || o_orderkey END AS title, created_at AS date_key FROM ({_NOTES_SQL})
""")
def browse_notes_q(spark, sf):
    return browse_notes(parse_notes(_notes(spark, sf))).select("note_id", "title", "date_key")


@query("brief_store", """
SELECT CAST(conv_id AS VARCHAR) AS tenant_id, text AS brief, 'run ' || turn AS run_ts, turn = (SELECT max(turn) FROM conversations) AS is_current FROM conversations
""")
def brief_store_q(spark, sf):
    base = fresh_path(spark, "briefs")
    talk = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("tenant_id"), F.col("text").alias("brief"), "turn")
    for turn in range(talk.agg(F.max("turn")).first()[0] + 1):  # a conversation has eight turns at most
        save_brief(talk.filter(F.col("turn") == turn).drop("turn"), base, f"run {turn}")
    schema = "tenant_id string, brief string, run_ts string"
    history = spark.read.schema(schema).parquet(f"{base}/history")
    current = spark.read.schema(schema).parquet(f"{base}/current").withColumn("is_current", F.lit(True))
    joined = history.join(current, ["tenant_id", "brief", "run_ts"], "left")
    return joined.withColumn("is_current", F.coalesce("is_current", F.lit(False)))


@query("call_log_store", """
SELECT CAST(user_id AS VARCHAR) AS tenant_id, event_type AS provider, CAST(count(*) AS BIGINT) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_call,
       count(*) FILTER (WHERE event_type <> 'error') AS n_ok FROM events GROUP BY 1, 2
""")
def call_log_store_q(spark, sf):
    path = fresh_path(spark, "calls")
    calls = table(spark, sf, "events").select(
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("ts"), F.col("user_id").cast("string").alias("tenant_id"),
        F.col("event_type").alias("provider"), F.lit("m").alias("model"), F.col("value").alias("latency_ms"),
        (F.col("event_type") != "error").alias("success"), F.lit(0).alias("retries"), F.lit("closed").alias("breaker_state"),
    )
    for part in (calls.filter("success"), calls.filter("NOT success")):
        append_calls(part, path)
    return read_calls(spark, path).groupBy("tenant_id", "provider").agg(
        F.count("*").alias("n"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_call"), F.count_if("success").alias("n_ok")
    )


@query("eval_history", """
SELECT o_orderpriority AS eval_name, o_orderstatus AS variant, CAST(count(*) AS BIGINT) AS n_runs, CAST(sum(o_orderkey) AS BIGINT) AS ts
FROM orders GROUP BY 1, 2
""")
def eval_history_q(spark, sf):
    path = fresh_path(spark, "evals")
    runs = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("ts"), F.col("o_orderpriority").alias("eval_name"), F.col("o_orderstatus").alias("variant"),
        F.lit("m").alias("model"), F.lit(1).alias("trials_per_scenario"),
    )
    append_eval_runs(runs, path)
    chosen = [read_eval_runs(spark, path, variant=v) for v in ("F", "O", "P")]
    return chosen[0].union(chosen[1]).union(chosen[2]).groupBy("eval_name", "variant").agg(
        F.count("*").alias("n_runs"), F.sum(F.col("ts").cast("bigint")).alias("ts")
    )


@query("map_notes_entries", f"""
SELECT note_id AS entry_key, created_at AS day, CAST(3 AS BIGINT) AS item_count, CAST(NOT settled AS BIGINT) + CAST(NOT big AS BIGINT) AS checklist_open
FROM ({_NOTES_SQL}) WHERE NOT big
""")
def map_notes_entries_q(spark, sf):
    """Notes whose model answer fits; that of notes with the large order's box ticked does not."""
    def answer(system_text, user_text):
        kept = {"note_type": "order", "decisions": [], "open_items_still_relevant": [], "key_people": []}
        return "[]" if "- [x]  big" in user_text else json.dumps(kept)

    none = processed_keys(spark.createDataFrame([], schemas.LEDGER_ENTRIES))
    entries, _, _ = map_plan.map_notes(parse_notes(_notes(spark, sf)), none, answer, "1998-06-15")
    return entries.select("entry_key", "day", "item_count", F.col("stats.checklist_open").cast("bigint").alias("checklist_open"))


@query("valid_tenants", f"""
SELECT tenant_id, count(*) AS n FROM (SELECT unnest(string_split(url, '/')) AS tenant_id FROM pages) WHERE regexp_full_match(tenant_id, '{TENANT_PATTERN}') GROUP BY 1
""")
def valid_tenants_q(spark, sf):
    """Parts of addresses as tenant ids, of which only safe ones may name a folder."""
    parts = table(spark, sf, "pages").select(F.explode(F.split("url", "/")).alias("tenant_id"))
    return valid_tenants(parts).groupBy("tenant_id").agg(F.count("*").alias("n"))


@query("items_file", """
SELECT CAST(o_custkey AS VARCHAR) AS tenant_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'blocked' ELSE 'todo' END AS status,
       count(*) AS n, CAST(max(o_orderkey) AS BIGINT) AS last FROM orders GROUP BY 1, 2
""")
def items_file_q(spark, sf):
    """Orders as items, through the JSON file they are saved in."""
    path = fresh_path(spark, "items")
    save_items(order_tasks(spark, sf), path)
    stored = spark.read.schema("tenant_id string, id string, status string").json(path)
    number = F.substring("id", 5, 20).cast("bigint")
    return stored.groupBy("tenant_id", "status").agg(F.count("*").alias("n"), F.max(number).alias("last"))
