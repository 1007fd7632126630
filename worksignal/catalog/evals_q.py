"""Scoring, variant comparison and the call log."""

from pyspark.sql import functions as F

from worksignal.catalog.registry import query, table
from worksignal.catalog.shapes import calendar
from worksignal.operators import calendar_signals, call_log, dataset_checks, evaluation
from worksignal.catalog.calendar_q import CONFLICTS_SQL
from worksignal.catalog.matching_q import EXCLUSIVE_SQL, MATCHES_SQL, _kinds, date_inconsistencies_q


@query("extraction_bloat", """
SELECT CAST(l_orderkey AS VARCHAR) AS entry_key, count(*) AS n_items, any_value(greatest(8, CAST(round_even(n * 4.0, 0) AS BIGINT))) AS ceiling
FROM lineitem JOIN (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS n FROM orders) ON o_orderkey = l_orderkey
GROUP BY l_orderkey HAVING count(*) > any_value(greatest(8, CAST(round_even(n * 4.0, 0) AS BIGINT)))
""")
def extraction_bloat_q(spark, sf):
    entries = table(spark, sf, "orders").select(
        F.lit("main").alias("tenant_id"), F.lit("email").alias("source"), F.col("o_orderkey").cast("string").alias("entry_key"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("item_count"),
    )
    items = table(spark, sf, "lineitem").select(
        F.lit("main").alias("tenant_id"), F.lit("email").alias("source"), F.col("l_orderkey").cast("string").alias("entry_key"),
        F.lit("delta").alias("section"),
    )
    return evaluation.extraction_bloat(entries, items, "email").select("entry_key", "n_items", "ceiling")


@query("scenario_scores", """
WITH items AS (SELECT doc_id, lang, lower(unnest(string_split(text, chr(10)))) AS t FROM documents),
f AS (SELECT l.doc_id, toxic, bool_or(i.doc_id IS NOT NULL) AS has,
        bool_or(coalesce((quality = 0 OR lang IN ('en', 'fr')) AND (contains(t, 'the') OR contains(t, 'le')), false)) AS a,
        bool_or(coalesce((quality = 0 OR lang IN ('en', 'fr')) AND contains(t, 'que'), false)) AS b,
        bool_or(coalesce(contains(t, 'ing'), false)) AS bad
      FROM labels l LEFT JOIN items i USING (doc_id) GROUP BY 1, 2)
SELECT doc_id, CASE WHEN NOT has THEN 'no entry' WHEN toxic = 1 AND bad THEN 'forbidden keyword found'
  WHEN toxic = 0 AND NOT (a AND b) THEN 'missing keywords: ' || (2 - CAST(a AS INT) - CAST(b AS INT)) ELSE 'OK' END AS detail FROM f
""")
def scenario_scores_q(spark, sf):
    docs = table(spark, sf, "documents")
    key = F.col("doc_id").cast("string")
    entries = docs.select(F.lit("main").alias("tenant_id"), F.lit("notes").alias("source"), key.alias("entry_key"))
    items = docs.select(
        F.lit("main").alias("tenant_id"), F.lit("notes").alias("source"), key.alias("entry_key"), F.lit("delta").alias("section"),
        F.col("lang").alias("category"), F.explode(F.split("text", "\n", -1)).alias("text"),
    )
    required = F.array(F.array(F.lit("The"), F.lit("le")), F.array(F.lit("que")))
    scenarios = table(spark, sf, "labels").select(
        F.lit("main").alias("tenant_id"), F.lit("notes").alias("source"), key.alias("name"), key.alias("entry_key"),
        F.when(F.col("toxic") == 0, required).alias("required_keywords"),
        F.when(F.col("toxic") == 1, F.array(F.lit("ING"))).alias("forbidden_keywords"),
        F.when(F.col("quality") == 1, F.array(F.lit("en"), F.lit("fr"))).alias("expected_category"),
    )
    scored = evaluation.score_scenarios(scenarios, entries, items)
    return scored.select(F.col("name").cast("bigint").alias("doc_id"), "detail")


@query("found_priority", """
SELECT o_orderkey, coalesce(priority, 'not_found') AS priority FROM orders LEFT JOIN (
  SELECT l_orderkey, arg_min('P' || (l_linenumber % 5), (CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END, l_linenumber)) AS priority
  FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) ON o_orderkey = l_orderkey
""")
def found_priority_q(spark, sf):
    key = F.col("l_orderkey").cast("string")
    category = F.when(F.col("l_returnflag") == "A", F.lit("deadlines")).when(F.col("l_returnflag") == "N", F.lit("decisions")).otherwise(F.lit("action_items"))
    items = table(spark, sf, "lineitem").select(
        F.lit("main").alias("tenant_id"), F.lit("email").alias("source"), key.alias("entry_key"), F.lit("delta").alias("section"),
        category.alias("category"), F.col("l_linenumber").cast("bigint").alias("ordinal"),
        F.to_json(F.struct(F.concat(F.lit("P"), (F.col("l_linenumber") % 5).cast("string")).alias("priority"))).alias("payload"),
        F.concat(F.lit("line state "), F.col("l_linestatus"), F.lit(".")).alias("text"),
    )
    probes = table(spark, sf, "orders").select(
        F.lit("main").alias("tenant_id"), F.lit("email").alias("source"), F.col("o_orderkey").cast("string").alias("name"),
        F.col("o_orderkey").cast("string").alias("entry_key"), F.lit("State F.").alias("match_on"),
    )
    return evaluation.found_priority(items, probes).select(F.col("name").cast("bigint").alias("o_orderkey"), "priority")


def _trials(spark, sf):
    labels, docs = table(spark, sf, "labels"), table(spark, sf, "documents")
    return labels.join(docs.select("doc_id", "source", "lang"), "doc_id").select(
        F.col("lang").alias("eval_name"), F.when(F.substring("source", -1, 1) < "5", F.lit("low")).otherwise(F.lit("high")).alias("variant"),
        F.col("source").alias("scenario"), F.col("quality").cast("string").alias("expected"), F.col("toxic").cast("string").alias("result"),
    )


_TRIALS = """
  SELECT lang AS eval_name, CASE WHEN source[-1:] < '5' THEN 'low' ELSE 'high' END AS variant, source AS scenario, count(*) AS n_trials,
         count(*) FILTER (WHERE quality = toxic) AS n_correct FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2, 3
"""


@query("eval_accuracy", f"SELECT *, n_correct / n_trials AS accuracy FROM ({_TRIALS})")
def eval_accuracy_q(spark, sf):
    return evaluation.trial_accuracy(_trials(spark, sf))


@query("variant_compare", f"""
SELECT eval_name, b AS base_accuracy, o AS other_accuracy, o - b AS delta,
       CASE WHEN abs(o - b) < 0.10 THEN 'no meaningful difference' WHEN o > b THEN 'improved' ELSE 'hurt' END AS verdict FROM (
  SELECT eval_name, sum(n_correct) FILTER (WHERE variant = 'low') / sum(n_trials) FILTER (WHERE variant = 'low') AS b,
         sum(n_correct) FILTER (WHERE variant = 'high') / sum(n_trials) FILTER (WHERE variant = 'high') AS o FROM ({_TRIALS}) GROUP BY 1)
""")
def variant_compare_q(spark, sf):
    scored = evaluation.trial_accuracy(_trials(spark, sf))
    return evaluation.compare_variants(evaluation.variant_accuracy(scored), "low", "high")


def _calls(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("call_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("tenant_id"),
        F.when(k < 50, F.lit("alpha")).otherwise(F.lit("beta")).alias("provider"), F.lit("m").alias("model"), F.col("value").alias("latency_ms"),
        (F.col("event_type") != "error").alias("success"), (k % 3).alias("retries"), (F.lit(400) + k % 30).alias("status"),
    )


_CALLS_SQL = """
  SELECT event_id, ts, CAST(user_id AS VARCHAR) AS tenant_id, CASE WHEN k < 50 THEN 'alpha' ELSE 'beta' END AS provider, value, event_type <> 'error' AS ok, k % 3 AS retries,
         400 + k % 30 AS status FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
"""


@query("call_metrics", f"""
SELECT tenant_id, provider, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS n_calls, count(*) FILTER (WHERE NOT ok) AS n_failed,
       quantile_disc(value, 0.5) AS median_latency_ms, max(value) AS max_latency_ms, CAST(sum(retries) AS BIGINT) AS retries,
       round(count(*) / 60, 6) AS qps, count(*) / 60 > 2.0 AS over_limit
FROM ({_CALLS_SQL}) GROUP BY 1, 2, 3
""")
def call_metrics_q(spark, sf):
    load = call_log.call_load(_calls(spark, sf))
    return load.select("tenant_id", "provider", F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"), "n_calls", "n_failed",
                       "median_latency_ms", "max_latency_ms", "retries", F.round("qps", 6).alias("qps"), "over_limit")


@query("failure_runs", f"""
SELECT provider, count(*) AS n_failures, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM (
  SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY provider ORDER BY ts, event_id) AS run FROM ({_CALLS_SQL})) WHERE NOT ok
GROUP BY provider, run HAVING count(*) >= 3
""")
def failure_runs_q(spark, sf):
    shown = "yyyy-MM-dd HH:mm:ss"
    return call_log.failure_runs(_calls(spark, sf), 3).select(
        "provider", "n_failures", F.date_format("first_ts", shown).alias("first_ts"), F.date_format("last_ts", shown).alias("last_ts")
    )


@query("error_classes", f"""
SELECT CASE WHEN status IN (400, 401, 402, 403) THEN 'terminal' ELSE 'retryable' END AS error_class, count(*) AS n FROM ({_CALLS_SQL}) WHERE NOT ok GROUP BY 1
""")
def error_classes_q(spark, sf):
    failed = _calls(spark, sf).filter(~F.col("success"))
    return failed.groupBy(call_log.error_class(F.col("status")).alias("error_class")).agg(F.count("*").alias("n"))


@query("variant_averages", """
SELECT o_orderpriority AS eval_name, o_orderstatus AS variant, count(*) AS n_trials, round(avg(n), 6) AS avg_dispatchables,
       round(avg(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))), 6) AS avg_latency_ms
FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1, 2
""")
def variant_averages_q(spark, sf):
    items = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_dispatchables"))
    trials = table(spark, sf, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderpriority").alias("eval_name"), F.col("o_orderstatus").alias("variant"), "n_dispatchables",
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).alias("latency_ms"),
    )
    found = evaluation.variant_averages(trials)
    return found.select("eval_name", "variant", "n_trials", F.round("avg_dispatchables", 6).alias("avg_dispatchables"), F.round("avg_latency_ms", 6).alias("avg_latency_ms"))


@query("dataset_quality", f"""
WITH ex AS ({EXCLUSIVE_SQL})
SELECT d.source AS tenant_id, count(ex.doc_id) AS exclusive, count(*) FILTER (WHERE d.doc_id % 3 = 0) AS total,
       count(ex.doc_id) >= (count(*) FILTER (WHERE d.doc_id % 3 = 0) + 1) // 2 AS exclusive_ok,
       count(*) FILTER (WHERE d.doc_id % 3 = 1) AS notes_total, count(c.tenant_id) > 0 AS has_conflict, count(i.source) = 0 AS date_consistent
FROM documents d LEFT JOIN ex ON ex.doc_id = d.doc_id
LEFT JOIN (SELECT DISTINCT 'src' || (CAST(tenant_id AS BIGINT) % 20) AS tenant_id FROM ({CONFLICTS_SQL})) c ON c.tenant_id = d.source
LEFT JOIN (SELECT DISTINCT source FROM ({MATCHES_SQL}) m JOIN documents USING (doc_id) WHERE item_id % 7 <> doc_id % 7) i ON i.source = d.source GROUP BY 1
""")
def dataset_quality_q(spark, sf):
    tenant = F.concat(F.lit("src"), (F.col("tenant_id").cast("bigint") % 20).cast("string"))
    conflicts = calendar_signals.focus_conflicts(calendar(spark, sf)).select(tenant.alias("tenant_id"))
    odd = date_inconsistencies_q(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    found = dataset_checks.dataset_quality(_kinds(spark, sf), conflicts, odd.select(F.col("source").alias("tenant_id")))
    return found.select("tenant_id", "exclusive", "total", "exclusive_ok", "notes_total", "has_conflict", "date_consistent")
