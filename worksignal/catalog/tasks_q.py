"""Task signals over orders."""

from pyspark.sql import functions as F

from worksignal.catalog.registry import query, table
from worksignal.catalog.shapes import order_tasks
from worksignal.functions.dates import date_urgency
from worksignal.operators import rendering, task_signals

REFERENCE_DATE = "1998-06-15"

TASKS_SQL = """
SELECT CAST(o_custkey AS VARCHAR) AS tenant_id, printf('ORD-%010d', o_orderkey) AS id, 'Settle order ' || o_orderkey AS title,
       CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'blocked' ELSE 'todo' END AS status,
       'P' || (CAST(substr(o_orderpriority, 1, 1) AS INT) - 1) AS priority, strftime(o_orderdate, '%Y-%m-%d') AS due_date,
       CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-06-15') AS INT) AS age, o_orderpriority AS blocked_by,
       coalesce(done, 0) AS subtasks_done, coalesce(total, 0) AS subtasks_total,
       CASE WHEN coalesce(total, 0) = 0 THEN 0.0 ELSE done / total END AS ratio
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) FILTER (WHERE l_linestatus = 'F') AS done, count(*) AS total FROM lineitem GROUP BY 1) p
  ON o_orderkey = l_orderkey
"""
_COLUMNS = "tenant_id, id, title, priority, status, due_date, subtasks_done, subtasks_total"
_BUCKETS = {
    "overdue": f"SELECT {_COLUMNS}, age AS days FROM ({TASKS_SQL}) WHERE status <> 'done' AND age > 0",
    "due_soon": f"SELECT {_COLUMNS}, -age AS days FROM ({TASKS_SQL}) WHERE status <> 'done' AND age BETWEEN -7 AND 0",
    "blocked": f"SELECT {_COLUMNS}, age AS days, blocked_by FROM ({TASKS_SQL}) WHERE status = 'blocked'",
    "stalled": f"SELECT {_COLUMNS}, age AS days, CAST(printf('%.2f', CAST(ratio AS DOUBLE)) AS DOUBLE) AS progress_ratio FROM ({TASKS_SQL}) "
               "WHERE status <> 'done' AND age >= 7 AND ratio < 0.34",
}


def _register(bucket, sql, extra):
    @query(f"task_signals_{bucket}", sql)
    def run(spark, sf):
        signals = task_signals.task_signals(order_tasks(spark, sf), REFERENCE_DATE).filter(F.col("bucket") == bucket)
        return signals.select(*_COLUMNS.split(", "), "days", *extra)


for _bucket, _sql in _BUCKETS.items():
    _register(_bucket, _sql, {"blocked": ["blocked_by"], "stalled": ["progress_ratio"]}.get(_bucket, []))


@query("flagged_tasks", f"""
SELECT tenant_id, id, title, priority, due_date FROM ({TASKS_SQL})
WHERE (status <> 'done' AND age >= -7) OR status = 'blocked' OR (status <> 'done' AND age >= 7 AND ratio < 0.34)
""")
def flagged_tasks_q(spark, sf):
    return task_signals.flagged_tasks(task_signals.task_signals(order_tasks(spark, sf), REFERENCE_DATE))


_LINES = f"""
  SELECT tenant_id, 1 AS b, CAST(substr(priority, 2) AS INT) AS p, -age AS u, id, '  - [' || priority || '] ' || id || ' ' || title || ' — ' || age
    || 'd overdue (due ' || due_date || '), ' || subtasks_done || '/' || subtasks_total || ' subtasks done' AS line FROM ({TASKS_SQL})
    WHERE status <> 'done' AND age > 0
  UNION ALL SELECT tenant_id, 2, CAST(substr(priority, 2) AS INT), -age, id, '  - [' || priority || '] ' || id || ' ' || title || ' — due in '
    || (-age) || 'd (' || due_date || ')' FROM ({TASKS_SQL}) WHERE status <> 'done' AND age BETWEEN -7 AND 0
  UNION ALL SELECT tenant_id, 3, CAST(substr(priority, 2) AS INT), -age, id, '  - [' || priority || '] ' || id || ' ' || title || ' — blocked '
    || age || 'd: ' || blocked_by FROM ({TASKS_SQL}) WHERE status = 'blocked'
  UNION ALL SELECT tenant_id, 4, CAST(substr(priority, 2) AS INT), -age, id, '  - [' || priority || '] ' || id || ' ' || title || ' — open '
    || age || 'd, ' || subtasks_done || '/' || subtasks_total || ' subtasks (' || CAST(floor(CAST(printf('%.2f', CAST(ratio AS DOUBLE)) AS DOUBLE) * 100) AS BIGINT) || '%)'
    FROM ({TASKS_SQL}) WHERE status <> 'done' AND age >= 7 AND ratio < 0.34
"""


@query("task_signal_text", f"""
WITH lines AS ({_LINES}), heads AS (
  SELECT DISTINCT tenant_id, b, -1 AS p, 0 AS u, '' AS id,
         CASE b WHEN 1 THEN 'OVERDUE:' WHEN 2 THEN 'DUE SOON (within 7 days):' WHEN 3 THEN 'BLOCKED:'
                ELSE 'STALLED (open a while, little progress):' END AS line FROM lines)
SELECT tenant_id, string_agg(line, chr(10) ORDER BY b, p, u, id) AS text
FROM (SELECT * FROM lines UNION ALL SELECT * FROM heads) GROUP BY 1
""")
def task_signal_text_q(spark, sf):
    signals = task_signals.task_signals(order_tasks(spark, sf), REFERENCE_DATE)
    return rendering.lines_text(rendering.signal_lines(signals))


@query("date_urgency", """
SELECT CASE WHEN o_orderstatus = 'P' THEN 'no_date' WHEN d < 0 THEN 'overdue' WHEN d = 0 THEN 'due_today' WHEN d <= 7 THEN 'due_soon' ELSE 'later' END AS urgency,
       o_orderpriority, count(*) AS n
FROM (SELECT *, date_diff('day', DATE '1998-06-15', CAST(o_orderdate AS DATE)) AS d FROM orders) GROUP BY 1, 2
""")
def date_urgency_q(spark, sf):
    due = F.when(F.col("o_orderstatus") == "P", F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf, "orders").groupBy(date_urgency(due, REFERENCE_DATE).alias("urgency"), "o_orderpriority").agg(
        F.count("*").alias("n")
    )


@query("priority_disagreement", f"""
SELECT id, date_urgency, date_urgency IN ('overdue', 'due_today') AND priority IN ('P3', 'P4') AS priority_disagreement FROM (
  SELECT id, priority, CASE WHEN age > 0 THEN 'overdue' WHEN age = 0 THEN 'due_today' WHEN age >= -7 THEN 'due_soon' ELSE 'later' END AS date_urgency
  FROM ({TASKS_SQL}))
""")
def priority_disagreement_q(spark, sf):
    annotated = task_signals.annotate_items(order_tasks(spark, sf), REFERENCE_DATE)
    return annotated.select("id", "date_urgency", "priority_disagreement")
