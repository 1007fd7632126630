"""Calendar facts over events laid out as calendar entries."""

from pyspark.sql import functions as F

from worksignal.catalog.registry import query
from worksignal.catalog.shapes import calendar
from worksignal.operators import calendar_signals, rendering

CALENDAR_SQL = """
SELECT CAST(user_id AS VARCHAR) AS tenant_id, printf('%012d', event_id) AS uid, event_id, props, user_id,
       CASE event_type WHEN 'purchase' THEN 'Focus time' WHEN 'click' THEN 'Board 1:1' WHEN 'view' THEN 'Customer planning'
                       WHEN 'signup' THEN 'Retro' ELSE 'Errand' END || ' ' || event_id AS summary,
       CASE WHEN event_type = 'error' AND value > 20 THEN 'declined' WHEN event_type = 'purchase' THEN 'focus' ELSE 'meeting' END AS kind,
       CASE event_type WHEN 'click' THEN 'one_on_one' WHEN 'view' THEN 'external' WHEN 'signup' THEN 'internal_ceremony' ELSE 'other' END AS category,
       strftime(ts, '%Y-%m-%d') AS date_key, date_trunc('second', ts) AS s,
       date_trunc('second', ts) + to_minutes(CAST(floor(value) AS INT)) AS e, CAST(floor(value) AS BIGINT) * 60000000 AS micros
FROM events
"""
CONFLICTS_SQL = f"""
SELECT f.tenant_id, f.date_key, f.uid AS focus_uid, m.uid AS meeting_uid, m.summary, m.s,
       epoch_us(least(f.e, m.e)) - epoch_us(greatest(f.s, m.s)) AS micros
FROM ({CALENDAR_SQL}) f JOIN ({CALENDAR_SQL}) m ON f.tenant_id = m.tenant_id AND f.date_key = m.date_key
 AND f.s < m.e AND m.s < f.e WHERE f.kind = 'focus' AND m.kind = 'meeting' AND f.s < f.e AND m.s < m.e
"""
_BACK = f"""
SELECT tenant_id, date_key, count(*) FILTER (WHERE nxt <= e) AS back_to_back_count FROM (
  SELECT *, lead(s) OVER (PARTITION BY tenant_id, date_key ORDER BY s, uid) AS nxt FROM ({CALENDAR_SQL}) WHERE kind = 'meeting')
GROUP BY 1, 2
"""


@query("focus_conflicts", f"""
SELECT tenant_id, date_key, focus_uid, meeting_uid, summary, strftime(s, '%Y-%m-%dT%H:%M:%S') AS start,
       round(micros / 3.6e9, 6) AS overlap_hours FROM ({CONFLICTS_SQL})
""")
def focus_conflicts_q(spark, sf):
    found = calendar_signals.focus_conflicts(calendar(spark, sf))
    return found.drop("overlap_micros").withColumn("start", F.date_format("start", "yyyy-MM-dd'T'HH:mm:ss")).withColumn(
        "overlap_hours", F.round("overlap_hours", 6)
    )


@query("back_to_back", _BACK)
def back_to_back_q(spark, sf):
    return calendar_signals.back_to_back(calendar(spark, sf))


@query("calendar_day_stats", f"""
SELECT b.tenant_id, b.date_key, event_count, meeting_count, CAST(printf('%.2f', CAST(meeting_hours AS DOUBLE) / 3.6e9) AS DOUBLE) AS meeting_hours,
       CAST(printf('%.2f', CAST(focus_hours AS DOUBLE) / 3.6e9) AS DOUBLE) AS focus_hours_scheduled,
       CAST(printf('%.2f', CAST(greatest(0, focus_hours - coalesce(lost, 0)) AS DOUBLE) / 3.6e9) AS DOUBLE) AS focus_hours_protected, CAST(printf('%.2f', CAST(coalesce(lost, 0) AS DOUBLE) / 3.6e9) AS DOUBLE) AS focus_hours_eroded,
       coalesce(back_to_back_count, 0) AS back_to_back_count, declined AS declined_or_cancelled_count
FROM (SELECT tenant_id, date_key, count(*) AS event_count, count(*) FILTER (WHERE kind = 'meeting') AS meeting_count,
             coalesce(sum(micros) FILTER (WHERE kind = 'meeting'), 0) AS meeting_hours,
             coalesce(sum(micros) FILTER (WHERE kind = 'focus'), 0) AS focus_hours,
             count(*) FILTER (WHERE kind = 'declined') AS declined FROM ({CALENDAR_SQL}) GROUP BY 1, 2) b
LEFT JOIN (SELECT tenant_id, date_key, sum(micros) AS lost FROM ({CONFLICTS_SQL}) GROUP BY 1, 2) c USING (tenant_id, date_key)
LEFT JOIN ({_BACK}) k USING (tenant_id, date_key)
""")
def calendar_day_stats_q(spark, sf):
    return calendar_signals.day_calendar_stats(calendar(spark, sf)).drop("meeting_hours_by_category")


@query("hours_by_category", f"""
SELECT tenant_id, date_key, category, CAST(printf('%.2f', CAST(sum(micros) AS DOUBLE) / 3.6e9) AS DOUBLE) AS hours FROM ({CALENDAR_SQL}) WHERE kind = 'meeting' GROUP BY 1, 2, 3
""")
def hours_by_category_q(spark, sf):
    stats = calendar_signals.day_calendar_stats(calendar(spark, sf))
    return stats.select("tenant_id", "date_key", F.explode("meeting_hours_by_category").alias("category", "hours"))


@query("declined_events", f"""
SELECT tenant_id, date_key, uid, summary, date_key AS date, 'TENTATIVE' AS status FROM ({CALENDAR_SQL}) WHERE kind = 'declined'
""")
def declined_events_q(spark, sf):
    return calendar_signals.declined_events(calendar(spark, sf))


@query("event_context", f"""
SELECT tenant_id, date_key, string_agg(
  '--- Event ' || rn || ' ---' || chr(10) || 'Summary: ' || summary || chr(10)
  || 'Status: ' || CASE kind WHEN 'declined' THEN 'TENTATIVE' ELSE 'CONFIRMED' END || chr(10)
  || 'Start: ' || strftime(s, '%Y-%m-%dT%H:%M:%S') || chr(10) || 'End: ' || strftime(e, '%Y-%m-%dT%H:%M:%S') || chr(10)
  || 'Location: none' || chr(10) || 'Attendees: User ' || user_id || chr(10) || 'Description: ' || props || chr(10), chr(10) ORDER BY rn) AS text
FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, date_key ORDER BY s, uid) AS rn FROM ({CALENDAR_SQL})) GROUP BY 1, 2
""")
def event_context_q(spark, sf):
    return rendering.event_context(calendar(spark, sf))
