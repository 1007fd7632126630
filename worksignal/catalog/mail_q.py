"""Mail facts over events."""

from pyspark.sql import functions as F

from worksignal.catalog.registry import MAIL_SQL, query, table
from worksignal.catalog.shapes import mail
from worksignal.operators import mail_signals, rendering
from worksignal.operators.rendering import NO_QUIET_SENDERS


@query("mail_day_stats", f"""
SELECT date_key, count(*) AS email_count, count(DISTINCT email) AS unique_senders,
       count(*) FILTER (WHERE event_type = 'click') AS reply_count,
       count(*) FILTER (WHERE event_type <> 'click') AS new_thread_count,
       CAST(round_even(sum(length(body)) / count(*), 0) AS BIGINT) AS avg_body_chars
FROM ({MAIL_SQL}) GROUP BY date_key
""")
def mail_day_stats_q(spark, sf):
    return mail_signals.day_mail_stats(mail(spark, sf)).drop("tenant_id")


QUIET_SQL = f"""
  SELECT email, arg_min(name, event_id) AS name, count(*) AS email_count, min(date_key) AS first_seen, max(date_key) AS last_seen,
         CAST(date_diff('day', CAST(max(date_key) AS DATE), (SELECT CAST(max(date_key) AS DATE) FROM ({MAIL_SQL}))) AS INT) AS days_since_last_contact
  FROM ({MAIL_SQL}) GROUP BY email
  HAVING date_diff('day', CAST(max(date_key) AS DATE), (SELECT CAST(max(date_key) AS DATE) FROM ({MAIL_SQL}))) >= 3
"""


@query("quiet_senders", f"SELECT * FROM ({QUIET_SQL})")
def quiet_senders_q(spark, sf):
    return mail_signals.quiet_senders(mail(spark, sf)).drop("tenant_id")


@query("quiet_sender_report", f"""
SELECT string_agg('- ' || name || ' <' || email || '>: last heard from ' || last_seen || ' (' || days_since_last_contact
         || ' days ago), ' || email_count || ' emails total in this window (first: ' || first_seen || ')', chr(10) ORDER BY rn) AS text
FROM (SELECT *, row_number() OVER (ORDER BY days_since_last_contact DESC, email) AS rn FROM ({QUIET_SQL})) HAVING count(*) > 0
""")
def quiet_sender_report_q(spark, sf):
    emails = mail(spark, sf)
    lines = rendering.staleness_lines(mail_signals.quiet_senders(emails))
    lines = rendering.or_sentence(lines, emails.select("tenant_id"), NO_QUIET_SENDERS)
    return rendering.lines_text(lines).drop("tenant_id")


@query("noise_filter", f"""
SELECT m.date_key, count(*) AS kept FROM ({MAIL_SQL}) m
WHERE event_type <> 'error'
  AND email NOT IN (SELECT 'view.' || user_id || '@view.example' FROM events WHERE event_type = 'signup')
GROUP BY m.date_key
""")
def noise_filter_q(spark, sf):
    signups = table(spark, sf, "events").filter("event_type = 'signup'").select("user_id").distinct()
    senders = signups.select(
        F.lit("main").alias("tenant_id"), F.lit("sender").alias("kind"),
        F.concat(F.lit("view."), F.col("user_id").cast("string"), F.lit("@view.example")).alias("value"),
    )
    domain = spark.range(1).select(F.lit("main").alias("tenant_id"), F.lit("domain").alias("kind"), F.lit("error.example").alias("value"))
    kept = mail_signals.drop_blocked(mail(spark, sf), senders.unionByName(domain))
    return kept.groupBy("date_key").agg(F.count("*").alias("kept"))


@query("mail_context", f"""
SELECT date_key, string_agg(
  '--- Email ' || rn || ' ---' || chr(10) || 'From: ' || name || ' <' || email || '>' || chr(10) || 'To: Owner <owner@example.org>' || chr(10)
  || 'Subject: ' || subject || chr(10) || 'Date: ' || date_iso || chr(10) || 'Thread: ' || event_type || ' by ' || user_id || chr(10)
  || 'Body:' || chr(10) || body || chr(10), chr(10) ORDER BY rn) AS text
FROM (SELECT *, row_number() OVER (PARTITION BY date_key ORDER BY date_iso, event_id) AS rn FROM ({MAIL_SQL})) GROUP BY 1
""")
def mail_context_q(spark, sf):
    return rendering.email_context(mail(spark, sf)).drop("tenant_id")
