"""The model contract, answered by a small rule in place of a model."""

import json
import re

from pyspark.sql import functions as F

from worksignal.catalog.calendar_q import CALENDAR_SQL, CONFLICTS_SQL
from worksignal.catalog.registry import MAIL_SQL, query
from worksignal.catalog.shapes import calendar, mail
from worksignal.operators import rendering
from worksignal.plans import map_plan
from worksignal.sources.records import processed_keys


def answer_mail(system_text: str, user_text: str) -> str:
    """Replies are decisions, other mail is action items; days ending in 7 get a broken answer."""
    if re.match(r"Emails for \S*7:", user_text):
        return '{"deadlines": []}'
    found = {"deadlines": [], "decisions": [], "action_items": [], "thread_progressions": []}
    for subject in re.findall(r"^Subject: (.*)$", user_text, re.M):
        category = "decisions" if subject.startswith("Re: ") else "action_items"
        found[category].append({"description": subject, "source_subject": subject, "priority": "P2"})
    return "Here you are:\n```json\n" + json.dumps(found) + "\n```"


def answer_calendar(system_text: str, user_text: str) -> str:
    found = {"meetings_needing_prep": [], "family_calendar_items": [], "pattern_flags": [], "notable_events": []}
    for summary in re.findall(r"^Summary: (Customer.*)$", user_text, re.M):
        found["meetings_needing_prep"].append({"summary": summary, "why": "customer"})
    return json.dumps(found)


def _no_ledger(spark):
    from worksignal import schemas

    return processed_keys(spark.createDataFrame([], schemas.LEDGER_ENTRIES))


_GOOD_DAYS = f"(SELECT * FROM ({MAIL_SQL}) WHERE date_key NOT LIKE '%7')"


@query("map_mail_entries", f"""
SELECT date_key AS entry_key, count(*) AS item_count, count(DISTINCT email) AS unique_senders,
       count(*) FILTER (WHERE event_type = 'click') AS reply_count FROM {_GOOD_DAYS} GROUP BY 1
""")
def map_mail_entries_q(spark, sf):
    entries, _, _ = map_plan.map_mail(mail(spark, sf), _no_ledger(spark), answer_mail)
    return entries.select(
        "entry_key", "item_count", F.col("stats.unique_senders").cast("bigint").alias("unique_senders"),
        F.col("stats.reply_count").cast("bigint").alias("reply_count"),
    )


@query("map_mail_items", f"""
SELECT date_key AS entry_key, CASE WHEN event_type = 'click' THEN 'decisions' ELSE 'action_items' END AS category,
       subject || ' ' || subject || ' P2' AS text, count(*) AS n FROM {_GOOD_DAYS} GROUP BY 1, 2, 3
""")
def map_mail_items_q(spark, sf):
    _, items, _ = map_plan.map_mail(mail(spark, sf), _no_ledger(spark), answer_mail)
    return items.groupBy("entry_key", "category", "text").agg(F.count("*").alias("n"))


@query("map_mail_rejected", f"""
SELECT DISTINCT date_key AS unit_key, 'Missing top-level key: ''decisions''' AS first_error, 3 AS n_errors FROM ({MAIL_SQL}) WHERE date_key LIKE '%7'
""")
def map_mail_rejected_q(spark, sf):
    _, _, rejected = map_plan.map_mail(mail(spark, sf), _no_ledger(spark), answer_mail)
    return rejected.select("unit_key", F.col("errors")[0].alias("first_error"), F.size("errors").alias("n_errors")).distinct()


@query("map_calendar_items", f"""
SELECT tenant_id, date_key AS entry_key, 'meetings_needing_prep' AS category, summary || ' customer' AS text FROM ({CALENDAR_SQL}) WHERE category = 'external'
UNION ALL SELECT tenant_id, date_key, 'declined_or_cancelled', summary || ' ' || date_key || ' TENTATIVE' FROM ({CALENDAR_SQL}) WHERE kind = 'declined'
UNION ALL SELECT tenant_id, date_key, 'deep_work_conflicts', summary || ' ' || strftime(s, '%Y-%m-%dT%H:%M:%S') FROM ({CONFLICTS_SQL})
""")
def map_calendar_items_q(spark, sf):
    _, items, _ = map_plan.map_calendar(calendar(spark, sf), _no_ledger(spark), answer_calendar)
    return items.select("tenant_id", "entry_key", "category", "text")


@query("ledger_text", f"""
WITH e AS (SELECT date_key, count(*) AS n, count(DISTINCT email) AS senders, count(*) FILTER (WHERE event_type = 'click') AS replies,
                  CAST(round_even(sum(length(body)) / count(*), 0) AS BIGINT) AS chars,
                  date_diff('day', CAST(date_key AS DATE), DATE '2024-01-30') AS age FROM {_GOOD_DAYS} GROUP BY 1),
lines AS (
  SELECT date_key, 0 AS part, 0 AS c, '' AS place, '### ' || date_key || ' (' || CASE age WHEN 0 THEN 'TODAY' WHEN 1 THEN 'YESTERDAY' ELSE age || ' DAYS AGO — NOT today' END
    || ') (' || n || ' emails)' AS line FROM e
  UNION ALL SELECT date_key, 1, 0, '', '- Senders: ' || senders || ' unique | Replies: ' || replies || ' | New threads: ' || (n - replies)
    || ' | Avg body length: ' || chars || ' chars' FROM e
  UNION ALL SELECT date_key, 4, CASE WHEN event_type = 'click' THEN 1 ELSE 2 END, date_iso || printf('%012d', event_id),
    CASE WHEN event_type = 'click' THEN '- DECISION [P2]: ' || subject || ' (from: ' || subject || ')'
         ELSE '- ACTION [P2]: ' || subject || ' (owner: unspecified, from: ' || subject || ')' END FROM {_GOOD_DAYS}
  UNION ALL SELECT date_key, 9, 0, '', '' FROM e)
SELECT source, string_agg(line, chr(10) ORDER BY rn) AS text FROM (
  SELECT *, 'email' AS source, row_number() OVER (ORDER BY date_key, part, c, place) AS rn FROM lines) GROUP BY 1
""")
def ledger_text_q(spark, sf):
    entries, items, _ = map_plan.map_mail(mail(spark, sf), _no_ledger(spark), answer_mail)
    lines = rendering.ledger_lines(entries, items, reference_date="2024-01-30")
    return rendering.ledger_text(lines).drop("tenant_id")
