"""Source parsing: rows of the given tables written in each source's format and read back."""

from pyspark.sql import functions as F

from worksignal.catalog.registry import query, strip, table
from worksignal.catalog.text_q import CLEAN_BODY_SQL
from worksignal.operators.note_signals import note_stats
from worksignal.sources import tasks as task_source
from worksignal.sources.calendar import parse_event_blocks
from worksignal.sources.citable import browse_events, citable_sources
from worksignal.sources.inbox import parse_messages
from worksignal.sources.notes import parse_notes


def _messages(spark, sf):
    turns = table(spark, sf, "conversations")
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    sent = F.timestamp_add("MINUTE", (F.col("conv_id") * 60 + F.col("turn")).cast("int"), F.lit("2024-01-01 22:30:00").cast("timestamp_ntz"))
    lead = F.when(F.col("turn") > 0, F.lit("Re: Re: ")).otherwise(F.lit(""))
    date = F.when(F.col("role") == "system", F.lit("some time ago")).otherwise(
        F.concat(F.date_format(sent, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" -0700"))
    )
    text = F.concat(
        F.lit("Subject: "), lead, F.lit("Thread  "), F.col("conv_id").cast("string"),
        F.lit("\nFrom: "), F.initcap("role"), F.lit(" <"), F.col("role"), F.lit("@Example.org>\nTo: owner@example.org\nDate: "), date,
        F.lit("\nMessage-ID: <"), key, F.lit("@example.org>\nMIME-Version: 1.0\nContent-Type: text/plain; charset=\"utf-8\""),
        F.lit("\nContent-Transfer-Encoding: base64\n\n"), F.base64(F.encode("text", "utf-8")), F.lit("\n"),
    )
    return turns.select(F.lit("main").alias("tenant_id"), F.concat(key, F.lit(".eml")).alias("filename"), F.encode(text, "utf-8").alias("content"))


@query("inbox_parse", f"""
WITH src AS (SELECT conv_id || '-' || turn || '.eml' AS id, text FROM conversations)
SELECT b.id AS filename, CASE WHEN turn > 0 THEN 'Re: Re: ' ELSE '' END || 'Thread  ' || conv_id AS subject, 'thread ' || conv_id AS thread_id,
       upper(role[1]) || role[2:] || ' <' || role || '@Example.org>' AS from_hdr,
       CASE WHEN role = 'system' THEN 'unknown' ELSE strftime(t, '%Y-%m-%d') END AS date_key,
       CASE WHEN role = 'system' THEN 'some time ago' ELSE strftime(t, '%Y-%m-%dT%H:%M:%S-07:00') END AS date_iso,
       CASE WHEN role <> 'system' THEN strftime(t + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') END AS sent_at, body
FROM ({CLEAN_BODY_SQL}) b JOIN (SELECT *, conv_id || '-' || turn || '.eml' AS id,
  TIMESTAMP '2024-01-01 22:30:00' + to_minutes(CAST(conv_id * 60 + turn AS INT)) AS t FROM conversations) c ON b.id = c.id
""")
def inbox_parse_q(spark, sf):
    mail = parse_messages(_messages(spark, sf))
    return mail.select("filename", "subject", "thread_id", "from_hdr", "date_key", "date_iso",
                       F.date_format("sent_at", "yyyy-MM-dd HH:mm:ss").alias("sent_at"), "body")


def _blocks(spark, sf):
    start = F.date_trunc("SECOND", F.col("ts")).cast("timestamp_ntz")
    stamp = "yyyyMMdd'T'HHmmss"
    user = F.col("user_id").cast("string")
    block = F.concat(
        F.lit("\nUID:"), F.col("event_id").cast("string"), F.lit("\nDTSTART;TZID=Somewhere:"),
        F.when(F.col("event_type") == "error", F.lit("20240199")).otherwise(F.date_format(start, stamp)),
        F.lit("\nDTEND:"), F.date_format(F.timestamp_add("HOUR", F.lit(1), start), stamp), F.lit("Z\nSUMMARY: Meet \n  "), user,
        F.when(F.col("event_type") == "click", F.lit("\nSTATUS:CANCELLED")).otherwise(F.lit("")),
        F.lit("\nDESCRIPTION:value "), F.replace(F.format_string("%.2f", "value"), F.lit("."), F.lit("\\,")), F.lit("\\nend"),
        F.lit("\nATTENDEE;CN=User "), user, F.lit(";PARTSTAT=ACCEPTED:mailto:u"), user, F.lit("@example.org"),
        F.lit("\nATTENDEE:MAILTO:team@example.org\nEND:VEVENT\n"),
    )
    return table(spark, sf, "events").select(user.alias("tenant_id"), block.alias("block"))


@query("calendar_parse", """
SELECT CAST(user_id AS VARCHAR) AS tenant_id, CAST(event_id AS VARCHAR) AS uid, 'Meet  ' || user_id AS summary,
       CASE WHEN event_type = 'click' THEN 'CANCELLED' ELSE 'CONFIRMED' END AS status,
       'value ' || replace(printf('%.2f', value), '.', ',') || chr(10) || 'end' AS description,
       CASE WHEN event_type = 'error' THEN NULL ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS start,
       strftime(date_trunc('second', ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS finish,
       CASE WHEN event_type = 'error' THEN 'unknown' ELSE strftime(ts, '%Y-%m-%d') END AS date_key,
       'User ' || user_id || ' u' || user_id || '@example.org ACCEPTED team@example.org team@example.org NEEDS-ACTION' AS people,
       CASE WHEN event_type = 'error' THEN 'bad DTSTART' END AS parse_error
FROM events
""")
def calendar_parse_q(spark, sf):
    people = F.array_join(F.flatten(F.transform("attendees", lambda a: F.array(a["name"], a["email"], a["partstat"]))), " ")
    shown = "yyyy-MM-dd HH:mm:ss"
    return parse_event_blocks(_blocks(spark, sf)).select(
        "tenant_id", "uid", "summary", "status", "description", F.date_format("start", shown).alias("start"),
        F.date_format("end", shown).alias("finish"), "date_key", people.alias("people"), "parse_error",
    )


def _notes(spark, sf):
    def box(condition, text):
        return F.concat(F.lit("\n- ["), F.when(condition, F.lit("x")).otherwise(F.lit(" ")), F.lit("]  "), text)

    key = F.col("o_orderkey").cast("string")
    dated = F.when(F.col("o_orderstatus") == "P", F.lit("undated")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    head = F.when(F.col("o_orderstatus") == "P", F.lit("No title here")).otherwise(F.concat(F.lit("#  Order "), key, F.lit(" ")))
    body = F.concat(
        head, F.lit("\n\nSome - [x] prose\n"), box(F.col("o_orderstatus") == "F", F.lit("settle it")),
        box(F.col("o_totalprice") > 200000, F.concat(F.lit("big: "), F.col("o_orderpriority"))), F.lit("\n  - [X] always done\n"),
    )
    return table(spark, sf, "orders").select(
        F.lit("main").alias("tenant_id"), F.concat(dated, F.lit("-order-"), key, F.lit(".md")).alias("note_id"), body.alias("body")
    )


_NOTES_SQL = """
  SELECT o_orderkey, o_orderpriority, o_orderstatus = 'P' AS undated, o_orderstatus = 'F' AS settled, o_totalprice > 200000 AS big,
         CASE WHEN o_orderstatus = 'P' THEN 'undated' ELSE strftime(o_orderdate, '%Y-%m-%d') END || '-order-' || o_orderkey || '.md' AS note_id,
         CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS created_at,
         date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-06-15') AS days FROM orders
"""


@query("notes_parse", f"""
SELECT note_id, CASE WHEN undated THEN note_id ELSE 'Order ' || o_orderkey END AS title, created_at,
       CASE WHEN settled THEN '[x]' ELSE '[ ]' END || 'settle it|' || CASE WHEN big THEN '[x]' ELSE '[ ]' END || 'big: ' || o_orderpriority || '|[x]always done' AS items
FROM ({_NOTES_SQL})
""")
def notes_parse_q(spark, sf):
    items = F.array_join(F.transform(
        "checklist_items", lambda i: F.concat(F.when(i["done"], F.lit("[x]")).otherwise(F.lit("[ ]")), i["text"])
    ), "|")
    return parse_notes(_notes(spark, sf)).select("note_id", "title", "created_at", items.alias("items"))


@query("note_stats", f"""
SELECT note_id, CAST(NOT settled AS BIGINT) + CAST(NOT big AS BIGINT) AS checklist_open, 1 + CAST(settled AS BIGINT) + CAST(big AS BIGINT) AS checklist_done,
       CASE WHEN undated THEN '' ELSE concat_ws('|', CASE WHEN NOT settled THEN 'settle it ' || days END,
            CASE WHEN NOT big THEN 'big: ' || o_orderpriority || ' ' || days END) END AS stale
FROM ({_NOTES_SQL})
""")
def note_stats_q(spark, sf):
    stats = note_stats(parse_notes(_notes(spark, sf)), "1998-06-15")
    stale = F.array_join(F.transform("stale_open_items", lambda i: F.concat_ws(" ", i["text"], i["days_open"].cast("string"))), "|")
    return stats.select("note_id", "checklist_open", "checklist_done", stale.alias("stale"))


@query("tasks_parse", """
SELECT l_orderkey || '-' || l_linenumber AS id, 'Ship "part" ' || l_partkey AS title, CASE WHEN l_linestatus = 'F' THEN 'done' END AS status,
       'P' || (l_linenumber % 5) AS priority, strftime(l_shipdate, '%Y-%m-%d') AS due_date, l_returnflag AS tag, l_linestatus = 'F' AS done
FROM lineitem
""")
def tasks_parse_q(spark, sf):
    task = F.to_json(F.struct(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
        F.concat(F.lit('Ship "part" '), F.col("l_partkey").cast("string")).alias("title"),
        F.when(F.col("l_linestatus") == "F", F.lit("done")).alias("status"),
        F.concat(F.lit("P"), (F.col("l_linenumber") % 5).cast("string")).alias("priority"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("due_date"),
        F.array("l_returnflag").alias("tags"),
        F.array(F.struct(F.lit("ship").alias("title"), (F.col("l_linestatus") == "F").alias("done"))).alias("subtasks"),
        F.lit(7).alias("unknown_field"),
    ))
    rows = table(spark, sf, "lineitem").select(F.lit("main").alias("tenant_id"), task.alias("task_json"))
    return task_source.parse_task_rows(rows).select(
        "id", "title", "status", "priority", "due_date", F.col("tags")[0].alias("tag"), F.col("subtasks")[0]["done"].alias("done")
    )


def _configs(spark, sf):
    key = F.col("s_suppkey")
    text = (
        F.when(key % 3 == 0, F.concat(F.lit('{"map_noise_filter": {"blocked_senders": ["A'), key.cast("string"), F.lit('@X.org"]}}')))
        .when(key % 3 == 1, F.concat(F.lit('{"use_persona_in_map": false, "max_qps_per_tenant": 99, "never_draft_contacts": [{"name": "'),
                                     F.col("s_name"), F.lit('"}]}')))
        .otherwise(F.lit("{}"))
    )
    return table(spark, sf, "supplier").select(F.concat(F.lit("t"), key.cast("string")).alias("tenant_id"), text.alias("config_json"))


@query("config_merge", """
SELECT 't' || s_suppkey AS tenant_id, s_suppkey % 3 <> 1 AS use_persona_in_map, CASE WHEN s_suppkey % 3 = 1 THEN s_name ELSE '' END AS contacts,
       CASE WHEN s_suppkey % 3 = 0 THEN 'A' || s_suppkey || '@X.org' ELSE '' END AS blocked_senders, 0 AS n_domains, CAST(2.0 AS DOUBLE) AS max_qps, 5 AS threshold
FROM supplier
""")
def config_merge_q(spark, sf):
    merged = task_source.merge_config(
        task_source.parse_config_rows(_configs(spark, sf)), task_source.read_system_config(spark)
    )
    return merged.select(
        "tenant_id", "use_persona_in_map", F.array_join(F.transform("never_draft_contacts", lambda c: c["name"]), ",").alias("contacts"),
        F.array_join("map_noise_filter.blocked_senders", ",").alias("blocked_senders"),
        F.size("map_noise_filter.blocked_domains").alias("n_domains"), F.col("max_qps_per_tenant").alias("max_qps"),
        F.col("circuit_breaker_threshold").alias("threshold"),
    )


@query("blocked_sender_rules", """
SELECT 't' || s_suppkey AS tenant_id, 'sender' AS kind, 'a' || s_suppkey || '@x.org' AS value FROM supplier WHERE s_suppkey % 3 = 0
""")
def blocked_sender_rules_q(spark, sf):
    return task_source.blocked_senders(task_source.merge_config(
        task_source.parse_config_rows(_configs(spark, sf)), task_source.read_system_config(spark)
    ))


@query("citable_union", f"""
WITH src AS (SELECT conv_id || '-' || turn || '.eml' AS id, text FROM conversations)
SELECT source, ref, label, text FROM (
  SELECT 'email' AS source, b.id AS ref, CASE WHEN turn > 0 THEN 'Re: Re: ' ELSE '' END || 'Thread  ' || conv_id AS label,
         CASE WHEN turn > 0 THEN 'Re: Re: ' ELSE '' END || 'Thread  ' || conv_id || ' ' || body AS text
    FROM ({CLEAN_BODY_SQL}) b JOIN conversations c ON b.id = c.conv_id || '-' || c.turn || '.eml'
  UNION ALL SELECT 'calendar', CAST(event_id AS VARCHAR), 'Meet  ' || user_id, 'Meet  ' || user_id || ' ' || 'value ' || replace(printf('%.2f', value), '.', ',') || chr(10) || 'end' || '  '
    || 'User ' || user_id || ' u' || user_id || '@example.org ACCEPTED team@example.org team@example.org NEEDS-ACTION' FROM events)
""")
def citable_union_q(spark, sf):
    sources = citable_sources(parse_messages(_messages(spark, sf)), parse_event_blocks(_blocks(spark, sf)))
    return sources.select("source", "ref", "label", "text")


@query("browse_events", """
SELECT CAST(event_id AS VARCHAR) AS uid, 'User ' || user_id || ', team@example.org' AS attendees FROM events
""")
def browse_events_q(spark, sf):
    events = browse_events(parse_event_blocks(_blocks(spark, sf)))
    return events.select("uid", F.array_join("attendees", ", ").alias("attendees"))
