"""The stages of a brief that ask a model, each answered by a small rule over the given texts."""

import json

from pyspark.sql import functions as F

from worksignal import schemas
from worksignal.catalog.ledger_q import _entries, _items
from worksignal.catalog.matching_q import _items as _lines
from worksignal.catalog.matching_q import _tasks
from worksignal.catalog.registry import query, table
from worksignal.catalog.shapes import order_tasks
from worksignal.functions.constants import CONTRADICTION_SCHEMA, DRAFT_SCHEMA, JUDGE_SCHEMA, SOURCES, SYNTHESIS_SCHEMA
from worksignal.operators import crossref, grounding, ledger_health, task_signals
from worksignal.plans import brief_plan, model_stage


def _turns(spark, sf):
    """Every turn as a unit of its own tenant, so that no rule has to tell turns apart."""
    return table(spark, sf, "conversations").select(
        F.format_string("%d-%d", "conv_id", "turn").alias("tenant_id"), F.lit("brief").alias("unit_key"), F.col("text").alias("user_text")
    )


def _asked(spark, sf, stage, answer, schema):
    return model_stage.ask_and_check(model_stage.requests(_turns(spark, sf), stage, ""), answer, schema)


def answer_synthesis(system_text: str, user_text: str) -> str:
    """As many items as the text's length modulo 4; texts whose length ends in 7 get an answer without any list."""
    n = len(user_text)
    items = [{"id": str(k), "type": "email_reply", "summary": f"item {k} of {n}", "context": user_text[:20]} for k in range(n % 4)]
    return json.dumps({"what_matters_today": f"{n} letters", "what_might_be_missed": user_text[:10], **({} if n % 10 == 7 else {"dispatchable_items": items})})


@query("synthesis_stage", """
SELECT conv_id || '-' || turn AS tenant_id, length(text) || ' letters' AS what_matters_today, text[:10] AS what_might_be_missed,
       length(text) % 4 AS n_items FROM conversations WHERE length(text) % 10 <> 7
""")
def synthesis_stage_q(spark, sf):
    """The narrative and the number of dispatchable items of each accepted answer."""
    told, _ = _asked(spark, sf, "synthesis", answer_synthesis, SYNTHESIS_SCHEMA)
    narrative, dispatches = brief_plan.synthesis_rows(told)
    counts = dispatches.groupBy("tenant_id").agg(F.count("*").alias("n"))
    return narrative.join(counts, "tenant_id", "left").select("tenant_id", "what_matters_today", "what_might_be_missed", F.coalesce("n", F.lit(0)).alias("n_items"))


def answer_drafts(system_text: str, user_text: str) -> str:
    """A draft for every second item that is asked about."""
    asked = [json.loads(line) for line in user_text.split("\n") if line.startswith("{")]
    return json.dumps({"drafts": [{"id": x["id"], "draft_text": "Re: " + x["summary"]} for x in asked if int(x["id"]) % 2 == 0]})


@query("draft_stage", """
SELECT conv_id || '-' || turn AS tenant_id, CAST(k AS VARCHAR) AS id, CASE WHEN k % 2 = 0 THEN 'Re: item ' || k || ' of ' || length(text) END AS draft
FROM (SELECT *, unnest(range(length(text) % 4)) AS k FROM conversations WHERE length(text) % 10 <> 7)
""")
def draft_stage_q(spark, sf):
    """The items of the synthesis with the drafts that a second stage writes for them."""
    told, _ = _asked(spark, sf, "synthesis", answer_synthesis, SYNTHESIS_SCHEMA)
    items = brief_plan.dispatch_rows(told)
    units = brief_plan.draft_units(items)
    drafted, _ = model_stage.ask_and_check(model_stage.requests(units, "drafts", ""), answer_drafts, DRAFT_SCHEMA)
    drafts = brief_plan.draft_rows(drafted).select("tenant_id", "id", F.col("draft_text").alias("draft"))
    return items.select("tenant_id", "id").join(drafts, ["tenant_id", "id"], "left")


def answer_contradictions(system_text: str, user_text: str) -> str:
    """Two claims about each text, one of them about nothing known."""
    return json.dumps({"contradictions": [
        {"entity": "length " + str(len(user_text)), "sources": ["email"], "description": user_text[:10]},
        {"entity": "nothing", "sources": ["email", "notes"], "description": "made up"},
    ]})


@query("contradiction_stage", """
SELECT conv_id || '-' || turn AS tenant_id, 'T-' || length(text) AS task_id, text[:10] AS description, 1 AS n_rejected FROM conversations
""")
def contradiction_stage_q(spark, sf):
    """Claims of each answer, kept where they name a task and a source it was found in."""
    told, _ = _asked(spark, sf, "contradictions", answer_contradictions, CONTRADICTION_SCHEMA)
    claims = brief_plan.contradiction_claims(model_stage.payload_items(told))
    n = F.length("user_text").cast("string")
    multi = _turns(spark, sf).select(
        "tenant_id", F.concat(F.lit("T-"), n).alias("task_id"), F.concat(F.lit("Length "), n).alias("title"), F.array(F.lit("calendar"), F.lit("email")).alias("sources")
    )
    kept, rejected = grounding.ground_contradictions(claims, multi)
    lost = rejected.groupBy("tenant_id").agg(F.count("*").cast("int").alias("n_rejected"))
    return kept.join(lost, "tenant_id").select("tenant_id", "task_id", "description", "n_rejected")


def _claims_and_sources(spark, sf):
    """Users' turns as claims of their conversation, the other turns as its sources."""
    talk = table(spark, sf, "conversations").withColumn("tenant_id", F.col("conv_id").cast("string"))
    turn = F.format_string("%03d", "turn")
    claims = talk.filter("role = 'user'").select("tenant_id", turn.alias("claim_id"), "text")
    sources = talk.filter("role <> 'user'").select("tenant_id", F.lit("email").alias("source"), turn.alias("ref"), F.col("role").alias("label"), "text")
    return claims, sources


@query("judge_requests", """
WITH claims AS (SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || '. ' || text AS line FROM conversations WHERE role = 'user'),
said AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS text FROM claims GROUP BY 1),
shown AS (SELECT conv_id, string_agg('[email:' || printf('%03d', turn) || '] ' || role || ' — ' || text[:300], chr(10) ORDER BY turn) AS text
          FROM conversations WHERE role <> 'user' GROUP BY 1)
SELECT CAST(conv_id AS VARCHAR) AS tenant_id, 'Claims:' || chr(10) || said.text || chr(10) || chr(10) || 'Candidate sources:'
  || coalesce(chr(10) || shown.text, '') AS user_text FROM said LEFT JOIN shown USING (conv_id)
""")
def judge_requests_q(spark, sf):
    return brief_plan.judge_units(*_claims_and_sources(spark, sf)).select("tenant_id", "user_text")


def answer_judge(system_text: str, user_text: str) -> str:
    """Each claim with its own number as evidence of the first source, and one claim that does not exist."""
    first = user_text.split("Candidate sources:\n[email:")
    ref = first[1].split("]")[0] if len(first) > 1 else "none"
    claims = first[0].count("\n")
    return json.dumps({"matches": [{"claim_index": k, "evidence": [{"source_ref": ref, "quote": str(k)}]} for k in range(claims + 1000) if k < 3 or k > claims + 997]})


@query("judge_stage", """
WITH claims AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations WHERE role = 'user'),
firsts AS (SELECT conv_id, printf('%03d', min(turn)) AS ref FROM conversations WHERE role <> 'user' GROUP BY 1)
SELECT CAST(conv_id AS VARCHAR) AS tenant_id, printf('%03d', turn) AS claim_id, coalesce(ref, 'none') AS source_ref, CAST(k AS VARCHAR) AS quote
FROM claims LEFT JOIN firsts USING (conv_id) WHERE k < 3
""")
def judge_stage_q(spark, sf):
    """Evidence of the judge's answers, by the claims' numbers."""
    claims, sources = _claims_and_sources(spark, sf)
    reqs = model_stage.requests(brief_plan.judge_units(claims, sources), "judge", "")
    accepted, _ = model_stage.ask_and_check(reqs, answer_judge, JUDGE_SCHEMA)
    return brief_plan.judge_evidence(accepted, claims)


@query("synthesis_contexts", """
SELECT CAST(user_id AS VARCHAR) AS tenant_id, CAST(count(DISTINCT CAST(ts AS DATE)) AS INT) AS n_days, CAST(count(*) AS INT) AS n_items, 3 AS n_ledgers,
       CAST(2 + CAST(max(CAST(ts AS DATE)) < DATE '2024-01-29' AS INT) AS INT) AS n_stale, true AS complete FROM events GROUP BY 1
""")
def synthesis_contexts_q(spark, sf):
    """What each user's brief would be written from: ledgers of events, no flagged tasks, how fresh each source is."""
    entries, items = _entries(spark, sf), _items(spark, sf)
    signals = task_signals.task_signals(order_tasks(spark, sf).limit(0), "2024-01-30")
    mentions = crossref.task_mentions(_tasks(spark, sf).limit(0), _lines(spark, sf).limit(0))
    none = spark.createDataFrame([], "tenant_id string, claim_id string, entity string, sources array<string>, description string")
    fresh = ledger_health.freshness(entries, ledger_health.expected_sources(entries, SOURCES), "2024-01-30")
    cover = spark.createDataFrame([], schemas.LEDGER_COVER)
    text = brief_plan.synthesis_context(entries, items, cover, signals, mentions, none, fresh, "2024-01-30")

    def count(pattern):
        return F.regexp_count("text", F.lit(pattern))

    sentences = ("(No overdue, due-soon, blocked, or stalled tasks.)", "(none — no flagged tasks found mentioned in multiple sources)", "(none detected)")
    complete = F.lit(True)
    for sentence in sentences:
        complete = complete & F.contains("text", F.lit(sentence))
    return text.select(
        "tenant_id", count("(?m)^### ").alias("n_days"), count("(?m)^- DECISION ").alias("n_items"), count("(?m)^[A-Z]+ LEDGER:$").alias("n_ledgers"),
        count('"is_stale":true').alias("n_stale"), complete.alias("complete"),
    )
