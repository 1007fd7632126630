"""Assembling, citing and reading briefs."""

from pyspark.sql import functions as F

from worksignal.catalog.matching_q import MATCHES_SQL, benchmark_matches
from worksignal.catalog.registry import query, strip, table
from worksignal.catalog.shapes import DOCUMENT_KIND_SQL, document_sources
from worksignal.operators import briefs, grounding, task_signals


def _briefs(spark, sf):
    """A brief per conversation: last user and assistant turns, every turn a dispatch."""
    turns = table(spark, sf, "conversations").withColumn("tenant_id", F.col("conv_id").cast("string"))

    def last(role):
        return F.max_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))

    synthesis = turns.groupBy("tenant_id").agg(last("user").alias("what_matters_today"), last("assistant").alias("what_might_be_missed"))
    items = turns.select(
        "tenant_id", F.col("turn").cast("string").alias("id"), F.col("role").alias("summary"), F.col("turn").alias("ordinal")
    )
    drafts = turns.filter("role = 'assistant'").select(
        "tenant_id", F.col("turn").cast("string").alias("id"), F.length("text").cast("string").alias("draft_text"), F.col("turn").alias("ordinal")
    )
    fresh = turns.select("tenant_id", "conv_id").distinct().select(
        "tenant_id", F.explode(F.array(F.lit("email"), F.lit("calendar"))).alias("source"),
        F.when(F.col("conv_id") % 2 == 0, F.lit("2024-01-02")).alias("most_recent_day"),
        F.when(F.col("conv_id") % 2 == 0, F.lit(9)).alias("days_stale"), (F.col("conv_id") % 3 == 0).alias("is_stale"),
    )
    return briefs.assemble_briefs(synthesis, grounding.attach_drafts(items, drafts), fresh)


_BRIEF_SQL = f"""
  SELECT tenant_id, string_agg(line, chr(10) ORDER BY part, place) AS brief FROM (
    WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS tenant_id, conv_id, arg_max(text, turn) FILTER (WHERE role = 'user') AS a,
                      arg_max(text, turn) FILTER (WHERE role = 'assistant') AS b FROM conversations GROUP BY 1, 2)
    SELECT tenant_id, 0 AS part, 0 AS place, '# Daily Brief' || chr(10) AS line FROM t
    UNION ALL SELECT tenant_id, 1, 0, '> ⚠️ **Data freshness notice**' FROM t WHERE conv_id % 3 = 0
    UNION ALL SELECT tenant_id, 2, p, '> - ' || s || CASE WHEN conv_id % 2 = 0 THEN ': most recent data is from 2024-01-02 (9 days ago).'
      ELSE ': no data available at all.' END FROM t, (VALUES ('email', 1), ('calendar', 2)) v(s, p) WHERE conv_id % 3 = 0
    UNION ALL SELECT tenant_id, 3, 0, '' FROM t WHERE conv_id % 3 = 0
    UNION ALL SELECT tenant_id, 4, 0, '## What Matters Today' || chr(10) FROM t
    UNION ALL SELECT tenant_id, 5, 0, {strip("coalesce(a, '')")} FROM t
    UNION ALL SELECT tenant_id, 6, 0, '' FROM t
    UNION ALL SELECT tenant_id, 7, 0, '## What You Might Be Missing' || chr(10) FROM t
    UNION ALL SELECT tenant_id, 8, 0, {strip("coalesce(b, '')")} FROM t
    UNION ALL SELECT tenant_id, 9, 0, '' FROM t
    UNION ALL SELECT tenant_id, 10, 0, '## Quick Dispatches' || chr(10) FROM t
    UNION ALL SELECT CAST(conv_id AS VARCHAR), 11, turn, '**' || role || '**' || chr(10) || CASE WHEN role = 'assistant' THEN '> ' || length(text)
      ELSE '*(surfaced for you to handle directly — not drafted)*' END || chr(10) FROM conversations) GROUP BY tenant_id
"""


@query("brief_assembly", f"SELECT tenant_id, brief FROM ({_BRIEF_SQL})")
def brief_assembly_q(spark, sf):
    return _briefs(spark, sf).select("tenant_id", "brief")


@query("brief_bullets", f"""
SELECT tenant_id, CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY i) - 1 AS INT) AS bullet_no, bullet FROM (
  SELECT tenant_id, unnest(range(len(ls))) AS i, {strip('unnest(ls)')} AS bullet FROM (
    SELECT CAST(conv_id AS VARCHAR) AS tenant_id, string_split(arg_max(text, turn), chr(10)) AS ls FROM conversations WHERE role = 'user' GROUP BY 1))
WHERE bullet <> ''
""")
def brief_bullets_q(spark, sf):
    found = briefs.brief_bullets(_briefs(spark, sf), "What Matters Today")
    return found.select("tenant_id", "bullet_no", F.col("text").alias("bullet"))


@query("brief_drafts", """
SELECT CAST(conv_id AS VARCHAR) AS tenant_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS draft_no, role AS summary,
       role = 'assistant' AS drafted, CASE WHEN role = 'assistant' THEN CAST(length(text) AS VARCHAR) ELSE '' END AS draft_text FROM conversations
""")
def brief_drafts_q(spark, sf):
    return briefs.brief_drafts(_briefs(spark, sf)).drop("citations")


@query("freshness_notices", """
SELECT CAST(conv_id AS VARCHAR) AS tenant_id, CASE WHEN conv_id % 3 <> 0 THEN '' ELSE '> ⚠️ **Data freshness notice**' || chr(10) || string_agg('> - ' || s
  || CASE WHEN conv_id % 2 = 0 THEN ': most recent data is from 2024-01-02 (9 days ago).' ELSE ': no data available at all.' END, chr(10) ORDER BY p) END AS notice
FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES ('email', 1), ('calendar', 2)) v(s, p) GROUP BY conv_id
""")
def freshness_notices_q(spark, sf):
    return _briefs(spark, sf).select("tenant_id", briefs.freshness_notice(F.col("brief")).alias("notice"))


# Documents cited by benchmark texts, best first, kinds in their fixed order.
_PLACE = "list_position(['email', 'calendar', 'notes', 'task'], kind)"


def _refs(between: str, glue: str) -> str:
    """(item_id, refs)."""
    return f"""
  SELECT item_id, string_agg(kind || '{between}' || ref, '{glue}' ORDER BY rn) AS refs FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n_matched DESC, {_PLACE}, ref) AS rn FROM (
      SELECT m.item_id, m.n_matched, printf('%09d', m.doc_id) AS ref, {DOCUMENT_KIND_SQL} AS kind
      FROM ({MATCHES_SQL}) m JOIN documents USING (doc_id))) GROUP BY 1
"""


@query("match_ranks", f"""
SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY n_matched DESC, {_PLACE}, doc_id) AS match_rank FROM (
  SELECT m.*, {DOCUMENT_KIND_SQL} AS kind FROM ({MATCHES_SQL}) m JOIN documents USING (doc_id))
""")
def match_ranks_q(spark, sf):
    ranked = briefs.ranked_refs(benchmark_matches(spark, sf))
    return ranked.select(F.col("claim_id").cast("bigint").alias("item_id"), F.col("ref").cast("bigint").alias("doc_id"), "match_rank")


@query("structured_citations", f"""
SELECT b.item_id, coalesce(r.refs, '') AS source_refs, CASE WHEN b.item_id % 3 = 0 THEN 'no_date' WHEN b.item_id % 3 = 1 THEN 'overdue' ELSE 'later' END AS date_urgency,
       b.item_id % 3 = 1 AS priority_disagreement
FROM benchmark b LEFT JOIN ({_refs(':', ',')}) r ON r.item_id = b.item_id
""")
def structured_citations_q(spark, sf):
    due = F.when(F.col("item_id") % 3 == 1, F.lit("2023-12-31")).when(F.col("item_id") % 3 == 2, F.lit("2024-02-01"))
    items = table(spark, sf, "benchmark").select(
        F.lit("main").alias("tenant_id"), F.col("item_id").cast("string").alias("claim_id"), F.lit("P4").alias("priority"), due.alias("due_date")
    )
    cited = briefs.item_citations(task_signals.annotate_items(items, "2024-01-01"), benchmark_matches(spark, sf))
    return cited.select(
        F.col("claim_id").cast("bigint").alias("item_id"), F.array_join("source_refs", ",").alias("source_refs"),
        "date_urgency", "priority_disagreement",
    )


_WHOLE = "regexp_replace(text, '\\s+', ' ', 'g')"


@query("cited_briefs", f"""
SELECT b.item_id, '# Daily Brief' || chr(10) || chr(10) || '- ' || {_WHOLE} || coalesce(' _[source: ' || r.refs || ']_', '')
  || chr(10) || '> quoted' AS brief
FROM benchmark b LEFT JOIN ({_refs(': ', ', ')}) r ON r.item_id = b.item_id
""")
def cited_briefs_q(spark, sf):
    return _cited(spark, sf).select("item_id", "brief")


def _cited(spark, sf):
    from worksignal.operators import matching

    texts = table(spark, sf, "benchmark").select(
        F.lit("main").alias("tenant_id"), "item_id",
        F.concat(F.lit("# Daily Brief\n\n- "), F.regexp_replace("text", "\\s+", " "), F.lit("\n> quoted")).alias("brief"),
    )
    lines = briefs.numbered_lines(texts, ["tenant_id", "item_id"])
    matches = matching.keyword_matches(briefs.claims_of(lines), document_sources(spark, sf))
    return briefs.cited_briefs(briefs.annotate_lines(lines, briefs.citation_tags(matches)), ["tenant_id", "item_id"])


@query("citation_labels", f"""
SELECT item_id, kind AS source, printf('%09d', doc_id) AS ref, CAST(doc_id AS VARCHAR) AS label, 'keyword' AS matched_via FROM (
  SELECT m.*, {DOCUMENT_KIND_SQL} AS kind FROM ({MATCHES_SQL}) m JOIN documents USING (doc_id))
""")
def citation_labels_q(spark, sf):
    claim_lines = _cited(spark, sf).select("tenant_id", "item_id", F.explode(F.split("brief", "\n")).alias("line"))
    bullets = claim_lines.select(
        "tenant_id", F.col("item_id").alias("bullet_no"), briefs.line_text(F.col("line")).alias("text"),
        briefs.line_citations(F.col("line")).alias("citations"),
    )
    found = briefs.labelled_citations(bullets, document_sources(spark, sf))
    return found.select(F.col("bullet_no").alias("item_id"), "source", "ref", "label", "matched_via")
