"""Text functions over whole documents and conversations."""

from pyspark.sql import functions as F

from worksignal.catalog.registry import SPACE, TITLE_STOP, keywords, query, strip, table
from worksignal.functions import checks, constants, headers, payload
from worksignal.functions.keywords import title_keywords
from worksignal.functions.text import citable, content_hash, each, identifiers, lines_of
from worksignal.operators.dataset_checks import weekday_mentions
from worksignal.sources.records import prompt_snapshots


@query("title_keywords", f"""
SELECT w AS keyword, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM ({keywords('documents', 'doc_id')}) GROUP BY w
""")
def title_keywords_q(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", each(title_keywords(F.col("text"))).alias("keyword")).filter(
        "keyword IS NOT NULL"
    )
    per_doc = docs.groupBy("keyword", "doc_id").agg(F.count("*").alias("c"))
    return per_doc.groupBy("keyword").agg(F.sum("c").alias("n"), F.count("*").alias("n_docs"))


@query("citable_lines", f"""
SELECT doc_id, CAST(line_no AS INT) AS line_no, {strip('line')} AS claim FROM (
  SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
WHERE {strip('line')} <> '' AND NOT starts_with({strip('line')}, '#') AND NOT starts_with({strip('line')}, '>')
  AND {strip('line')} <> '{constants.UNDRAFTED_LINE}'
""")
def citable_lines_q(spark, sf):
    from worksignal.functions.text import strip as strip_text

    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.filter(citable(F.col("line"), constants.UNDRAFTED_LINE)).select(
        "doc_id", "line_no", strip_text(F.col("line")).alias("claim")
    )


_PREFIX_TEST = " OR ".join(
    f"starts_with(lower({strip('ls[i]')}), '{p}')" for p in constants.SIGNATURE_PREFIXES
)
CLEAN_BODY_SQL = f"""
  SELECT id, CASE WHEN length(b) > 1000 THEN substr(b, 1, 1000) || '... [body truncated]' ELSE b END AS body FROM (
    SELECT id, {strip("array_to_string(ls[1:keep], chr(10))")} AS b FROM (
      SELECT id, ls, coalesce(list_min(list_filter(range(greatest(len(ls) - 4, 1), len(ls) + 1),
                 lambda i: {_PREFIX_TEST})) - 1, len(ls)) AS keep
      FROM (SELECT id, CASE WHEN parts[-1] = '' THEN parts[1:len(parts) - 1] ELSE parts END AS ls FROM (
        SELECT id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS parts
        FROM src))))
"""


@query("clean_body", f"WITH src AS (SELECT doc_id AS id, text FROM documents) SELECT id AS doc_id, body FROM ({CLEAN_BODY_SQL})")
def clean_body_q(spark, sf):
    return table(spark, sf, "documents").select("doc_id", headers.clean_body(F.col("text")).alias("body"))


_FLAGS = "|".join(p.replace("'", "''") for p in constants.SCHEMA_NARRATION_PATTERNS)


@query("text_checks", f"""
SELECT doc_id, CASE WHEN s = '' THEN 0 ELSE len(regexp_split_to_array(s, '{SPACE}+')) END AS n_words,
       CASE WHEN s = '' THEN 0 ELSE len(regexp_split_to_array(s, '{SPACE}+')) END >= 50 AS long_enough,
       regexp_matches(lower(text), '{_FLAGS}') AS narrates_schema
FROM (SELECT doc_id, text, {strip('text')} AS s FROM documents)
""")
def text_checks_q(spark, sf):
    from worksignal.functions.text import word_count

    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", word_count(text).cast("bigint").alias("n_words"), checks.long_enough(text).alias("long_enough"),
        checks.narrates_schema(text).alias("narrates_schema"),
    )


@query("keyword_presence", """
SELECT conv_id, turn,
       (CASE WHEN NOT (contains(lower(text), 'the') OR contains(lower(text), 'le')) THEN 1 ELSE 0 END
        + CASE WHEN NOT contains(lower(text), 'que') THEN 1 ELSE 0 END) AS n_missing,
       (CASE WHEN contains(lower(text), 'der') THEN 1 ELSE 0 END
        + CASE WHEN contains(lower(text), 'ing') THEN 1 ELSE 0 END) AS n_forbidden
FROM conversations
""")
def keyword_presence_q(spark, sf):
    required = F.array(F.array(F.lit("The"), F.lit("le")), F.array(F.lit("QUE")))
    forbidden = F.array(F.lit("der"), F.lit("ING"))
    text = F.col("text")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.size(checks.missing_keywords(text, required)).alias("n_missing"),
        F.size(checks.forbidden_keywords(text, forbidden)).alias("n_forbidden"),
    )


@query("thread_id", """
SELECT p_partkey, trim(lower(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS thread_id, p_size % 3 <> 2 AS is_reply FROM part
""")
def thread_id_q(spark, sf):
    lead = (
        F.when(F.col("p_size") % 3 == 0, F.lit("Re: FWD : fw:  "))
        .when(F.col("p_size") % 3 == 1, F.lit("re:"))
        .otherwise(F.lit(" "))
    )
    subject = F.concat(lead, F.initcap("p_name"), F.lit("  "))
    return table(spark, sf, "part").select(
        "p_partkey", headers.thread_id(subject).alias("thread_id"), headers.is_reply(subject).alias("is_reply")
    )


@query("from_header", """
SELECT c_custkey,
       CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN lower(c_mktsegment) || '.' || c_custkey || '@example.org' ELSE c_name END AS name,
       CASE c_custkey % 3 WHEN 2 THEN lower(c_name) ELSE lower(c_mktsegment) || '.' || c_custkey || '@example.org' END AS email,
       CASE c_custkey % 3 WHEN 2 THEN '' ELSE 'example.org' END AS domain
FROM customer
""")
def from_header_q(spark, sf):
    address = F.concat(F.col("c_mktsegment"), F.lit("."), F.col("c_custkey").cast("string"), F.lit("@example.org"))
    low = F.concat(F.lower("c_mktsegment"), F.lit("."), F.col("c_custkey").cast("string"), F.lit("@example.org"))
    header = (
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('"'), F.col("c_name"), F.lit('" <'), address, F.lit(">")))
        .when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("<"), low, F.lit(">")))
        .otherwise(F.col("c_name"))
    )
    email = headers.sender_email(F.col("h"))
    return table(spark, sf, "customer").withColumn("h", header).select(
        "c_custkey", headers.sender_name(F.col("h")).alias("name"), email.alias("email"),
        headers.sender_domain(email).alias("domain"),
    )


@query("identifier_tokens", """
SELECT c_custkey, array_to_string(regexp_extract_all('ask ' || c_name || ' about #' || c_nationkey, '#\\d+'), ',') AS ids FROM customer
""")
def identifier_tokens_q(spark, sf):
    text = F.concat(F.lit("ask "), F.col("c_name"), F.lit(" about #"), F.col("c_nationkey").cast("string"))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(identifiers(text), ",").alias("ids"))


@query("weekday_mentions", """
SELECT event_id, lower(dayname(ts)) || ',' || lower(dayname(ts + INTERVAL 1 DAY)) AS days FROM events
""")
def weekday_mentions_q(spark, sf):
    text = F.concat(
        F.date_format("ts", "EEEE"), F.lit(" is no Sundayish day, then "),
        F.upper(F.date_format(F.date_add("ts", 1), "EEEE")), F.lit(":"), F.col("event_type"),
    )
    return table(spark, sf, "events").select("event_id", F.array_join(weekday_mentions(text), ",").alias("days"))


@query("content_snapshots", """
SELECT source || '_' || lang || '_' || substr(sha256(text), 1, 12) AS snapshot, count(DISTINCT text) AS n_texts,
       CAST(min(length(text)) AS INT) AS n_chars
FROM documents GROUP BY 1
""")
def content_snapshots_q(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("source").alias("eval_name"), F.col("lang").alias("variant"), F.col("text").alias("prompt_text")
    )
    return prompt_snapshots(docs).select(
        "snapshot", F.lit(1).cast("bigint").alias("n_texts"), F.length("prompt_text").alias("n_chars")
    )


@query("extract_json", """
SELECT event_id, props AS payload, json_extract_string(props, '$.k') AS k FROM events
""")
def extract_json_q(spark, sf):
    props = F.col("props")
    kind = F.col("event_type")
    raw = (
        F.when(kind == "click", F.concat(F.lit("Here it is:\n```json\n"), props, F.lit("\n```\nDone.")))
        .when(kind == "view", F.concat(F.lit("```\n"), props, F.lit("\n```")))
        .when(kind == "error", F.concat(F.lit("The answer is "), props, F.lit(" as asked.")))
        .otherwise(props)
    )
    found = payload.extract_json(F.col("raw"))
    return table(spark, sf, "events").withColumn("raw", raw).select(
        "event_id", found.alias("payload"), payload.field(found, "k").alias("k")
    )


@query("leaf_text", """
SELECT doc_id, text || ' ' || source || ' ' || lang || ' ' || source AS leaves FROM documents
""")
def leaf_text_q(spark, sf):
    nested = F.to_json(F.struct(
        F.col("text").alias("description"), F.col("n_chars"),
        F.struct(F.col("source").alias("owner"), F.array("lang", "source").alias("tags")).alias("more"),
    ))
    return table(spark, sf, "documents").select("doc_id", payload.leaf_text(nested).alias("leaves"))


@query("schema_validation", """
SELECT event_id, CASE event_type
  WHEN 'click' THEN 'items[0] ok'
  WHEN 'view' THEN 'Expected ''items'' to be a list, got dict'
  WHEN 'error' THEN 'Not a JSON text'
  WHEN 'signup' THEN 'Expected a JSON object at top level, got list'
  ELSE '''items[1]'' missing keys: [''k'']; ''items[2]'' expected an object, got int' END AS outcome
FROM events
""")
def schema_validation_q(spark, sf):
    props, kind = F.col("props"), F.col("event_type")
    raw = (
        F.when(kind == "click", F.concat(F.lit('{"items": ['), props, F.lit("]}")))
        .when(kind == "view", F.concat(F.lit('{"items": '), props, F.lit("}")))
        .when(kind == "error", F.concat(props, F.lit(" oops")))
        .when(kind == "signup", F.concat(F.lit("["), props, F.lit("]")))
        .otherwise(F.concat(F.lit('{"items": ['), props, F.lit(', {"id": 1}, 7]}')))
    )
    errors = payload.schema_errors(F.col("raw"), {"items": ("k",)})
    return table(spark, sf, "events").withColumn("raw", raw).select(
        "event_id", F.coalesce(F.nullif(F.array_join(errors, "; "), F.lit("")), F.lit("items[0] ok")).alias("outcome")
    )


@query("excerpts", """
SELECT doc_id, substr(text, greatest(1, coalesce(nullif(least(
         CASE WHEN strpos(lower(text), 'que') > 0 THEN strpos(lower(text), 'que') ELSE 1000000000 END,
         CASE WHEN strpos(lower(text), 'ing') > 0 THEN strpos(lower(text), 'ing') ELSE 1000000000 END), 1000000000), 1) - 125), 250) AS excerpt
FROM documents
""")
def excerpts_q(spark, sf):
    from worksignal.functions.keywords import excerpt

    return table(spark, sf, "documents").select(
        "doc_id", excerpt(F.col("text"), F.array(F.lit("QUE"), F.lit("ing"))).alias("excerpt")
    )


@query("body_lines", """
SELECT conv_id, turn, CAST(len(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]'))
       - CASE WHEN regexp_matches(text, '[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]$') THEN 1 ELSE 0 END AS INT) AS n_lines,
       substr(sha256(text), 1, 12) AS address
FROM conversations
""")
def body_lines_q(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.size(lines_of(F.col("text"))).alias("n_lines"), content_hash(F.col("text")).alias("address")
    )
