"""The ledger over its life: daily roll-ups, runs that count by their commit, remembered answers, stored digests."""

from pyspark.sql import functions as F

from worksignal import schemas
from worksignal.catalog.registry import query, table
from worksignal.catalog.shapes import user_days
from worksignal.functions.dates import sort_day
from worksignal.operators import compaction, rendering
from worksignal.plans import brief_plan, model_stage
from worksignal.session import fresh_path, settle
from worksignal.sources import records, runs


def _entries(spark, sf):
    """One entry for each user's day of events, as mail."""
    days = user_days(spark, sf).groupBy("tenant_id", F.col("date_key").alias("day")).agg(F.count("*").alias("item_count"))
    return days.select(
        "tenant_id", F.lit("email").alias("source"), F.col("day").alias("entry_key"), "day", F.lit(None).cast("string").alias("note_id"), "item_count",
        F.create_map(F.lit("unique_senders"), F.col("item_count").cast("double")).alias("stats"), F.lit("persona").alias("map_variant"),
        F.lit(False).alias("hot"), F.lit(False).alias("compacted"), sort_day(F.col("day"), F.lit(False)).alias("sort_day"),
    )


def _items(spark, sf):
    """One decision for each event; purchases are important and so never merged."""
    priority = F.when(F.col("event_type") == "purchase", F.lit("P1")).otherwise(F.lit("P3"))
    return user_days(spark, sf).select(
        "tenant_id", F.lit("email").alias("source"), F.col("date_key").alias("entry_key"), F.lit("delta").alias("section"),
        F.lit("decisions").alias("category"), F.col("event_id").alias("ordinal"),
        F.to_json(F.struct(F.col("props").alias("description"), priority.alias("priority"))).alias("payload"), F.col("props").alias("text"),
    )


@query("weekly_compaction_daily", """
SELECT CAST(user_id AS VARCHAR) AS tenant_id, CASE WHEN old THEN strftime(d, '%G-W%V') ELSE strftime(d, '%Y-%m-%d') END AS entry_key,
       CAST(count(*) AS BIGINT) AS item_count, old AS compacted,
       CASE WHEN old THEN count(DISTINCT props) FILTER (WHERE event_type <> 'purchase') + count(*) FILTER (WHERE event_type = 'purchase')
            ELSE count(*) END AS n_item_lines,
       CASE WHEN old THEN count(DISTINCT d) ELSE 0 END AS n_day_lines
FROM (SELECT *, CAST(ts AS DATE) AS d, CAST(ts AS DATE) < DATE '2024-01-30' - 14 AS old FROM events) GROUP BY 1, 2, old
""")
def weekly_compaction_daily_q(spark, sf):
    """Three roll-ups in turn, of which the later ones open weeks of the earlier, and the lines of the ledger's text."""
    entries, items, cover = _entries(spark, sf), _items(spark, sf), None
    for day in ("2024-01-22", "2024-01-25", "2024-01-30"):
        entries, items, covered = (settle(df) for df in compaction.compact(entries, items, day, 14))
        cover = covered if cover is None else cover.unionByName(covered)
    lines = rendering.ledger_lines(entries, items, cover).groupBy("tenant_id", "entry_key").agg(
        F.count_if(F.col("part") == 4).alias("n_item_lines"), F.count_if(F.col("part") == 3).alias("n_day_lines")
    )
    return entries.join(lines, ["tenant_id", "entry_key"]).select(
        "tenant_id", "entry_key", "item_count", "compacted", "n_item_lines", "n_day_lines"
    )


@query("ledger_runs", """
SELECT CAST(user_id AS VARCHAR) AS tenant_id, event_type AS source, strftime(ts, '%Y-%m-%d') AS entry_key,
       CAST(count(*) * CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS BIGINT) AS item_count, 1 AS n_rows FROM events GROUP BY 1, 2, 3, event_type
""")
def ledger_runs_q(spark, sf):
    """A run, one that died before its commit, one that replaces a source, and one that adds another."""
    ledger = fresh_path(spark, "ledger")
    days = table(spark, sf, "events").groupBy(
        F.col("user_id").cast("string").alias("tenant_id"), F.col("event_type").alias("source"), F.date_format("ts", "yyyy-MM-dd").alias("day")
    ).agg(F.count("*").alias("item_count"))
    rows = settle(days.select(
        "tenant_id", "source", F.col("day").alias("entry_key"), "day", F.lit(None).cast("string").alias("note_id"), "item_count",
        F.lit(None).cast("map<string,double>").alias("stats"), F.lit("persona").alias("map_variant"), F.lit(False).alias("hot"),
        F.lit(False).alias("compacted"), F.col("day").cast("date").alias("sort_day"),
    ))
    late, wrong = F.col("source") == "purchase", F.col("source") == "error"
    steps = [(rows.filter(~late), None, True), (rows, None, False),
             (rows.filter(wrong).withColumn("item_count", F.col("item_count") * 2), rows.filter(wrong), True), (rows.filter(late), None, True)]
    for added, replaced, finished in steps:
        run = runs.new_run()
        runs.write_rows(added, ledger, "entries", run)
        if replaced is not None:
            runs.write_replaced(replaced, ledger, ["entries"], run)
        if finished:
            runs.commit(spark, ledger, run)
    return runs.read_table(spark, ledger, "entries").groupBy("tenant_id", "source", "entry_key").agg(
        F.sum("item_count").alias("item_count"), F.count("*").alias("n_rows")
    )


def answer_length(system_text: str, user_text: str) -> str:
    """The text's length; odd ones get an answer that is no JSON."""
    n = len(user_text)
    return f"no idea of {n}" if n % 2 else f'{{"found": [{{"n": {n}}}]}}'


@query("answers_remembered", """
WITH firsts AS (SELECT DISTINCT text FROM conversations WHERE role = 'user')
SELECT c.conv_id, c.turn, CASE WHEN length(c.text) % 2 = 1 THEN 'no idea of ' || length(c.text) ELSE '{"found": [{"n": ' || length(c.text) || '}]}' END AS response,
       CASE WHEN f.text IS NOT NULL AND length(c.text) % 2 = 1 THEN 2 ELSE 1 END AS n_asked
FROM conversations c LEFT JOIN firsts f ON f.text = c.text
""")
def answers_remembered_q(spark, sf):
    """Users' turns are asked about, then all turns: only what was not asked before, or had a bad answer, is asked again."""
    memory = model_stage.Remembered(answer_length, fresh_path(spark, "answers"), "rule", wave=500)
    talk = table(spark, sf, "conversations")
    units = talk.select(F.col("conv_id").cast("string").alias("tenant_id"), F.col("turn").cast("string").alias("unit_key"), F.col("text").alias("user_text"), "role")
    fits = model_stage.satisfies({"found": ("n",)})
    for some in (units.filter("role = 'user'"), units):
        told = model_stage.ask(model_stage.requests(some, "length", ""), memory, fits=fits)
    asked = model_stage.stored_answers(spark, memory.path).groupBy("key").agg(F.count("*").cast("int").alias("n_asked"))
    keyed = model_stage.requests(units, "length", "").withColumn("key", model_stage.request_key("rule")).select("tenant_id", "unit_key", "key")
    return told.join(keyed, ["tenant_id", "unit_key"]).join(asked, "key").select(
        F.col("tenant_id").cast("bigint").alias("conv_id"), F.col("unit_key").cast("bigint").alias("turn"), "response", "n_asked"
    )


def answer_digest(system_text: str, user_text: str) -> str:
    return "\n".join(f"{k} of {user_text.count('### ')} days and {user_text.count('DECISION [P1]')} decisions" for k in range(40))


@query("source_digests", """
SELECT tenant_id, 'email' AS source, first_line, '2024-01-30' AS run_ts FROM (
  SELECT CAST(user_id AS VARCHAR) AS tenant_id, '0 of ' || count(DISTINCT CAST(ts AS DATE)) || ' days and '
    || count(*) FILTER (WHERE event_type = 'purchase') || ' decisions' AS first_line, count(*) FILTER (WHERE CAST(ts AS DATE) < DATE '2024-01-30') AS n
  FROM events GROUP BY 1)
""")
def source_digests_q(spark, sf):
    """The ledgers' digests of two runs, stored with their history; what is current comes back."""
    entries, items, base = _entries(spark, sf), _items(spark, sf), fresh_path(spark, "digests")
    none = spark.createDataFrame([], schemas.LEDGER_COVER)
    for day in ("2024-01-29", "2024-01-30"):
        units = brief_plan.ledger_digest_units(entries.filter(F.col("day") <= day), items.filter(F.col("entry_key") <= day), none, day)
        told = model_stage.ask(model_stage.requests(units, "digest", ""), answer_digest)
        records.save_digests(told.select("tenant_id", F.col("unit_key").alias("source"), F.col("response").alias("digest")), base, day)
    current = records.latest_digests(records.read_digests(spark, base))
    return current.select("tenant_id", "source", F.substring_index("digest", "\n", 1).alias("first_line"), "run_ts")
