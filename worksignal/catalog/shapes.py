"""The given tables in the shapes the operators expect, derived row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksignal.catalog.registry import table

ISO = "yyyy-MM-dd'T'HH:mm:ss"


def mail(spark: SparkSession, sf: str) -> DataFrame:
    """Events as mail: one sender per user and event type, clicks being replies."""
    events = table(spark, sf, "events")
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    return events.select(
        F.lit("main").alias("tenant_id"),
        F.format_string("%012d.eml", "event_id").alias("filename"),
        F.format_string("<%d@example.org>", "event_id").alias("message_id"),
        F.concat(F.when(kind == "click", F.lit("Re: ")).otherwise(F.lit("")), kind, F.lit(" by "), user).alias("subject"),
        F.concat(F.lit("User "), user, F.lit(" <"), kind, F.lit("."), user, F.lit("@"), kind, F.lit(".example>")).alias("from_hdr"),
        F.lit("Owner <owner@example.org>").alias("to_hdr"),
        F.date_format("ts", ISO).alias("date_iso"),
        F.date_format("ts", "yyyy-MM-dd").alias("date_key"),
        F.col("props").alias("body"),
        F.lower(F.concat(kind, F.lit(" by "), user)).alias("thread_id"),
        F.lit(False).alias("is_hot"),
    )


def user_days(spark: SparkSession, sf: str) -> DataFrame:
    """Events as items of their user's days."""
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("tenant_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("date_key"),
        "event_id", "event_type", "value", "props", "ts",
    )


def calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Events as calendar entries of their user, `value` minutes long, purchases being focus time."""
    kind = F.col("event_type")
    summary = (
        F.when(kind == "purchase", F.lit("Focus time"))
        .when(kind == "click", F.lit("Board 1:1"))
        .when(kind == "view", F.lit("Customer planning"))
        .when(kind == "signup", F.lit("Retro"))
        .otherwise(F.lit("Errand"))
    )
    start = F.date_trunc("SECOND", F.col("ts")).cast("timestamp_ntz")
    status = F.when((kind == "error") & (F.col("value") > 20), F.lit("TENTATIVE")).otherwise(F.lit("CONFIRMED"))
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("tenant_id"),
        F.format_string("%012d", "event_id").alias("uid"),
        F.concat(summary, F.lit(" "), F.col("event_id").cast("string")).alias("summary"),
        status.alias("status"),
        F.col("props").alias("description"),
        F.lit("").alias("location"),
        start.alias("start"),
        F.timestamp_add("MINUTE", F.floor("value").cast("int"), start).alias("end"),
        F.date_format("ts", "yyyy-MM-dd").alias("date_key"),
        F.array(F.struct(
            F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("name"),
            F.concat(F.col("user_id").cast("string"), F.lit("@example.org")).alias("email"),
            F.lit("ACCEPTED").alias("partstat"),
        )).alias("attendees"),
    )


def order_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as tasks of their customer, order lines being subtasks."""
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    progress = lines.groupBy("l_orderkey").agg(
        F.count_if(F.col("l_linestatus") == "F").alias("done"), F.count("*").alias("total")
    )
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    status = F.col("o_orderstatus")
    return orders.join(progress, orders.o_orderkey == progress.l_orderkey, "left").select(
        F.col("o_custkey").cast("string").alias("tenant_id"),
        F.format_string("ORD-%010d", "o_orderkey").alias("id"),
        F.concat(F.lit("Settle order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.when(status == "F", F.lit("done")).when(status == "P", F.lit("blocked")).otherwise(F.lit("todo")).alias("status"),
        F.concat(F.lit("P"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).cast("string")).alias("priority"),
        day.alias("due_date"),
        day.alias("created_at"),
        F.when(status == "P", F.col("o_orderpriority")).alias("blocked_by"),
        F.coalesce("done", F.lit(0)).alias("subtasks_done"),
        F.coalesce("total", F.lit(0)).alias("subtasks_total"),
    )


def document_sources(spark: SparkSession, sf: str, tenant: str | None = None) -> DataFrame:
    """Documents as citable sources; their language stands for the kind of source."""
    kind = (
        F.when(F.col("lang") == "en", F.lit("email"))
        .when(F.col("lang") == "fr", F.lit("notes"))
        .when(F.col("lang") == "de", F.lit("calendar"))
        .otherwise(F.lit("task"))
    )
    return table(spark, sf, "documents").select(
        (F.lit("main") if tenant is None else F.col(tenant)).alias("tenant_id"),
        kind.alias("source"),
        F.format_string("%09d", "doc_id").alias("ref"),
        F.col("doc_id").cast("string").alias("label"),
        "text",
    )


DOCUMENT_KIND_SQL = "CASE lang WHEN 'en' THEN 'email' WHEN 'fr' THEN 'notes' WHEN 'de' THEN 'calendar' ELSE 'task' END"


def benchmark_claims(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        F.lit("main").alias("tenant_id"), F.col("item_id").cast("string").alias("claim_id"), "text"
    )
