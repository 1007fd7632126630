"""Overdue, due-soon, blocked and stalled tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksignal.functions.constants import (
    DUE_SOON_DAYS,
    LOW_PRIORITIES,
    PRIORITIES,
    STALLED_AFTER_DAYS,
    STALLED_BELOW_RATIO,
    UNKNOWN_PRIORITY_RANK,
    URGENT_BUCKETS,
)
from worksignal.functions.dates import as_date, date_urgency, due_day, rounded


def priority_rank(priority: Column) -> Column:
    rank = F.lit(UNKNOWN_PRIORITY_RANK)
    for i, name in reversed(list(enumerate(PRIORITIES))):
        rank = F.when(priority == name, F.lit(i)).otherwise(rank)
    return rank


def with_progress(tasks: DataFrame) -> DataFrame:
    """Tasks with `subtasks_done` and `subtasks_total` of their own subtask array."""
    subtasks = F.coalesce("subtasks", F.array().cast("array<struct<title:string,done:boolean>>"))
    return tasks.withColumn("subtasks_total", F.size(subtasks).cast("bigint")).withColumn(
        "subtasks_done", F.size(F.filter(subtasks, lambda s: F.coalesce(s["done"], F.lit(False)))).cast("bigint")
    )


def task_signals(tasks: DataFrame, reference_date) -> DataFrame:
    """One row per task and bucket; a task may be in several.

    `tasks` carries `subtasks`, or `subtasks_done` and `subtasks_total` where subtasks are a
    table of their own. `days` is the bucket's own measure: days overdue, until due, blocked or open.
    """
    today = as_date(reference_date)
    progress = tasks if "subtasks_total" in tasks.columns else with_progress(tasks)
    status = F.coalesce("status", F.lit("todo"))
    open_task = status != "done"
    left = F.datediff(due_day(F.col("due_date")), today)
    age = F.datediff(today, due_day(F.col("created_at")))
    ratio = F.coalesce(F.try_divide("subtasks_done", "subtasks_total"), F.lit(0.0))

    def bucket(name, condition, days):
        return F.when(condition, F.struct(F.lit(name).alias("bucket"), days.alias("days")))

    buckets = F.array_compact(F.array(
        bucket("overdue", open_task & (left < 0), -left),
        bucket("due_soon", open_task & left.between(0, DUE_SOON_DAYS), left),
        bucket("blocked", status == "blocked", age),
        bucket("stalled", open_task & (age >= STALLED_AFTER_DAYS) & (ratio < STALLED_BELOW_RATIO), age),
    ))
    flagged = progress.withColumn("b", F.explode(buckets))
    is_blocked = F.col("b.bucket") == "blocked"
    return flagged.select(
        "tenant_id",
        F.col("b.bucket").alias("bucket"),
        "id",
        "title",
        F.coalesce("priority", F.lit("?")).alias("priority"),
        status.alias("status"),
        "due_date",
        "subtasks_done",
        "subtasks_total",
        F.col("b.days").alias("days"),
        F.when(is_blocked, F.coalesce("blocked_by", F.lit("unspecified"))).alias("blocked_by"),
        F.when(F.col("b.bucket") == "stalled", rounded(ratio)).alias("progress_ratio"),
    )


def signal_order() -> list[Column]:
    """Order inside a bucket: priority, then most urgent; an unknown blocked time counts as 0."""
    days = F.coalesce("days", F.lit(0))
    urgent = F.when(F.col("bucket") == "due_soon", days).otherwise(-days)
    return [priority_rank(F.col("priority")), urgent, F.col("id")]


def ordered_signals(signals: DataFrame) -> DataFrame:
    return signals.orderBy("tenant_id", "bucket", *signal_order())


def flagged_tasks(signals: DataFrame) -> DataFrame:
    """Each flagged task once."""
    return signals.groupBy("tenant_id", "id").agg(
        F.min("title").alias("title"), F.min("priority").alias("priority"), F.min("due_date").alias("due_date")
    )


def annotate_items(items: DataFrame, reference_date) -> DataFrame:
    """Structured items with `date_urgency` and whether their priority contradicts it."""
    urgency = date_urgency(F.col("due_date"), reference_date)
    return items.withColumn("date_urgency", urgency).withColumn(
        "priority_disagreement",
        F.col("date_urgency").isin(*URGENT_BUCKETS) & F.coalesce(F.col("priority").isin(*LOW_PRIORITIES), F.lit(False)),
    )
