"""Facts computed from a note's checklist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksignal.functions.dates import as_date, strict_day


def note_stats(notes: DataFrame, reference_date) -> DataFrame:
    """Open and done items of each note, and how long the open ones have been open.

    The arrays hold the items of one note. A note without a date has no stale items.
    """
    open_items = F.filter("checklist_items", lambda item: ~item["done"])
    days = F.datediff(as_date(reference_date), strict_day(F.col("created_at")))
    stale = F.transform(
        open_items, lambda item: F.struct(item["text"].alias("text"), F.col("days_open"))
    )
    return notes.withColumn("days_open", days).select(
        "tenant_id",
        "note_id",
        "date_key",
        F.size(open_items).cast("bigint").alias("checklist_open"),
        (F.size("checklist_items") - F.size(open_items)).cast("bigint").alias("checklist_done"),
        F.when(F.col("days_open").isNotNull(), stale)
        .otherwise(F.array().cast("array<struct<text:string,days_open:int>>"))
        .alias("stale_open_items"),
    )
