"""Days as units of work: grouping, windows, holdout, what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_DAY = ["tenant_id", "date_key"]


def merge_hot(cold: DataFrame, hot: DataFrame) -> DataFrame:
    """Stored rows and just-arrived rows, the latter marked."""
    return cold.withColumn("is_hot", F.lit(False)).unionByName(hot.withColumn("is_hot", F.lit(True)))


def day_batches(items: DataFrame) -> DataFrame:
    """(tenant_id, date_key, item_count, hot): a day is hot when any of its items is."""
    hot = F.bool_or("is_hot") if "is_hot" in items.columns else F.lit(False)
    return items.groupBy(*_DAY).agg(F.count("*").alias("item_count"), hot.alias("hot"))


def windowed_days(days: DataFrame, digest_days: int | None = None, holdout_days: int | None = None) -> DataFrame:
    """Days with `held_out`: the newest `digest_days` present, of which the newest `holdout_days` are held out.

    Nothing is held out when that would leave no day. Ranks run over the distinct days of a
    tenant, which the calendar bounds, never over its items.
    """
    ranked = days.withColumn(
        "age_rank", F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.col("date_key").desc()))
    ).withColumn("n_days", F.count("*").over(Window.partitionBy("tenant_id")))
    kept = F.col("n_days")
    if digest_days is not None:
        ranked = ranked.filter(F.col("age_rank") <= digest_days)
        kept = F.least(F.col("n_days"), F.lit(digest_days))
    held = F.lit(False)
    if holdout_days:
        held = (F.lit(holdout_days) < kept) & (F.col("age_rank") <= holdout_days)
    return ranked.withColumn("held_out", held).drop("age_rank", "n_days")


def of_days(items: DataFrame, days: DataFrame) -> DataFrame:
    """Items of the given days. The day table is small and joined as a filter."""
    return items.join(days.select(*_DAY), _DAY, "left_semi")


def unprocessed(units: DataFrame, processed: DataFrame, source: str, unit: str = "date_key") -> DataFrame:
    """Units (days or notes) of `source` that the ledger does not stand for yet."""
    done = processed.filter(F.col("source") == source).select("tenant_id", F.col("unit_key").alias(unit))
    return units.join(done, ["tenant_id", unit], "left_anti")


def unprocessed_or_hot(units: DataFrame, processed: DataFrame, source: str) -> DataFrame:
    """As `unprocessed`, but a hot day is taken again even when the ledger has it."""
    return unprocessed(units, processed, source).unionByName(units.filter("hot")).distinct()
