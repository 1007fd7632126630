"""New days entering the ledger, and days counted behind a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksignal.functions.dates import sort_day
from worksignal.operators.days import day_batches, of_days, unprocessed
from worksignal.session import discard, exists
from worksignal.session import settle as durable
from worksignal.sources import runs
from worksignal.sources.records import processed_keys
from worksignal.streaming.progress import run_logged


def arrivals_writer(staging: str) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function storing each batch under its number, so a replayed batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{staging}/arrival={batch_id:012d}")

    return write


def ledger_entries(
    arrived: DataFrame, known: DataFrame, source: str, facts: Callable[[DataFrame], DataFrame], variant: str = "persona"
) -> DataFrame:
    """Ledger entries of the days in `arrived` that are not in `known` yet.

    `facts` turns items into (tenant_id, unit_key, item_count, stats).
    """
    todo = unprocessed(day_batches(arrived), known, source)
    return facts(of_days(arrived, todo)).join(
        todo.select("tenant_id", F.col("date_key").alias("unit_key"), "hot"), ["tenant_id", "unit_key"]
    ).select(
        "tenant_id", F.lit(source).alias("source"), F.col("unit_key").alias("entry_key"),
        F.col("unit_key").alias("day"), F.lit(None).cast("string").alias("note_id"),
        F.col("item_count").cast("bigint").alias("item_count"), "stats", F.lit(variant).alias("map_variant"),
        "hot", F.lit(False).alias("compacted"), sort_day(F.col("unit_key"), F.lit(False)).alias("sort_day"),
    )


def _next_arrivals(spark: SparkSession, ledger: str, stem: str) -> str:
    """The label of the first run of arrivals that is not committed."""
    done = runs.commits(spark, ledger).filter(F.col("label").startswith(f"{stem} ")).count()
    return f"{stem} {done:09d}"


def run_ledger_stream(
    stream: DataFrame, ledger: str, checkpoint: str, source: str, facts, variant: str = "persona"
) -> DataFrame:
    """Take in everything that has arrived, then add its new days to the ledger; returns the late items.

    A day is counted once all arrivals of the run are stored, so the size of the batches changes
    nothing. Each run's arrivals are in a folder of their own, and the commit of the run's days says that
    they are taken: a run that dies before leaves them for the next one, and one that dies after does
    not count them twice. Items of a day that was in the ledger before change nothing:
    (tenant_id, date_key, n_late) counts those of this run.
    """
    spark = stream.sparkSession
    label = _next_arrivals(spark, ledger, f"{source} arrivals of {checkpoint}")
    folder = f"{checkpoint}/arrived/{label.rsplit(' ', 1)[1]}"
    query = (
        stream.writeStream.foreachBatch(arrivals_writer(folder))
        .option("checkpointLocation", f"{checkpoint}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if not exists(spark, folder):  # nothing arrived
        return spark.createDataFrame([], "tenant_id string, date_key string, n_late bigint")
    arrived = spark.read.schema(stream.schema).parquet(folder)
    known = durable(processed_keys(runs.read_table(spark, ledger, "entries"), runs.read_table(spark, ledger, "cover")))
    entries = durable(ledger_entries(arrived, known, source, facts, variant))
    own = entries.select("tenant_id", F.col("day").alias("date_key"))
    late = durable(arrived.join(own, ["tenant_id", "date_key"], "left_anti").groupBy("tenant_id", "date_key").agg(F.count(F.lit(1)).alias("n_late")))
    run = runs.new_run()
    runs.write_rows(entries, ledger, "entries", run)
    runs.commit(spark, ledger, run, label)
    discard(spark, folder)
    return late


def closed_days(stream: DataFrame, time_column: str, holdout_days: int) -> DataFrame:
    """Item counts of days, each emitted once it is older than the newest `holdout_days`.

    Append mode behind a watermark: later items for an emitted day are dropped and counted by
    Spark as late. The time column must be TIMESTAMP.
    """
    return (
        stream.withWatermark(time_column, f"{holdout_days} days")
        .groupBy("tenant_id", F.window(time_column, "1 day").alias("w"))
        .agg(F.count("*").alias("item_count"))
        .select("tenant_id", F.date_format("w.start", "yyyy-MM-dd").alias("date_key"), "item_count")
    )


def week_counts(stream: DataFrame, time_column: str, retention_days: int) -> DataFrame:
    """Item counts of ISO weeks, emitted after the retention. Windows start on Mondays."""
    return (
        stream.withWatermark(time_column, f"{retention_days} days")
        .groupBy("tenant_id", F.window(time_column, "7 days", "7 days", "4 days").alias("w"))
        .agg(F.count("*").alias("item_count"))
        .select("tenant_id", F.to_date("w.start").alias("week_start"), "item_count")
    )


def first_of_each(stream: DataFrame, time_column: str, delay: str, keys: list[str]) -> DataFrame:
    """Items once per key, repeats arriving within the delay dropped.

    Items older than the delay when they arrive are dropped one by one, and the progress counts them.
    """
    return stream.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(keys)


def settle(stream: DataFrame, path: str, checkpoint: str, progress: str | None = None) -> DataFrame:
    """Run an append stream over all that has arrived and return what it wrote; `progress` as in `run_logged`."""
    writer = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
    )
    run_logged(writer, progress)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
