"""Sinks and scans of what the jobs themselves produce: ledger, briefs, call log, evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksignal import schemas
from worksignal.functions.text import content_hash
from worksignal.session import shared_dir

_PARTITIONS = ("source", "tenant_bucket")
_BUCKETS = 64


def _bucketed(df: DataFrame) -> DataFrame:
    """Tenants share a fixed number of folders, so a million tenants make no million folders."""
    return df.withColumn("tenant_bucket", F.pmod(F.xxhash64("tenant_id"), F.lit(_BUCKETS)).cast("int"))


def _write_ledger(df: DataFrame, path: str, mode: str, rows_per_file: int) -> None:
    """Sorted by tenant and day within files; a large folder is written by as many tasks as its rows need.

    The folders' counts are at most as many as there are sources and buckets.
    """
    sort = "sort_day" if "sort_day" in df.columns else "entry_key"
    pieces = df.groupBy(*_PARTITIONS).agg(F.ceil(F.count("*") / rows_per_file).alias("pieces"))
    piece = F.pmod(F.xxhash64("tenant_id", "entry_key"), F.col("pieces")).alias("piece")
    (
        df.join(F.broadcast(pieces), list(_PARTITIONS))
        .repartition(*_PARTITIONS, piece)
        .sortWithinPartitions(*_PARTITIONS, "tenant_id", sort, "entry_key")
        .select(*df.columns)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*_PARTITIONS)
        .parquet(path)
    )


def append_ledger(df: DataFrame, path: str, rows_per_file: int = 2_000_000) -> None:
    """Add entries, items or covered rows; nothing already stored is read or rewritten."""
    _write_ledger(_bucketed(df), path, "append", rows_per_file)


def replace_ledger(df: DataFrame, path: str, rows_per_file: int = 2_000_000) -> None:
    """Replace what the ledger holds for the tenants and sources present in `df`.

    Only folders holding such a tenant are rewritten, other tenants' rows in them included. `df`
    usually derives from the ledger it replaces, so all rows are first written to the checkpoint
    folder.
    """
    spark = df.sparkSession
    shared_dir(spark)
    new = _bucketed(df)
    stored = spark.read.schema(new.schema).parquet(path)
    touched = new.select(*_PARTITIONS).distinct()
    replaced = new.select("tenant_id", "source").distinct()
    others = stored.join(touched, list(_PARTITIONS), "left_semi").join(replaced, ["tenant_id", "source"], "left_anti")
    settled = new.unionByName(others).checkpoint()
    _write_ledger(settled, path, "overwrite", rows_per_file)


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, tenant_bucket int").parquet(path).drop("tenant_bucket")


def of_tenant(ledger_path: str, spark: SparkSession, schema: str, tenant_id: str) -> DataFrame:
    """One tenant's rows; the folder follows from the id, so only that folder is read."""
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(tenant_id)), F.lit(_BUCKETS))).first()[0]
    rows = spark.read.schema(f"{schema}, tenant_bucket int").parquet(ledger_path)
    return rows.filter((F.col("tenant_bucket") == bucket) & (F.col("tenant_id") == tenant_id)).drop("tenant_bucket")


def processed_keys(entries: DataFrame, cover: DataFrame | None = None) -> DataFrame:
    """(tenant_id, source, unit_key) of every unit the ledger already stands for.

    A unit is a note for notes and a day otherwise. Units inside rolled-up weeks count too.
    """
    unit = F.when(F.col("source") == "notes", F.col("note_id")).otherwise(F.col("day"))
    own = entries.filter(~F.coalesce("compacted", F.lit(False))).select("tenant_id", "source", unit.alias("unit_key"))
    if cover is None:
        return own.distinct()
    covered = cover.select("tenant_id", "source", unit.alias("unit_key"))
    return own.unionByName(covered).distinct()


def save_brief(briefs: DataFrame, base: str, run_ts: str) -> None:
    """Overwrite the current briefs and add the same rows to the history of runs."""
    shared_dir(briefs.sparkSession)
    stamped = briefs.withColumn("run_ts", F.lit(run_ts)).checkpoint()
    stamped.write.mode("overwrite").parquet(f"{base}/current")
    stamped.write.mode("append").partitionBy("run_ts").parquet(f"{base}/history")


def latest_briefs(history: DataFrame, as_of: str | None = None, key: str = "tenant_id", at: str = "run_ts") -> DataFrame:
    """Each tenant's last stored brief, or the last one of runs up to `as_of`."""
    seen = history if as_of is None else history.filter(F.col(at) <= F.lit(as_of))
    rest = [c for c in history.columns if c != key]
    best = seen.groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("b"))
    return best.select(key, "b.*").select(*history.columns)


def save_digests(digests: DataFrame, base: str, run_ts: str) -> None:
    """Add a run's digests (tenant_id, source, digest) to the history; a run that is repeated replaces its own."""
    stamped = digests.select("tenant_id", "source", "digest", F.lit(run_ts).alias("run_ts"))
    stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_ts").parquet(base)


def read_digests(spark: SparkSession, base: str) -> DataFrame:
    """(tenant_id, source, digest, run_ts) of all runs."""
    return spark.read.schema("tenant_id string, source string, digest string, run_ts string").parquet(base)


def latest_digests(history: DataFrame, as_of: str | None = None) -> DataFrame:
    """The current digest of each tenant's sources, or the one as of a run: a run without one leaves the one before."""
    seen = history if as_of is None else history.filter(F.col("run_ts") <= F.lit(as_of))
    best = seen.groupBy("tenant_id", "source").agg(F.max_by(F.struct("digest", "run_ts"), "run_ts").alias("d"))
    return best.select("tenant_id", "source", "d.*")


def save_text(briefs: DataFrame, path: str, column: str = "brief") -> None:
    briefs.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def save_items(items: DataFrame, path: str) -> None:
    items.write.mode("overwrite").json(path)


def read_brief_texts(spark: SparkSession, *paths: str) -> DataFrame:
    """Finished briefs stored as text files, one row each."""
    from worksignal.sources.tenants import tenant_of_path

    return (
        spark.read.text(list(paths), wholetext=True)
        .select(tenant_of_path(F.col("_metadata.file_path")).alias("tenant_id"), F.col("value").alias("brief"))
    )


def append_calls(calls: DataFrame, path: str) -> None:
    calls.withColumn("latency_ms", F.bround("latency_ms", 1)).write.mode("append").json(path)


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """The call log with its time as TIMESTAMP."""
    return spark.read.schema(schemas.CALL_METRICS).json(path).withColumn("ts", F.col("ts").cast("timestamp"))


def append_eval_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").json(path)


def read_eval_runs(
    spark: SparkSession, path: str, eval_name: str | None = None, variant: str | None = None
) -> DataFrame:
    runs = spark.read.schema(schemas.EVAL_RUNS).json(path)
    if eval_name is not None:
        runs = runs.filter(F.col("eval_name") == eval_name)
    if variant is not None:
        runs = runs.filter(F.col("variant") == variant)
    return runs


def prompt_snapshots(prompts: DataFrame) -> DataFrame:
    """Content-addressed prompt texts from (eval_name, variant, prompt_text) rows, each text once."""
    named = prompts.withColumn(
        "snapshot",
        F.concat_ws("_", "eval_name", "variant", content_hash(F.col("prompt_text"))),
    )
    return named.groupBy("snapshot").agg(
        F.min("eval_name").alias("eval_name"),
        F.min("variant").alias("variant"),
        F.min("prompt_text").alias("prompt_text"),
    )


def add_prompt_snapshots(snapshots: DataFrame, known: DataFrame) -> DataFrame:
    """Snapshots not stored yet."""
    return snapshots.join(known.select("snapshot"), "snapshot", "left_anti")
