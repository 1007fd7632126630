"""A ledger written by runs: every row bears its run, and a run counts only once its commit row is there.

A run writes rows into several tables one after the other. One that dies between leaves rows that no
reader sees, and the run that repeats its work bears another id, so nothing is there twice. A run
either adds rows or replaces all rows of some tenants' sources; of those, only rows of the newest
committed run that replaced them, and of runs after it, count.

The folder of a ledger holds the tables entries, items and cover, `replaced` with what runs replaced, and
`commits`. One writer at a time is assumed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksignal import schemas
from worksignal.session import exists
from worksignal.sources.records import append_ledger

TABLES = {"entries": schemas.LEDGER_ENTRIES, "items": schemas.LEDGER_ITEMS, "cover": schemas.LEDGER_COVER}
_COMMITS = "run string, seq bigint, label string"
_REPLACED = "table string, tenant_id string, source string, run string"
_OWNER = ["tenant_id", "source"]


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table's rows; none where nothing was written yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def new_run() -> str:
    return uuid.uuid4().hex


def write_rows(df: DataFrame, ledger: str, table: str, run: str, rows_per_file: int = 2_000_000) -> None:
    """Adds the run's rows to entries, items or cover. They count once the run is committed."""
    append_ledger(df.withColumn("run", F.lit(run)), f"{ledger}/{table}", rows_per_file)


def write_replaced(owners: DataFrame, ledger: str, tables: list[str], run: str) -> None:
    """States that the run's rows stand for all that the tables held of these owners (tenant_id, source)."""
    rows = owners.select(*_OWNER).distinct().withColumn("table", F.explode(F.array(*[F.lit(t) for t in tables])))
    rows.select("table", *_OWNER, F.lit(run).alias("run")).write.mode("append").parquet(f"{ledger}/replaced")


def commits(spark: SparkSession, ledger: str) -> DataFrame:
    """(run, seq, label) of the committed runs: one row each."""
    return _read(spark, f"{ledger}/commits", _COMMITS)


def commit(spark: SparkSession, ledger: str, run: str, label: str | None = None) -> None:
    """Makes all rows of the run count, by one row in one file: it is there or it is not."""
    last = commits(spark, ledger).agg(F.max("seq")).first()[0] or 0
    spark.createDataFrame([(run, last + 1, label)], _COMMITS).coalesce(1).write.mode("append").parquet(f"{ledger}/commits")


def read_table(spark: SparkSession, ledger: str, table: str) -> DataFrame:
    """The rows of a table that count."""
    schema = TABLES[table]
    done = commits(spark, ledger).groupBy("run").agg(F.min("seq").alias("seq"))
    rows = _read(spark, f"{ledger}/{table}", f"{schema}, run string, tenant_bucket int").drop("tenant_bucket").join(done, "run")
    marks = _read(spark, f"{ledger}/replaced", _REPLACED).filter(F.col("table") == table).join(done, "run")
    since = marks.groupBy(*_OWNER).agg(F.max("seq").alias("since"))
    current = rows.join(since, _OWNER, "left").filter(F.col("since").isNull() | (F.col("seq") >= F.col("since")))
    return current.select(*spark.createDataFrame([], schema).columns)


def read_ledger_tables(spark: SparkSession, ledger: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, items, cover)."""
    return tuple(read_table(spark, ledger, name) for name in TABLES)


def tidy(spark: SparkSession, ledger: str, into: str) -> None:
    """Writes what counts to a new ledger, as one run: without replaced rows and those of runs that died."""
    if exists(spark, into):
        raise ValueError(f"{into} is there already")
    run = new_run()
    for name in TABLES:
        write_rows(read_table(spark, ledger, name), into, name, run)
    commit(spark, into, run, "tidy")
