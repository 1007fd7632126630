"""Reading the call log: load, errors and failure runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksignal.functions.constants import DEFAULT_SYSTEM, TERMINAL_STATUS_CODES
from worksignal.operators.ordered import running_sum


def error_class(status: Column) -> Column:
    """`terminal` for statuses no retry can mend, else `retryable`."""
    return F.when(status.isin(*TERMINAL_STATUS_CODES), F.lit("terminal")).otherwise(F.lit("retryable"))


def call_load(calls: DataFrame, max_qps: float = DEFAULT_SYSTEM["max_qps_per_tenant"]) -> DataFrame:
    """Per tenant, provider, model and minute: calls, rate, errors, latency and retries."""
    minute = F.date_trunc("MINUTE", "ts")
    return (
        calls.groupBy("tenant_id", "provider", "model", minute.alias("minute"))
        .agg(
            F.count("*").alias("n_calls"),
            F.count_if(~F.col("success")).alias("n_failed"),
            F.percentile_approx("latency_ms", 0.5, 10000).alias("median_latency_ms"),
            F.max("latency_ms").alias("max_latency_ms"),
            F.sum("retries").alias("retries"),
        )
        .withColumn("qps", F.col("n_calls") / 60)
        .withColumn("error_rate", F.col("n_failed") / F.col("n_calls"))
        .withColumn("over_limit", F.col("qps") > max_qps)
    )


def failure_runs(
    calls: DataFrame, threshold: int = DEFAULT_SYSTEM["circuit_breaker_threshold"], id_column: str = "call_id"
) -> DataFrame:
    """Runs of at least `threshold` failures in a row per provider and model.

    The number of successes before a failure names its run. It is a running sum over hour
    buckets, since a provider's calls are far too many for one task.
    """
    keys = ["provider", "model"]
    numbered = running_sum(
        calls.select(*keys, "ts", id_column, "success"),
        keys,
        F.date_trunc("HOUR", "ts"),
        [F.col("ts"), F.col(id_column)],
        F.col("success").cast("bigint"),
        "run",
    )
    return (
        numbered.filter(~F.col("success"))
        .groupBy(*keys, "run")
        .agg(F.count("*").alias("n_failures"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        .filter(F.col("n_failures") >= threshold)
        .drop("run")
    )
