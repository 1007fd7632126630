"""Task lists, personas and configuration files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksignal import schemas
from worksignal.functions.constants import DEFAULT_SYSTEM
from worksignal.sources.tenants import tenant_of_path


def read_tasks(spark: SparkSession, *paths: str) -> DataFrame:
    """Tasks of JSON files holding one array each; an unreadable file yields no task."""
    rows = (
        spark.read.schema(schemas.TASK_FILE)
        .option("multiLine", "true")
        .json(list(paths))
        .select(tenant_of_path(F.col("_metadata.file_path")).alias("tenant_id"), "*")
    )
    return rows.filter("id IS NOT NULL")


def parse_task_rows(raw: DataFrame) -> DataFrame:
    """Tasks from (tenant_id, task_json) rows, one object each."""
    parsed = raw.select("tenant_id", F.from_json("task_json", schemas.TASK_FILE).alias("task"))
    return parsed.select("tenant_id", "task.*").filter("id IS NOT NULL")


def read_personas(spark: SparkSession, *paths: str) -> DataFrame:
    return (
        spark.read.text(list(paths), wholetext=True)
        .select(
            tenant_of_path(F.col("_metadata.file_path")).alias("tenant_id"),
            F.col("value").alias("persona_text"),
        )
    )


def tenants_without_persona(tenants: DataFrame, personas: DataFrame) -> DataFrame:
    """Tenants that cannot run: a persona is required."""
    return tenants.join(personas.select("tenant_id"), "tenant_id", "left_anti")


def read_system_config(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The fleet's ceilings as one row; anything unset has its default."""
    base = spark.range(1).select(F.lit(1).alias("one"))
    if path is None:
        given = base.select(F.from_json(F.lit("{}"), schemas.SYSTEM_CONFIG_FILE).alias("c")).select("c.*")
    else:
        given = spark.read.schema(schemas.SYSTEM_CONFIG_FILE).option("multiLine", "true").json(path)
    return given.select(
        F.coalesce("max_qps_per_tenant", F.lit(DEFAULT_SYSTEM["max_qps_per_tenant"])).alias("max_qps_per_tenant"),
        F.coalesce(
            "allowed_providers", F.array(*[F.lit(p) for p in DEFAULT_SYSTEM["allowed_providers"]])
        ).alias("allowed_providers"),
        F.coalesce(
            "circuit_breaker_threshold", F.lit(DEFAULT_SYSTEM["circuit_breaker_threshold"])
        ).alias("circuit_breaker_threshold"),
    )


def merge_config(tenant_config: DataFrame, system_config: DataFrame) -> DataFrame:
    """Defaults, then the tenant's own values one level deep, then the fleet's values.

    The system side is one row by construction, so it joins to every tenant row.
    """
    no_strings = F.array().cast("array<string>")
    no_contacts = F.array().cast("array<struct<name:string,email:string>>")
    own = tenant_config.select(
        "tenant_id",
        F.coalesce("use_persona_in_map", F.lit(True)).alias("use_persona_in_map"),
        F.coalesce("never_draft_contacts", no_contacts).alias("never_draft_contacts"),
        F.struct(
            F.coalesce("map_noise_filter.blocked_senders", no_strings).alias("blocked_senders"),
            F.coalesce("map_noise_filter.blocked_domains", no_strings).alias("blocked_domains"),
        ).alias("map_noise_filter"),
    )
    fleet = system_config.agg(
        F.first("max_qps_per_tenant").alias("max_qps_per_tenant"),
        F.first("allowed_providers").alias("allowed_providers"),
        F.first("circuit_breaker_threshold").alias("circuit_breaker_threshold"),
    )
    return own.join(F.broadcast(fleet))


def parse_config_rows(raw: DataFrame) -> DataFrame:
    """Tenant configurations from (tenant_id, config_json) rows."""
    parsed = raw.select("tenant_id", F.from_json("config_json", schemas.TENANT_CONFIG_FILE).alias("c"))
    return parsed.select("tenant_id", "c.*")


def read_tenant_config(spark: SparkSession, *paths: str) -> DataFrame:
    return (
        spark.read.schema(schemas.TENANT_CONFIG_FILE)
        .option("multiLine", "true")
        .json(list(paths))
        .select(tenant_of_path(F.col("_metadata.file_path")).alias("tenant_id"), "*")
    )


def blocked_senders(config: DataFrame) -> DataFrame:
    """(tenant_id, kind, value) rows of a merged configuration's noise filter, lower-cased."""
    senders = config.select(
        "tenant_id", F.lit("sender").alias("kind"), F.explode("map_noise_filter.blocked_senders").alias("value")
    )
    domains = config.select(
        "tenant_id", F.lit("domain").alias("kind"), F.explode("map_noise_filter.blocked_domains").alias("value")
    )
    return senders.unionByName(domains).select("tenant_id", "kind", F.lower("value").alias("value")).distinct()
