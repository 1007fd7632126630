"""Tenants: ids taken from paths, checked against the allow-list."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worksignal.functions.constants import DEFAULT_TENANT, TENANT_PATTERN
from worksignal.functions.text import not_blank


def check_tenant_id(tenant_id: str) -> str:
    """The id itself; raises on anything that could leave the tenant's own folder."""
    if not re.fullmatch(TENANT_PATTERN.strip("^$"), tenant_id):
        raise ValueError(f"Invalid tenant_id {tenant_id!r}: must match {TENANT_PATTERN}")
    return tenant_id


def tenant_root(base: str, tenant_id: str = DEFAULT_TENANT) -> str:
    """A tenant's data folder: the base itself for the default tenant."""
    check_tenant_id(tenant_id)
    return base.rstrip("/") if tenant_id == DEFAULT_TENANT else f"{base.rstrip('/')}/tenants/{tenant_id}"


def tenant_of_path(path: Column) -> Column:
    return F.coalesce(not_blank(F.regexp_extract(path, "/tenants/([^/]+)/", 1)), F.lit(DEFAULT_TENANT))


def valid_tenants(df: DataFrame, column: str = "tenant_id") -> DataFrame:
    """Only rows of tenants with an allowed id."""
    return df.filter(F.col(column).rlike(TENANT_PATTERN))


def list_tenants(spark: SparkSession, base: str) -> DataFrame:
    """Every tenant that has a persona, from the folder names."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "persona.md")
        .option("recursiveFileLookup", "true")
        .load(base)
        .select(tenant_of_path(F.col("path")).alias("tenant_id"))
    )
    return valid_tenants(files.distinct())
