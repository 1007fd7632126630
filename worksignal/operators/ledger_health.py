"""How current and how uniform a ledger is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksignal.functions.constants import STALE_AFTER_DAYS
from worksignal.functions.dates import as_date


def expected_sources(tenants: DataFrame, sources) -> DataFrame:
    """(tenant_id, source) rows for a fixed list of source kinds."""
    kinds = F.array(*[F.lit(s) for s in sources])
    return tenants.select("tenant_id").distinct().withColumn("source", F.explode(kinds))


def freshness(
    entries: DataFrame, expected: DataFrame, reference_date, stale_after: int = STALE_AFTER_DAYS
) -> DataFrame:
    """Newest day of each expected source and its age; a source without entries is stale.

    Entries whose day is no date do not count.
    """
    newest = entries.groupBy("tenant_id", "source").agg(F.max("sort_day").alias("newest"))
    age = F.datediff(as_date(reference_date), F.col("newest"))
    return expected.join(newest, ["tenant_id", "source"], "left").select(
        "tenant_id",
        "source",
        F.date_format("newest", "yyyy-MM-dd").alias("most_recent_day"),
        age.alias("days_stale"),
        F.coalesce(age > stale_after, F.lit(True)).alias("is_stale"),
    )


def variant_counts(entries: DataFrame) -> DataFrame:
    daily = entries.filter(~F.coalesce("compacted", F.lit(False)))
    return daily.groupBy(
        "tenant_id", "source", F.coalesce("map_variant", F.lit("unversioned")).alias("map_variant")
    ).agg(F.count("*").alias("entry_count"))


def mixed_variants(entries: DataFrame) -> DataFrame:
    """(tenant_id, source, n_variants, breakdown) where entries come from several configurations.

    The breakdown lists configurations, of which a ledger has a handful.
    """
    counts = variant_counts(entries)
    part = F.struct("map_variant", "entry_count")
    return (
        counts.groupBy("tenant_id", "source")
        .agg(F.count("*").alias("n_variants"), F.array_sort(F.collect_list(part)).alias("parts"))
        .filter("n_variants > 1")
        .select(
            "tenant_id",
            "source",
            "n_variants",
            F.array_join(
                F.transform("parts", lambda p: F.concat(p["map_variant"], F.lit(": "), p["entry_count"].cast("string"))),
                ", ",
            ).alias("breakdown"),
        )
    )


def variant_warning(mixed: DataFrame) -> DataFrame:
    text = F.concat(
        F.lit("Ledger mixes entries from "), F.col("n_variants").cast("string"),
        F.lit(" different MAP configurations ("), F.col("breakdown"), F.lit(")"),
    )
    return mixed.withColumn("warning", text)
