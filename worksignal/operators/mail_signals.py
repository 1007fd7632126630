"""Facts computed from mail: noise filter, day statistics, quiet senders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksignal.functions.constants import QUIET_AFTER_DAYS
from worksignal.functions.dates import strict_day
from worksignal.functions.headers import is_reply, sender_domain, sender_email, sender_name


def drop_blocked(emails: DataFrame, blocked: DataFrame) -> DataFrame:
    """Mail not sent by a blocked address or domain. `blocked`: (tenant_id, kind, value).

    Runs before grouping, so blocked mail costs nothing downstream.
    """
    rated = emails.withColumn("__email", sender_email(F.col("from_hdr"))).withColumn(
        "__domain", sender_domain(F.col("__email"))
    )
    for kind, column in (("sender", "__email"), ("domain", "__domain")):
        rules = blocked.filter(F.col("kind") == kind).select("tenant_id", F.col("value").alias(column))
        rated = rated.join(rules, ["tenant_id", column], "left_anti")
    return rated.select(*emails.columns)


def day_mail_stats(emails: DataFrame) -> DataFrame:
    """(tenant_id, date_key, email_count, unique_senders, reply_count, new_thread_count, avg_body_chars)."""
    rated = emails.select(
        "tenant_id",
        "date_key",
        sender_email(F.col("from_hdr")).alias("sender"),
        is_reply(F.col("subject")).alias("reply"),
        F.length(F.coalesce("body", F.lit(""))).alias("chars"),
    )
    # Counting per sender first spreads a busy day over many tasks.
    per_sender = rated.groupBy("tenant_id", "date_key", "sender").agg(
        F.count("*").alias("n"), F.count_if("reply").alias("replies"), F.sum("chars").alias("chars")
    )
    return per_sender.groupBy("tenant_id", "date_key").agg(
        F.sum("n").alias("email_count"),
        F.count("*").alias("unique_senders"),
        F.sum("replies").alias("reply_count"),
        (F.sum("n") - F.sum("replies")).alias("new_thread_count"),
        F.bround(F.sum("chars") / F.sum("n")).cast("bigint").alias("avg_body_chars"),
    )


def quiet_senders(emails: DataFrame, quiet_days: int = QUIET_AFTER_DAYS) -> DataFrame:
    """Senders whose last mail is at least `quiet_days` before the tenant's newest mail.

    The name is the one of the sender's first mail by date and file.
    """
    known = emails.filter("date_key <> 'unknown'").select(
        "tenant_id",
        "date_key",
        sender_email(F.col("from_hdr")).alias("email"),
        sender_name(F.col("from_hdr")).alias("name"),
        F.struct("date_iso", "filename").alias("place"),
    )
    newest = known.groupBy("tenant_id").agg(F.max("date_key").alias("newest"))
    activity = known.groupBy("tenant_id", "email").agg(
        F.min_by("name", "place").alias("name"),
        F.count("*").alias("email_count"),
        F.min("date_key").alias("first_seen"),
        F.max("date_key").alias("last_seen"),
    )
    quiet = F.datediff(strict_day(F.col("newest")), strict_day(F.col("last_seen")))
    return (
        activity.join(newest, "tenant_id")
        .withColumn("days_since_last_contact", quiet)
        .filter(F.col("days_since_last_contact") >= quiet_days)
        .select("tenant_id", "name", "email", "email_count", "first_seen", "last_seen", "days_since_last_contact")
    )
