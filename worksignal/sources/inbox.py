"""Mail scan: one row per message file, bad files kept with their error."""

from __future__ import annotations

import email
from collections.abc import Iterator
from email import policy
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksignal.functions.headers import clean_body, thread_id
from worksignal.session import spread
from worksignal.sources.tenants import tenant_of_path

_DECODED = (
    "tenant_id string, filename string, subject string, from_hdr string, to_hdr string, "
    "message_id string, date_iso string, date_ok boolean, raw_body string, parse_error string"
)


def _body_text(message) -> str:
    """Decoded text of the message, or of its first plain-text part holding any."""
    parts = message.walk() if message.is_multipart() else [message]
    for part in parts:
        if message.is_multipart() and part.get_content_type() != "text/plain":
            continue
        payload = part.get_payload(decode=True)
        if not payload:
            continue
        try:
            return payload.decode(part.get_content_charset() or "utf-8")
        except (UnicodeDecodeError, LookupError):
            return payload.decode("utf-8", errors="replace")
    return ""


def _decode(tenant_id: str, filename: str, content: bytes) -> dict:
    row = {"tenant_id": tenant_id, "filename": filename}
    try:
        text = bytes(content).decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
        message = email.message_from_string(text, policy=policy.default)
        for column, header in (
            ("subject", "Subject"), ("from_hdr", "From"), ("to_hdr", "To"), ("message_id", "Message-ID"),
        ):
            row[column] = str(message.get(header, ""))
        date_text = str(message.get("Date", ""))
        try:
            row["date_iso"], row["date_ok"] = parsedate_to_datetime(date_text).isoformat(), True
        except (ValueError, TypeError):
            row["date_iso"], row["date_ok"] = date_text, False
        row["raw_body"] = _body_text(message)
    except Exception as error:  # one bad message must not fail the scan
        row["parse_error"] = f"{type(error).__name__}: {error}"
    return row


def _decode_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [part.split()[0] for part in _DECODED.split(", ")]
    for batch in batches:
        rows = [_decode(*values) for values in zip(batch.tenant_id, batch.filename, batch.content)]
        yield pd.DataFrame(rows, columns=columns, dtype=object)


def parse_messages(raw: DataFrame, hot: bool = False) -> DataFrame:
    """Mail rows from (tenant_id, filename, content) rows.

    MIME decoding is the one step done in Python; everything derived is a column expression.
    """
    decoded = spread(raw.select("tenant_id", "filename", "content")).mapInPandas(_decode_batches, _DECODED)
    return decoded.select(
        "tenant_id",
        "filename",
        "message_id",
        "subject",
        "from_hdr",
        "to_hdr",
        "date_iso",
        F.when(F.col("date_ok"), F.col("date_iso").try_cast("timestamp")).alias("sent_at"),
        F.when(F.col("date_ok"), F.substring("date_iso", 1, 10)).otherwise(F.lit("unknown")).alias("date_key"),
        clean_body(F.col("raw_body")).alias("body"),
        thread_id(F.col("subject")).alias("thread_id"),
        F.lit(hot).alias("is_hot"),
        "parse_error",
    )


def read_inbox(spark: SparkSession, *paths: str, hot: bool = False) -> DataFrame:
    """All `*.eml` files below the given folders; tenants come from the paths."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.eml")
        .load(list(paths))
        .select(
            tenant_of_path(F.col("path")).alias("tenant_id"),
            F.element_at(F.split("path", "/"), -1).alias("filename"),
            "content",
        )
    )
    return parse_messages(files, hot)


def quarantined(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rows that failed to parse."""
    return rows.filter("parse_error IS NULL"), rows.filter("parse_error IS NOT NULL")
