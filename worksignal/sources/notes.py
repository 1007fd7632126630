"""Notes scan: markdown files with a dated name, a title and checkboxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksignal.functions.text import not_blank, strip
from worksignal.sources.tenants import tenant_of_path

_DATED_NAME = "^(\\d{4}-\\d{2}-\\d{2})-(.+)\\.md$"
# Only a line feed ends a line here, so lines are anchored by what may not precede them.
_TITLE = "(?U)(?<![^\\n])#\\s+([^\\n]+)"
_CHECKBOX = "(?U)(?<![^\\n])\\s*-\\s*\\[( |x|X)\\]\\s*([^\\n]+)"


def parse_notes(raw: DataFrame) -> DataFrame:
    """Notes from (tenant_id, note_id, body) rows, `note_id` being the file name."""
    marks = F.regexp_extract_all("body", F.lit(_CHECKBOX), F.lit(1))
    texts = F.regexp_extract_all("body", F.lit(_CHECKBOX), F.lit(2))
    created = F.coalesce(not_blank(F.regexp_extract("note_id", _DATED_NAME, 1)), F.lit("unknown"))
    title = F.when(F.col("body").rlike(_TITLE), strip(F.regexp_extract("body", _TITLE, 1)))
    return raw.select(
        "tenant_id",
        "note_id",
        F.coalesce(title, F.col("note_id")).alias("title"),
        created.alias("created_at"),
        created.alias("date_key"),
        "body",
        F.zip_with(
            marks,
            texts,
            lambda mark, text: F.struct(strip(text).alias("text"), (F.lower(mark) == "x").alias("done")),
        ).alias("checklist_items"),
        F.array().cast("array<string>").alias("linked_entity_ids"),
    )


def read_notes(spark: SparkSession, *paths: str) -> DataFrame:
    files = (
        spark.read.option("pathGlobFilter", "*.md")
        .text(list(paths), wholetext=True)
        .select(
            tenant_of_path(F.col("_metadata.file_path")).alias("tenant_id"),
            F.col("_metadata.file_name").alias("note_id"),
            F.col("value").alias("body"),
        )
    )
    return parse_notes(files)
