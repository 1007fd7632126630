"""Blunt checks of produced text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from worksignal.functions.constants import MIN_WORDS, SCHEMA_NARRATION_PATTERNS
from worksignal.functions.text import contains_ci, word_count


def narrates_schema(text: Column) -> Column:
    """Whether a text describes a data format instead of saying something."""
    return F.lower(text).rlike("|".join(SCHEMA_NARRATION_PATTERNS))


def missing_keywords(text: Column, required: Column) -> Column:
    """Entries of `required` (each a set of alternatives) with no alternative in the text."""
    return F.filter(required, lambda alts: ~F.exists(alts, lambda alt: contains_ci(text, alt)))


def forbidden_keywords(text: Column, forbidden: Column) -> Column:
    return F.filter(forbidden, lambda word: contains_ci(text, word))


def long_enough(text: Column, words: int = MIN_WORDS) -> Column:
    return word_count(text) >= words


def bloat_ceiling(input_count: Column, floor: int, per_item: float) -> Column:
    """How many extracted items an input of this size may plausibly yield."""
    return F.greatest(F.lit(floor).cast("bigint"), F.bround(input_count * F.lit(per_item)).cast("bigint"))
