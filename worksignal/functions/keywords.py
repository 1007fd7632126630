"""Keyword extraction and word-boundary mentions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from worksignal.functions.constants import (
    EXCERPT_WINDOW,
    KEYWORD_PATTERN,
    MIN_KEYWORD_LENGTH,
    PROSE_STOP_WORDS,
    TITLE_STOP_WORDS,
)
from worksignal.functions.text import WORD, let

_WORDS_OF_TEXT = f"(?<!{WORD})[a-z]++(?!{WORD})"
_GLUED_RUNS = f"(?<![\\p{{L}}\\p{{N}}_'-]){WORD}*+['-][\\p{{L}}\\p{{N}}_'-]*+"


def title_keywords(title: Column, min_length: int = MIN_KEYWORD_LENGTH) -> Column:
    """Keywords in order, in their own case, repeats kept."""
    words = F.regexp_extract_all(title, F.lit(KEYWORD_PATTERN), F.lit(0))
    return F.filter(
        words,
        lambda w: (F.length(w) >= min_length) & ~F.lower(w).isin(*TITLE_STOP_WORDS),
    )


def prose_keywords(text: Column, min_length: int = MIN_KEYWORD_LENGTH) -> Column:
    """Title keywords without the words ordinary prose is full of; lower-cased, repeats kept."""
    stop = sorted(set(TITLE_STOP_WORDS) | set(PROSE_STOP_WORDS))
    words = F.regexp_extract_all(text, F.lit(KEYWORD_PATTERN), F.lit(0))
    lowered = F.transform(words, lambda w: F.lower(w))
    return F.filter(lowered, lambda w: (F.length(w) >= min_length) & ~w.isin(*stop))


def lowered_keyword_set(text: Column) -> Column:
    """Distinct lower-cased title keywords: what a source counts towards term frequencies."""
    return F.array_distinct(F.transform(title_keywords(text), lambda w: F.lower(w)))


def word_set(text: Column) -> Column:
    """Distinct ASCII words standing alone in the text: every word a plain keyword can hit."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_WORDS_OF_TEXT), F.lit(0)))


def glued_set(text: Column) -> Column:
    """Distinct runs holding a hyphen or apostrophe: all a compound keyword can hit.

    A compound keyword and the characters deciding its boundaries lie inside one such run, so
    testing the runs is the same as testing the whole text.
    """
    runs = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_GLUED_RUNS), F.lit(0)))
    # The plain search for the marks is far cheaper than the pattern.
    return F.when(text.contains("-") | text.contains("'"), runs).otherwise(F.array().cast("array<string>"))


def is_compound(keyword: Column) -> Column:
    return keyword.rlike("['-]")


def index_word(keyword: Column) -> Column:
    """The plain word under which a lower-cased keyword is looked up."""
    return F.regexp_extract(keyword, "^[a-z]+", 0)


def mention_pattern(keyword: Column) -> Column:
    """Regex for a lower-cased keyword on word boundaries.

    After a closing hyphen or apostrophe the boundary means that a word character follows.
    """
    tail = F.when(keyword.rlike("['-]$"), F.lit(f"(?={WORD})")).otherwise(F.lit(f"(?!{WORD})"))
    return F.concat(F.lit(f"(?<!{WORD})"), keyword, tail)


def mentioned(words: Column, glued: Column, keyword: Column) -> Column:
    """Whether one lower-cased keyword is mentioned in a text given as word and glued sets."""
    return F.when(
        is_compound(keyword),
        F.exists(glued, lambda run: F.rlike(run, mention_pattern(keyword))),
    ).otherwise(F.array_contains(words, keyword))


def mentions(words: Column, glued: Column, keywords: Column) -> Column:
    """The mentioned lower-cased keywords, repeats kept.

    One pass over the text's words finds the plain keywords; only those few are then looked through.
    """
    return let(
        F.array_intersect(words, keywords),
        lambda plain: F.filter(keywords, lambda k: mentioned(plain, glued, k)),
    )


def excerpt(text: Column, keywords: Column, window: int = EXCERPT_WINDOW) -> Column:
    """A window of text around the earliest plain occurrence of a keyword."""

    def around(lowered):
        hits = F.filter(F.transform(keywords, lambda k: F.position(F.lower(k), lowered)), lambda p: p > 0)
        return F.greatest(F.lit(1), F.coalesce(F.array_min(hits), F.lit(1)) - window // 2)

    return F.substring(text, let(F.lower(text), around), F.lit(window))
