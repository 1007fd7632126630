"""String helpers with Python's notion of whitespace, words and lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters, numbers and underscore: the word characters of the matching rules. Java's own
# Unicode \w also takes combining marks, which would move word boundaries.
WORD = "[\\p{L}\\p{N}_]"
SPACE = "[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]"
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def each(array: Column) -> Column:
    """One row per element, one NULL row for an empty array.

    A plain `explode` makes the optimizer add a filter that computes the array a second time,
    which for tokenized texts doubles the work. Joins and `IS NOT NULL` drop the NULL rows.
    """
    return F.explode_outer(array)


def kept(value: Column, condition) -> Column:
    """Rows whose `condition(value)` holds, carrying the value; the others give one NULL row.

    A costly value that is both tested and shown would be computed for the test and again for the
    result, since filters move below projections. Here it is computed once.
    """
    return F.explode_outer(F.filter(F.array(value), condition))


def strip(col: Column) -> Column:
    """Drop leading and trailing Unicode whitespace."""
    return F.regexp_replace(col, f"^{SPACE}+|{SPACE}+$", "")


def lines_of(col: Column) -> Column:
    """All lines of a text; a final line break does not open another line."""
    return let(
        F.split(col, LINE_BREAK),
        lambda parts: F.when(
            F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
        ).otherwise(parts),
    )


def word_count(col: Column) -> Column:
    """Number of whitespace-separated words."""
    return let(strip(col), lambda text: F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, f"{SPACE}+"))))


def any_of(col: Column, needles) -> Column:
    """True where the lower-cased text holds one of the fixed needles."""
    lowered = F.lower(col)
    found = F.lit(False)
    for needle in needles:
        found = found | lowered.contains(needle)
    return found


def contains_ci(text: Column, needle: Column) -> Column:
    return F.contains(F.lower(text), F.lower(needle))


def not_blank(col: Column) -> Column:
    """The value, or NULL where it is the empty string."""
    return F.nullif(col, F.lit(""))


def content_hash(col: Column, length: int = 12) -> Column:
    """Short content address of a text."""
    return F.substring(F.sha2(col, 256), 1, length)


def identifiers(col: Column) -> Column:
    """All `#12`-like instance numbers named in a text."""
    return F.regexp_extract_all(col, F.lit("#\\d+"), F.lit(0))


def citable(line: Column, placeholder: str) -> Column:
    """Whether a brief's line makes a claim: not blank, no header, no quote, no placeholder."""
    body = strip(line)
    return (
        (body != "")
        & ~body.startswith("#")
        & ~body.startswith(">")
        & (body != F.lit(placeholder))
    )
