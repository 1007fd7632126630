"""Mail headers and bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from worksignal.functions.constants import (
    BODY_LIMIT,
    BODY_TRUNCATED,
    FROM_HEADER_PATTERN,
    REPLY_PREFIXES,
    SIGNATURE_LINES,
    SIGNATURE_PREFIXES,
)
from worksignal.functions.text import SPACE, let, lines_of, not_blank, strip


def thread_id(subject: Column) -> Column:
    """Subject without repeated reply prefixes, spaces collapsed, lower-cased."""
    bare = F.regexp_replace(subject, f"(?i)^(?:(?:Re|Fwd|Fw){SPACE}*:{SPACE}*)++", "")
    return F.lower(strip(F.regexp_replace(bare, f"{SPACE}+", " ")))


def is_reply(subject: Column) -> Column:
    head = F.lower(strip(F.coalesce(subject, F.lit(""))))
    found = F.lit(False)
    for prefix in REPLY_PREFIXES:
        found = found | head.startswith(prefix)
    return found


def _from_group(header: Column, group: int) -> Column:
    pattern = "(?U)" + FROM_HEADER_PATTERN
    return not_blank(F.regexp_extract(strip(F.coalesce(header, F.lit(""))), pattern, group))


def sender_email(header: Column) -> Column:
    """Lower-cased address of a From header, or the raw header where it holds none."""
    raw = not_blank(strip(F.coalesce(header, F.lit(""))))
    return F.lower(F.coalesce(_from_group(header, 2), raw, F.lit("unknown")))


def sender_name(header: Column) -> Column:
    """Display name of a From header, else its address, else the raw header."""
    raw = not_blank(strip(F.coalesce(header, F.lit(""))))
    address = _from_group(header, 2)
    name = not_blank(strip(F.coalesce(_from_group(header, 1), F.lit(""))))
    return F.when(address.isNotNull(), F.coalesce(name, address)).otherwise(F.coalesce(raw, F.lit("unknown")))


def sender_domain(address: Column) -> Column:
    """What follows the last @, empty where there is none."""
    return F.when(address.contains("@"), F.substring_index(address, "@", -1)).otherwise(F.lit(""))


def clean_body(body: Column, limit: int = BODY_LIMIT) -> Column:
    """Cut the signature found in the last lines, strip, and cap the length with a marker."""

    def without_signature(lines):
        tail_from = F.greatest(F.size(lines) - SIGNATURE_LINES + 1, F.lit(1))
        starts = F.transform(
            F.slice(lines, tail_from, F.lit(SIGNATURE_LINES)),
            lambda line: let(F.lower(strip(line)), lambda head: F.greatest(*[head.startswith(p) for p in SIGNATURE_PREFIXES])),
        )
        keep = let(
            F.array_position(starts, True).cast("int"),
            lambda cut: F.when(cut > 0, tail_from + cut - 2).otherwise(F.size(lines)),
        )
        return strip(F.array_join(F.slice(lines, F.lit(1), keep), "\n"))

    text = let(lines_of(F.coalesce(body, F.lit(""))), without_signature)
    return let(
        text,
        lambda t: F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit(BODY_TRUNCATED))).otherwise(t),
    )
