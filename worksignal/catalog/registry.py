"""Registry of queries over the given tables, and the pieces their SQL shares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from worksignal.functions.constants import PROSE_STOP_WORDS, TITLE_STOP_WORDS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; `sql` is the same question for a SQL engine."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def word_list(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(set(words)))


TITLE_STOP = word_list(TITLE_STOP_WORDS)
ALL_STOP = word_list((*TITLE_STOP_WORDS, *PROSE_STOP_WORDS))
WORD = "[\\pL\\pN_]"
SPACE = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\pZ]"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def keywords(rows: str, ids: str, text: str = "text", stop: str = TITLE_STOP) -> str:
    """(ids, w): keywords of a text as written, repeats kept."""
    return (
        f"SELECT {ids}, w FROM (SELECT {ids}, unnest(regexp_extract_all({text}, '[A-Za-z][A-Za-z''-]*')) AS w "
        f"FROM {rows}) WHERE length(w) >= 3 AND lower(w) NOT IN ({stop})"
    )


def words(rows: str, ids: str, text: str = "text") -> str:
    """(ids, k): distinct whole words of a text, lower-cased."""
    return (
        f"SELECT DISTINCT {ids}, k FROM (SELECT {ids}, unnest(regexp_extract_all(lower({text}), '{WORD}+')) AS k FROM {rows})"
    )


def mention_regex(k: str) -> str:
    """RE2 pattern for a lower-cased keyword on word boundaries."""
    return (
        f"'(^|[^\\pL\\pN_])' || {k} || CASE WHEN regexp_matches({k}, '[''-]$') THEN '{WORD}' "
        f"ELSE '($|[^\\pL\\pN_])' END"
    )


# Events in the role of mail: one sender per user and event type, clicks being replies.
MAIL_SQL = """
SELECT 'main' AS tenant_id, event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS date_iso,
       strftime(ts, '%Y-%m-%d') AS date_key,
       event_type || '.' || user_id || '@' || event_type || '.example' AS email,
       'User ' || user_id AS name,
       event_type, user_id, props AS body,
       CASE WHEN event_type = 'click' THEN 'Re: ' ELSE '' END || event_type || ' by ' || user_id AS subject
FROM events
"""
