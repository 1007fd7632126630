"""Keyword matching of claims against sources.

claims: (tenant_id, claim_id, text); sources: (tenant_id, source, ref, text) with one row per
(tenant_id, source, ref). A source matches a claim when it mentions at least
`max(2, 40 % of the claim's keywords)`.

Words are counted block of claims by block of sources (`blocks.py`), so no pair that fails the bar leaves a task. Of
sources read for one search whose claims have few different keywords, only these are kept (`asked_index`).
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksignal.functions.constants import (
    COMMON_TERM_THRESHOLD,
    KEYWORD_PATTERN,
    MIN_MATCH_RATIO,
    MIN_SOURCES_FOR_COMMON_FILTER,
)
from worksignal.functions.keywords import (
    glued_set,
    is_compound,
    lowered_keyword_set,
    prose_keywords,
    word_set,
)
from worksignal.functions.text import each
from worksignal.operators.blocks import BLOCK_TERMS, codes, compound_terms, flat, hashes, hits, meet, small
from worksignal.session import discard, fresh_path, release, settle, spread

_REF = ["tenant_id", "source", "ref"]
_FEW_KEYWORDS = 50_000  # of all claims, sent to every task
_BATCH_BYTES = 16 << 20
# A run holds whole words and whole keywords.
_RUN, _KEYWORD, _WORD = (re.compile(x) for x in (r"[\w'-]+", KEYWORD_PATTERN, r"(?<!\w)[a-z]+(?!\w)"))
_MATCH = "tenant_id string, claim_id string, source string, ref string, n_matched int, n_keywords int"


def source_index(sources: DataFrame) -> DataFrame:
    """What matching needs of each source: its words, compound runs and keywords.

    Write this out once and pass it on where several operators match against the same sources.
    """
    return sources.select(
        *_REF,
        word_set(F.col("text")).alias("words"),
        glued_set(F.col("text")).alias("glued"),
        lowered_keyword_set(F.col("text")).alias("keywords"),
    )


def _indexed(sources: DataFrame) -> DataFrame:
    """The index as given, or a new one."""
    return sources if "words" in sources.columns else stored_index(sources)[0]


def stored_index(sources: DataFrame) -> tuple[DataFrame, str]:
    """The index, stored packed as counts and matching read it, and its folder."""
    path = fresh_path(sources.sparkSession, "source-index")
    source_index(spread(sources)).write.option("compression", "zstd").parquet(path)
    return sources.sparkSession.read.parquet(path), path


def asked_index(sources: DataFrame, asked: pa.Table) -> DataFrame:
    """(tenant_id, source, ref, terms, keywords) of the `asked` (keyword, hash) only.

    `terms` are hashes of those the source mentions, `keywords` those that are its own keywords.
    """
    sources.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", _BATCH_BYTES)
    texts = spread(sources).select(*_REF, "text")
    schema = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in _REF) + ", terms array<bigint>, keywords array<string>"

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = dict(zip(asked.column("keyword").to_pylist(), asked.column("hash").to_pylist()))
        find = _finder(hashed)
        for batch in batches:
            found = [find(text or "") for text in batch.column("text").to_pylist()]
            terms = pa.array([[hashed[k] for k in mentioned] for mentioned, _ in found], pa.list_(pa.int64()))
            keywords = pa.array([list(own) for _, own in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _REF), terms, keywords], names=[*_REF, "terms", "keywords"])

    return texts.mapInArrow(look_up, schema)


def _finder(asked: Iterable[str]) -> Callable[[str], tuple[set, set]]:
    """A function from a text to the asked keywords it mentions and those that are its own.

    A run of letters is a word and a keyword; others, which are few, are taken apart.
    """
    asked, compound = frozenset(asked), defaultdict(list)
    plain = frozenset(k for k in asked if k.isalpha())
    for keyword in asked - plain:
        tail = r"(?=\w)" if keyword[-1] in "'-" else r"(?!\w)"
        compound[re.match("[a-z]+", keyword)[0]].append((keyword, re.compile(rf"(?<!\w){re.escape(keyword)}{tail}")))

    def find(text: str) -> tuple[set, set]:
        runs = set(_RUN.findall(text.lower()))
        mentioned = set(plain & runs)
        own = set(mentioned)
        for run in [x for x in runs if not (x.isascii() and x.isalpha())]:
            own.update(asked.intersection(_KEYWORD.findall(run)))
            if "'" in run or "-" in run:
                words = set(_WORD.findall(run))
                mentioned |= plain & words
                mentioned.update(k for w in words for k, pattern in compound.get(w, ()) if pattern.search(run))
        if "\u0130" in text or "\u212a" in text:  # no ASCII letters, but lower-cased they are
            own = {k for k in map(str.lower, _KEYWORD.findall(text)) if k in asked}
        return mentioned, own

    return find


def _asked(claims: DataFrame) -> pa.Table | None:
    """(keyword, hash) of the claims' keywords where these are few."""
    words = claims.select(F.explode(prose_keywords(F.col("text"))).alias("keyword")).distinct()
    found = words.select("keyword", F.xxhash64("keyword").alias("hash")).limit(_FEW_KEYWORDS + 1).toArrow()
    return found if 0 < len(found) <= _FEW_KEYWORDS else None


def term_counts(sources: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(tenant_id, term, doc_count, n_sources) over the keywords of each tenant's sources.

    With `index`, over the keywords that this has of the sources.
    """
    if index is None:
        index = sources = _indexed(sources)
    totals = sources.groupBy("tenant_id").agg(F.count("*").alias("n_sources"))
    counts = (
        index.select("tenant_id", each(F.col("keywords")).alias("term"))
        .filter("term IS NOT NULL")
        .groupBy("tenant_id", "term")
        .agg(F.count("*").alias("doc_count"))
    )
    return counts.join(totals, "tenant_id")


def _is_common(threshold: float):
    return (F.col("n_sources") >= MIN_SOURCES_FOR_COMMON_FILTER) & (
        F.col("doc_count") / F.col("n_sources") > threshold
    )


def common_terms(sources: DataFrame, threshold: float = COMMON_TERM_THRESHOLD) -> DataFrame:
    """Terms too frequent among a tenant's sources to tell them apart."""
    return term_counts(sources).filter(_is_common(threshold))


def claim_keywords(claims: DataFrame, counts: DataFrame | None) -> DataFrame:
    """(tenant_id, claim_id, keywords, n_keywords, needed) of claims with keywords enough.

    `counts` are those of the common terms, which do not count. Terms of more than a share of the sources are few, so a
    tenant's are one array. The arrays of keywords hold the words of one claim each, so they are bounded by its text.
    """
    words = claims.select("tenant_id", "claim_id", prose_keywords(F.col("text")).alias("keywords"))
    if counts is not None:
        common = counts.groupBy("tenant_id").agg(F.collect_list("term").alias("common"))
        words = words.join(small(settle(common)), "tenant_id", "left").select(
            "tenant_id", "claim_id",
            F.when(F.col("common").isNull(), F.col("keywords"))
            .otherwise(F.filter("keywords", lambda w: ~F.array_contains("common", w))).alias("keywords"),
        )
    n = F.size("keywords")
    return words.select(
        "tenant_id",
        "claim_id",
        "keywords",
        n.alias("n_keywords"),
        F.greatest(F.lit(2), F.bround(n * F.lit(MIN_MATCH_RATIO)).cast("int")).alias("needed"),
    ).filter("n_keywords >= needed")


def _sides(claims: DataFrame, sources: DataFrame, threshold: float | None) -> tuple[DataFrame, DataFrame, str]:
    """Claims and sources with the hashes of their words, as `meet` takes them, read from stored files; the claims' folder."""
    spark = claims.sparkSession
    asked = None if "words" in sources.columns else _asked(claims)
    if asked is None:
        index = sources = _indexed(sources)
    else:
        path = fresh_path(spark, "asked-words")
        asked_index(sources, asked).write.option("compression", "zstd").parquet(path)
        index = spark.read.parquet(path)
    counts = None if threshold is None else settle(term_counts(sources, index).filter(_is_common(threshold)))
    release(spark)
    path = fresh_path(spark, "claim-words")
    keywords = F.col("keywords")
    claim_keywords(claims, counts).select(
        "tenant_id", F.col("claim_id").alias("query"), F.array_sort(hashes(keywords)).alias("terms"),
        F.filter(keywords, is_compound).alias("compound"), F.col("n_keywords").alias("n_terms"), "needed",
    ).write.option("compression", "zstd").parquet(path)
    stored = spark.read.parquet(path)
    if asked is not None:
        return stored.drop("compound"), index.select(*_REF, "terms", F.size("terms").alias("n_terms")).filter("n_terms > 0"), path
    compound = compound_terms(stored.select("tenant_id", F.explode("compound").alias("keyword")), index.select(*_REF, "glued"), _REF)
    rows = index.select(*_REF, hashes(F.col("words")).alias("terms"), F.size("words").alias("n_terms"))
    return stored.drop("compound"), rows.unionByName(compound.withColumn("n_terms", F.size("terms"))), path


def _mentions(queries: pa.Table, rows: pa.Table, once: bool) -> pa.Table:
    code, first = codes(rows, ["source", "ref"])
    row, word = flat(rows.column("terms"))
    query, term = flat(queries.column("terms"))
    needed = queries.column("needed").to_numpy()
    found = list(hits(query, term, needed, code[row], word, once))
    q, r, n = (np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int64) for k in range(3))
    sources, claims = rows.select(["source", "ref"]).take(first[r]), queries.select(["tenant_id", "query", "n_terms"]).take(q)
    return pa.table({
        "tenant_id": claims.column("tenant_id"), "claim_id": claims.column("query"), "source": sources.column("source"),
        "ref": sources.column("ref"), "n_matched": n.astype(np.int32), "n_keywords": claims.column("n_terms"),
    })


def keyword_matches(
    claims: DataFrame, sources: DataFrame, threshold: float | None = COMMON_TERM_THRESHOLD, block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """(tenant_id, claim_id, source, ref, n_matched, n_keywords): every source clearing the bar."""
    queries, rows, _ = _sides(claims, sources, threshold)
    return meet(queries, rows, _REF, lambda q, r: [_mentions(q, r, False)], _MATCH, block_terms)


def matched_claims(
    claims: DataFrame, sources: DataFrame, threshold: float | None = COMMON_TERM_THRESHOLD, block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """(tenant_id, claim_id) of the claims that any source matches, without all the pairs.

    Long sources match most claims, so each tenant's longest are tried first; only claims not found there meet all sources.
    What the search stores and shuffles is deleted before the result is given.
    """
    spark = claims.sparkSession
    index, own = (sources, None) if "words" in sources.columns else stored_index(sources)
    queries, rows, path = _sides(claims, index, threshold)

    def found(some, among):
        pairs = meet(some, among, _REF, lambda q, r: [_mentions(q, r, True)], _MATCH, block_terms)
        return settle(pairs.select("tenant_id", F.col("claim_id").alias("query")).distinct())

    long = rows.groupBy("tenant_id").agg(F.percentile_approx("n_terms", 0.99).alias("long"))
    first = found(queries, rows.join(small(settle(long)), "tenant_id").filter("n_terms >= long").drop("long"))
    release(spark)
    rest = found(queries.join(first, ["tenant_id", "query"], "left_anti"), rows)
    release(spark)
    for folder in (path, own):
        if folder:
            discard(spark, folder)
    return first.unionByName(rest).withColumnRenamed("query", "claim_id")


def unmatched(claims: DataFrame, matches: DataFrame) -> DataFrame:
    """Claims no source was found for."""
    return claims.join(matches.select("tenant_id", "claim_id").distinct(), ["tenant_id", "claim_id"], "left_anti")


def citation_stats(claims: DataFrame, by_keyword: DataFrame, by_judge: DataFrame | None = None) -> DataFrame:
    """(tenant_id, cited_keyword, cited_llm, uncited) numbers of claims."""
    keys = ["tenant_id", "claim_id"]
    rated = claims.select(*keys).join(
        by_keyword.select(*keys).distinct().withColumn("kw", F.lit(True)), keys, "left"
    )
    if by_judge is None:
        rated = rated.withColumn("judged", F.lit(False))
    else:
        rated = rated.join(by_judge.select(*keys).distinct().withColumn("judged", F.lit(True)), keys, "left")
    kw, judged = F.coalesce("kw", F.lit(False)), F.coalesce("judged", F.lit(False))
    return rated.groupBy("tenant_id").agg(
        F.count_if(kw).alias("cited_keyword"),
        F.count_if(~kw & judged).alias("cited_llm"),
        F.count_if(~kw & ~judged).alias("uncited"),
    )
