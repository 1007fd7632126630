"""Briefs: assembling, citing and reading them back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksignal.functions.constants import (
    BRIEF_TITLE,
    DISPATCH_HEADER,
    MATTERS_HEADER,
    MISSED_HEADER,
    UNDRAFTED_LINE,
)
from worksignal.functions.text import citable, let, not_blank, strip
from worksignal.operators.ordered import fold_lines, ordinal, range_buckets
from worksignal.session import settle

_SOURCE_ORDER = ("email", "calendar", "notes", "task")


def brief_lines(synthesis: DataFrame, dispatches: DataFrame, fresh: DataFrame) -> DataFrame:
    """(tenant_id, part, place, line) of each tenant's brief.

    synthesis: one row per tenant; dispatches: items with `ordinal` and `draft_text`; fresh: see
    `freshness`.
    """
    tenants = synthesis.select("tenant_id")

    def rows(df, part, place, line):
        return df.select("tenant_id", F.lit(part).alias("part"), place.cast("bigint").alias("place"), line.alias("line"))

    def said(part, text):
        return rows(synthesis, part, F.lit(0), text)

    stale = fresh.filter("is_stale").join(tenants, "tenant_id", "left_semi")
    warned = stale.select("tenant_id").distinct()
    order = F.array_position(F.array(*[F.lit(s) for s in _SOURCE_ORDER]), F.col("source"))
    notice = F.when(
        F.col("most_recent_day").isNull(), F.concat(F.lit("> - "), F.col("source"), F.lit(": no data available at all."))
    ).otherwise(F.concat(
        F.lit("> - "), F.col("source"), F.lit(": most recent data is from "), F.col("most_recent_day"),
        F.lit(" ("), F.col("days_stale").cast("string"), F.lit(" days ago)."),
    ))
    dispatching = dispatches.select("tenant_id").distinct().join(tenants, "tenant_id", "left_semi")
    drafted = F.coalesce(F.concat(F.lit("> "), F.col("draft_text")), F.lit(UNDRAFTED_LINE))
    item = F.concat(
        F.lit("**"), F.coalesce("summary", "id"), F.lit("**\n"), drafted, F.lit("\n")
    )
    parts = [
        said(0, F.lit(BRIEF_TITLE + "\n")),
        rows(warned, 1, F.lit(0), F.lit("> ⚠️ **Data freshness notice**")),
        rows(stale, 2, order, notice),
        rows(warned, 3, F.lit(0), F.lit("")),
        said(4, F.lit(f"## {MATTERS_HEADER}\n")),
        said(5, strip(F.coalesce("what_matters_today", F.lit("")))),
        said(6, F.lit("")),
        said(7, F.lit(f"## {MISSED_HEADER}\n")),
        said(8, strip(F.coalesce("what_might_be_missed", F.lit("")))),
        said(9, F.lit("")),
        rows(dispatching, 10, F.lit(0), F.lit(f"## {DISPATCH_HEADER}\n")),
        rows(dispatches.join(tenants, "tenant_id", "left_semi"), 11, F.col("ordinal"), item),
    ]
    return reduce(DataFrame.unionByName, parts)


def assemble_briefs(synthesis: DataFrame, dispatches: DataFrame, fresh: DataFrame) -> DataFrame:
    """(tenant_id, brief)."""
    lines = brief_lines(synthesis, dispatches, fresh)
    bucket = F.struct("part", F.floor(F.col("place") / 5000).alias("run"))
    ordered = ordinal(lines, ["tenant_id"], bucket, [F.col("part"), F.col("place"), F.col("line")])
    return fold_lines(ordered, ["tenant_id"], name="brief")


def numbered_lines(texts: DataFrame, keys: list[str], column: str = "brief") -> DataFrame:
    """(keys, line_no, line): lines of each text, blank ones included."""
    return texts.select(*keys, F.posexplode(F.split(column, "\n", -1)).alias("line_no", "line"))


def claim_lines(lines: DataFrame) -> DataFrame:
    """Every line making a claim, repeats kept: (tenant_id, claim_id, text), the text being the id."""
    body = strip(F.col("line"))
    return lines.filter(citable(F.col("line"), UNDRAFTED_LINE)).select(
        "tenant_id", body.alias("claim_id"), body.alias("text")
    )


def claims_of(lines: DataFrame) -> DataFrame:
    """Each distinct claim once."""
    return claim_lines(lines).distinct()


def _source_place(source: Column) -> Column:
    place = F.array_position(F.array(*[F.lit(s) for s in _SOURCE_ORDER]), source)
    return F.when(place > 0, place).otherwise(F.lit(len(_SOURCE_ORDER) + 1))


def ranked_refs(matches: DataFrame) -> DataFrame:
    """Matches with `match_rank` per claim: best first, then by kind of source and ref.

    Ranking reads the matches twice, to sample their ranges and to deal them out; they are settled, so that matching runs once.
    """
    placed = matches.withColumn("__place", _source_place(F.col("source")))
    placed = placed.withColumn("__worse", -F.col("n_matched"))
    ranged = range_buckets(settle(placed), ["tenant_id", "claim_id", "__worse", "__place", "ref"])
    order = [F.col("__worse"), F.col("__place"), F.col("ref")]
    ranked = ordinal(ranged, ["tenant_id", "claim_id"], F.col("range_bucket"), order, "match_rank")
    return ranked.drop("__place", "__worse", "range_bucket")


def citation_tags(matches: DataFrame, inferred: bool = False) -> DataFrame:
    """(tenant_id, claim_id, tag): the citation text of each claim."""
    tail = " (inferred)]_" if inferred else "]_"
    refs = ranked_refs(matches).withColumn("line", F.concat_ws(": ", "source", "ref"))
    folded = fold_lines(refs, ["tenant_id", "claim_id"], "match_rank", "line", ", ", "refs")
    return folded.select(
        "tenant_id", "claim_id", F.concat(F.lit(" _[source: "), F.col("refs"), F.lit(tail)).alias("tag")
    )


def annotate_lines(lines: DataFrame, tags: DataFrame) -> DataFrame:
    """Lines with their claim's tag appended."""
    keyed = lines.withColumn("claim_id", F.when(citable(F.col("line"), UNDRAFTED_LINE), strip(F.col("line"))))
    tagged = keyed.join(tags, ["tenant_id", "claim_id"], "left")
    text = F.concat("line", F.coalesce("tag", F.lit("")))
    return tagged.select(*[c for c in lines.columns if c != "line"], text.alias("line"))


def cited_briefs(annotated: DataFrame, keys: list[str]) -> DataFrame:
    """The annotated lines of each brief joined back. Lines came from one text and return to one."""
    return fold_lines(annotated.withColumn("line_no", F.col("line_no") + 1), keys, "line_no", name="brief")


def item_citations(items: DataFrame, matches: DataFrame) -> DataFrame:
    """Structured items with `source_refs`, best first."""
    arrays = ranked_refs(matches).groupBy("tenant_id", "claim_id").agg(
        F.array_sort(F.collect_list(F.struct("match_rank", F.concat_ws(":", "source", "ref").alias("r")))).alias("rs")
    )
    joined = items.join(arrays, ["tenant_id", "claim_id"], "left")
    none = F.array().cast("array<string>")
    return joined.select(
        *items.columns,
        F.coalesce(F.transform("rs", lambda x: x["r"]), none).alias("source_refs"),
    )


# --- reading a finished brief ---


def section_text(brief: Column, header: str) -> Column:
    """Stripped body of a `## header` section, empty where there is none."""
    parts = F.split(brief, "(?m)^(?=## )")
    found = F.filter(parts, lambda p: strip(F.split(p, "\n", 2)[0]) == f"## {header}")
    body = F.get(F.split(F.get(found, F.lit(0)), "\n", 2), F.lit(1))
    return F.coalesce(strip(body), F.lit(""))


def freshness_notice(brief: Column) -> Column:
    lead = F.split(brief, "(?m)^(?=## )")[0]
    body = strip(F.regexp_replace(lead, f"^\\s*{BRIEF_TITLE}", ""))
    return F.when(body.startswith(">"), body).otherwise(F.lit(""))


_TAG = " _[source: "
_KIND = "\\s\\((embedding-matched|inferred)\\)$"


def _tag_start(line: Column) -> Column:
    """1-based position of a line's closing citation tag, 0 where it has none."""
    parts = F.split(line, " _\\[source: ")
    before = F.length(line) - F.length(F.element_at(parts, -1)) - len(_TAG) + 1
    return F.when((F.size(parts) > 1) & line.endswith("]_"), before).otherwise(F.lit(0))


def line_text(line: Column) -> Column:
    return let(_tag_start(line), lambda start: F.when(start > 0, F.substring(line, F.lit(1), start - 1)).otherwise(line))


def line_citations(line: Column) -> Column:
    """Citations of one line: array of (source, ref, matched_via)."""
    def pairs_of(refs, via):
        pairs = F.filter(F.split(refs, ", "), lambda p: p.contains(": "))
        return F.transform(
            pairs,
            lambda p: F.struct(
                F.substring_index(p, ": ", 1).alias("source"), F.regexp_replace(p, "^.*?: ", "").alias("ref"), via.alias("matched_via")
            ),
        )

    def read(blob):
        kind = F.regexp_extract(F.right(blob, F.lit(24)), _KIND, 1)
        via = F.when(kind == "inferred", F.lit("llm")).when(kind == "embedding-matched", F.lit("embedding")).otherwise(F.lit("keyword"))
        refs = F.when(kind != "", F.substring(blob, F.lit(1), F.length(blob) - F.length(kind) - 3)).otherwise(blob)
        return let(F.struct(refs.alias("refs"), via.alias("via")), lambda x: pairs_of(x["refs"], x["via"]))

    inside = let(_tag_start(line), lambda start: F.when(
        start > 0, F.substring(line, start + len(_TAG), F.length(line) - start - len(_TAG) - 1)
    ).otherwise(F.lit("")))
    return let(inside, read)


def brief_bullets(briefs: DataFrame, header: str) -> DataFrame:
    """(tenant_id, bullet_no, text, citations) of one section."""
    lines = F.filter(F.transform(F.split(section_text(F.col("brief"), header), "\n"), strip), lambda x: x != "")
    return briefs.select("tenant_id", F.posexplode(lines).alias("bullet_no", "line")).select(
        "tenant_id", "bullet_no", line_text(F.col("line")).alias("text"), line_citations(F.col("line")).alias("citations")
    )


def labelled_citations(bullets: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per citation with its source's label, else its ref."""
    labels = sources.select("tenant_id", "source", "ref", "label").dropDuplicates(["tenant_id", "source", "ref"])
    flat = bullets.select("tenant_id", "bullet_no", "text", F.explode("citations").alias("c")).select(
        "tenant_id", "bullet_no", "text", "c.*"
    )
    return flat.join(labels, ["tenant_id", "source", "ref"], "left").withColumn("label", F.coalesce("label", "ref"))


_DISPATCH = "(?s)\\*\\*(.+?)\\*\\*(.*?)\\n(.*?)(?=\\n\\*\\*|\\z)"


def brief_drafts(briefs: DataFrame) -> DataFrame:
    """(tenant_id, draft_no, summary, drafted, draft_text, citations) of the dispatch section."""
    section = section_text(F.col("brief"), DISPATCH_HEADER)

    def group(n):
        return F.regexp_extract_all(section, F.lit(_DISPATCH), F.lit(n))

    zipped = F.arrays_zip(group(1).alias("summary"), group(2).alias("suffix"), group(3).alias("body"))
    rows = briefs.select("tenant_id", F.posexplode(zipped).alias("draft_no", "d")).select("tenant_id", "draft_no", "d.*")
    body = strip(F.col("body"))
    quoted = F.array_join(
        F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, "^[> ]+", ""), "\\s+$", "")), "\n"
    )
    drafted = body.startswith(">")
    return rows.select(
        "tenant_id",
        "draft_no",
        strip(F.col("summary")).alias("summary"),
        drafted.alias("drafted"),
        F.when(drafted, quoted).otherwise(F.lit("")).alias("draft_text"),
        line_citations(F.concat(F.lit("x "), strip(F.col("suffix")))).alias("citations"),
    )
