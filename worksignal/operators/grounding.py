"""Checking model output against what the tables actually hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksignal.functions.keywords import prose_keywords, title_keywords
from worksignal.functions.text import WORD, identifiers, not_blank, strip
from worksignal.operators.blocks import small
from worksignal.session import settle


_FEW_HEADS = 10_000
_OFTEN = 100_000  # titles that share a word


def _begins(df: DataFrame, word: str, known: DataFrame, column: str, out: str) -> DataFrame:
    """Each row once for every beginning of its `word` that may be a value of `known`'s `column` for its tenant.

    These are the beginnings as long as one of the values; a word whose first characters, as many as the shortest
    value has, begin none of the values has no row. So beginnings that many words share stay out unless they are looked for.
    """
    lengths = known.filter(F.length(column) > 0).groupBy("tenant_id").agg(F.array_sort(F.collect_set(F.length(column))).alias("lengths"))
    lengths = small(settle(lengths))
    head = F.substring(F.col(word), F.lit(1), F.col("lengths")[0])
    sized = df.join(lengths, "tenant_id").filter(F.length(word) >= F.col("lengths")[0]).withColumn("head", head)
    heads = settle(known.join(lengths, "tenant_id").select("tenant_id", F.substring(F.col(column), F.lit(1), F.col("lengths")[0]).alias("head")).distinct())
    if heads.limit(_FEW_HEADS + 1).count() <= _FEW_HEADS:
        sized = sized.join(F.broadcast(heads), ["tenant_id", "head"], "left_semi")
    sized = sized.withColumn("n", F.explode(F.filter("lengths", lambda n: n <= F.length(word))))
    return sized.withColumn(out, F.substring(F.col(word), F.lit(1), F.col("n"))).drop("n", "lengths", "head")


def title_anchors(titles: DataFrame, often: int = _OFTEN) -> tuple[DataFrame, DataFrame]:
    """(anchored, single) of (tenant_id, low_title, task_id).

    A text that contains a title of several words has each of them but the first at a word's
    beginning. `anchored` adds the rarest of these as `anchor`; `single` are titles of one word. Words of more than
    `often` titles are few and so broadcast: their titles are not brought together.
    """
    words = F.filter(F.slice(F.split("low_title", " "), 2, 1 << 30), lambda w: w != "")
    split = titles.withColumn("words", F.array_distinct(words))
    each = split.filter(F.size("words") > 0).select("tenant_id", "low_title", "task_id", F.explode("words").alias("anchor"))
    counts = settle(each.groupBy("tenant_id", "anchor").agg(F.count("*").alias("n")))
    frequent = F.broadcast(counts.filter(F.col("n") > often))
    rest = each.join(frequent, ["tenant_id", "anchor"], "left_anti").join(counts.filter(F.col("n") <= often), ["tenant_id", "anchor"])
    rarest = F.min(F.struct("n", "anchor")).alias("best")
    anchored = rest.unionByName(each.join(frequent, ["tenant_id", "anchor"])).groupBy("tenant_id", "low_title", "task_id").agg(rarest)
    return anchored.select("tenant_id", "low_title", "task_id", "best.anchor"), split.filter(F.size("words") == 0).drop("words")


def _longest(df: DataFrame, column: str) -> DataFrame:
    return small(settle(df.groupBy("tenant_id").agg(F.max(F.length(column)).alias("longest"))))


def resolve_entities(claims: DataFrame, tasks: DataFrame) -> DataFrame:
    """(tenant_id, claim_id, task_id): the task each claim's `entity` refers to.

    An exact id wins. Otherwise the first task, by id, whose title equals the entity, whose id
    the entity starts with, or whose title the entity contains. Each rule is an equality join: on
    the id, on beginnings of the entity, on beginnings of its words (by a title's rarest word, the title is
    then looked for), and for titles of one word on parts of its words. Rows grow with the entity's
    length, and no array holds its parts.
    """
    keys = ["tenant_id", "claim_id"]
    said = claims.select(*keys, "entity", F.lower(strip(F.col("entity"))).alias("e"))
    known = settle(tasks.select(
        "tenant_id", "task_id", F.lower("task_id").alias("low_id"),
        F.lower(strip(F.coalesce("title", F.lit("")))).alias("low_title"),
    ))
    exact = said.join(known, (said.tenant_id == known.tenant_id) & (said.entity == known.task_id)).select(
        said.tenant_id, "claim_id", "task_id", F.lit(0).alias("rule")
    )
    ids = known.groupBy("tenant_id", "low_id").agg(F.min("task_id").alias("task_id"))
    by_prefix = _begins(said, "e", known, "low_id", "low_id").join(ids, ["tenant_id", "low_id"])
    titles = known.filter("low_title <> ''").groupBy("tenant_id", "low_title").agg(F.min("task_id").alias("task_id"))
    anchored, single = title_anchors(titles)
    anchored = settle(anchored)
    words = said.select(*keys, "e", F.explode(F.array_distinct(F.split("e", " "))).alias("word"))
    begun = _begins(words, "word", anchored, "anchor", "anchor")
    by_words = begun.join(anchored, ["tenant_id", "anchor"]).filter(F.contains("e", "low_title"))
    # A title of one word may be any part of a word: its beginnings from each place on.
    single = settle(single)
    ends = words.join(_longest(single, "low_title"), "tenant_id")
    ends = ends.withColumn("from", F.explode(F.sequence(F.lit(1), F.greatest(F.length("word"), F.lit(1)))))
    tails = ends.select(*keys, F.substring(F.col("word"), F.col("from"), F.col("longest")).alias("tail")).distinct()
    by_part = _begins(tails, "tail", single, "low_title", "low_title").join(single, ["tenant_id", "low_title"])
    rest = [df.select(*keys, "task_id", F.lit(1).alias("rule")) for df in (by_prefix, by_words, by_part)]
    return exact.unionByName(rest[0]).unionByName(rest[1]).unionByName(rest[2]).groupBy(*keys).agg(
        F.min_by("task_id", F.struct("rule", "task_id")).alias("task_id")
    )


def rated_contradictions(claims: DataFrame, multi_source: DataFrame) -> DataFrame:
    """Contradiction claims (tenant_id, claim_id, entity, sources, …) with their `task_id` and a `reason`, NULL where kept."""
    keys = ["tenant_id", "claim_id"]
    multi_source = settle(multi_source.select("tenant_id", "task_id", "title", "sources"))
    actual = multi_source.select("tenant_id", "task_id", F.col("sources").alias("actual_sources"))
    resolved = (
        claims.join(resolve_entities(claims, multi_source), keys, "left")
        .join(actual, ["tenant_id", "task_id"], "left")
    )
    claimed = F.coalesce("sources", F.array().cast("array<string>"))
    fine = (F.size(claimed) > 0) & (F.size(F.array_except(claimed, "actual_sources")) == 0)
    return settle(resolved.withColumn(
        "reason",
        F.when(F.col("task_id").isNull(), F.lit("unknown entity")).when(~fine, F.lit("sources not mentioned")),
    ).drop("actual_sources"))


def ground_contradictions(claims: DataFrame, multi_source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) contradiction claims (tenant_id, claim_id, entity, sources, …).

    Kept claims name a task found in several sources and only sources it was found in.
    """
    rated = rated_contradictions(claims, multi_source)
    kept = rated.filter("reason IS NULL").select(*claims.columns, "task_id")
    return kept, rated.filter("reason IS NOT NULL").select(*claims.columns, "reason")


def ground_evidence(evidence: DataFrame, claims: DataFrame, sources: DataFrame, common: DataFrame | None = None) -> DataFrame:
    """Evidence rows (tenant_id, claim_id, source_ref, quote) with `reason`, NULL where accepted.

    Checked in order: the ref exists; the quote is a part of that source's whole text; a claim
    naming `#n` needs a quote naming the same; quote and claim share an uncommon keyword.
    `sources` has one row per (tenant_id, ref); see `last_per_ref`.
    """
    keys = ["tenant_id", "claim_id"]
    known = sources.select("tenant_id", F.col("ref").alias("source_ref"), "source", F.lower("text").alias("source_text"))
    said = claims.select(*keys, prose_keywords(F.col("text")).alias("claim_words"), identifiers(F.col("text")).alias("claim_ids"))
    quoted = evidence.withColumn("quote", strip(F.coalesce("quote", F.lit(""))))
    in_source = (F.col("quote") != "") & F.contains("source_text", F.lower("quote"))
    # A text with many quotes meets each of them for this test only: it is carried no further, and a claim's words are taken once.
    found = quoted.join(known, ["tenant_id", "source_ref"], "left").select(
        *evidence.columns, "source", F.coalesce(in_source, F.lit(False)).alias("in_source")
    )
    shared = F.array_intersect(prose_keywords(F.col("quote")), "claim_words")
    rated = found.join(said, keys).withColumn("shared", shared).withColumn(
        "same_ids", (F.size("claim_ids") == 0) | F.arrays_overlap("claim_ids", identifiers(F.col("quote")))
    )
    rated = _without_common(rated, common) if common is not None else rated.withColumn("n_shared", F.size("shared"))
    reason = (
        F.when(F.col("source").isNull(), F.lit("unknown ref"))
        .when(~F.col("in_source"), F.lit("quote not in source"))
        .when(~F.col("same_ids"), F.lit("other identifier"))
        .when(F.col("n_shared") == 0, F.lit("no shared keyword"))
    )
    return rated.select(*keys, "source_ref", "source", "quote", reason.alias("reason"))


def _without_common(rated: DataFrame, common: DataFrame) -> DataFrame:
    """Count shared keywords that are not common, one row per evidence row kept."""
    ids = ["tenant_id", "claim_id", "source_ref", "quote"]
    left = (
        rated.select(*ids, F.explode(F.array_distinct("shared")).alias("term")).distinct()
        .join(common.select("tenant_id", "term"), ["tenant_id", "term"], "left_anti")
        .groupBy(*ids).agg(F.count("*").alias("n_shared"))
    )
    return rated.join(left, ids, "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0)))


def evidence_counts(grounded: DataFrame) -> DataFrame:
    """Accepted and dropped evidence per tenant and reason."""
    return grounded.groupBy("tenant_id", F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(
        F.count("*").alias("n")
    )


def last_per_ref(sources: DataFrame) -> DataFrame:
    """One source per ref: refs carry no source kind, and the later kind wins."""
    order = F.array(*[F.lit(s) for s in ("email", "calendar", "notes", "task")])
    place = F.array_position(order, F.col("source"))
    return sources.groupBy("tenant_id", "ref").agg(
        F.max_by(F.struct("source", "label", "text"), F.struct(place.alias("p"), F.col("label").alias("l"))).alias("s")
    ).select("tenant_id", "ref", "s.*")


def uncovered_tasks(synthesis: DataFrame, flagged: DataFrame, priorities=("P0", "P1")) -> DataFrame:
    """Flagged tasks of high priority that a brief leaves out.

    `synthesis`: one row per tenant with `text`. A task counts as covered when the text holds
    `min(2, number of keywords)` of its title keywords as plain substrings, repeats counted.
    """
    keywords = title_keywords(F.col("title"))
    wanted = (
        flagged.filter(F.col("priority").isin(*priorities))
        .withColumn("keywords", F.transform(keywords, lambda w: F.lower(w)))
        .filter("size(keywords) > 0")
    )
    covered = F.size(F.filter("keywords", lambda k: F.contains(F.col("low"), k)))
    texts = synthesis.select("tenant_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    return (
        wanted.join(texts, "tenant_id")
        .filter(covered < F.least(F.lit(2), F.size("keywords")))
        .select("tenant_id", F.col("id").alias("task_id"), "title", "priority")
    )


def _bounded(part: Column) -> Column:
    """Regex for a literal between word boundaries."""
    def edge(char, inside, outside):
        return F.when(char.rlike(WORD), F.lit(inside)).otherwise(F.lit(outside))

    return F.concat(
        edge(F.substring(part, 1, 1), f"(?<!{WORD})", f"(?<={WORD})"),
        F.lit("\\Q"), part, F.lit("\\E"),
        edge(F.substring(part, -1, 1), f"(?!{WORD})", f"(?={WORD})"),
    )


def protected_patterns(config: DataFrame) -> DataFrame:
    """(tenant_id, name_patterns, addresses) of each tenant's own list of contacts."""
    parts = F.flatten(F.transform(
        "never_draft_contacts", lambda c: F.split(F.lower(F.coalesce(c["name"], F.lit(""))), "\\s+")
    ))
    addresses = F.transform("never_draft_contacts", lambda c: F.lower(F.coalesce(c["email"], F.lit(""))))
    return config.select(
        "tenant_id",
        F.transform(F.array_distinct(F.filter(parts, lambda p: F.length(p) >= 3)), _bounded).alias("name_patterns"),
        F.array_distinct(F.filter(addresses, lambda a: a != "")).alias("addresses"),
    )


def draftable(items: DataFrame, config: DataFrame) -> DataFrame:
    """Items (tenant_id, …, summary, context) naming no protected contact.

    A tenant's list is one small row, so each item is tested against its own tenant's list.
    """
    text = F.lower(F.concat(F.coalesce("summary", F.lit("")), F.lit(" "), F.coalesce("context", F.lit(""))))
    rated = items.join(protected_patterns(config), "tenant_id", "left").withColumn("__text", text)
    named = F.exists("name_patterns", lambda p: F.rlike(F.col("__text"), p)) | F.exists(
        "addresses", lambda a: F.contains(F.col("__text"), a)
    )
    return rated.filter(~F.coalesce(named, F.lit(False))).select(*items.columns)


def attach_drafts(items: DataFrame, drafts: DataFrame) -> DataFrame:
    """Items with the last draft given for their id."""
    last = drafts.groupBy("tenant_id", "id").agg(F.max_by("draft_text", "ordinal").alias("draft_text"))
    return items.join(last, ["tenant_id", "id"], "left").withColumn("draft_text", not_blank(F.col("draft_text")))
