"""Mixing sources to target weights by capped water-filling.

A source's target is its weight's share of all words to take; one whose share exceeds its maximum
of epochs stops there, and the rest is shared anew by weight until none is above. Then whole
repetitions take every document alike, and a seeded draw decides which ones a last, partial
repetition takes. Only DataFrame functions; the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worksignal.llm.names import set_aside
from worksignal.llm.words import WORD
from worksignal.session import settle

SEED = 17
#: The sources' rows are broadcast up to so many: some 10 MB. Above, documents and sources are joined by shuffling.
MAX_BROADCAST_SOURCES = 100_000
_DIGITS, _LEVELS = 3, 4  # hexadecimal digits of the draw that a round settles, and rounds


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, text: Column, seed: int) -> Column:
    """Leading digits of a digest: the seeded order of a source's documents."""
    parts = F.concat_ws("|", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.substring(F.md5(parts.cast("binary")), 1, _DIGITS * _LEVELS)


def cyclic_weights(sources: DataFrame, weights: list[float]) -> DataFrame:
    """(source, ...): adds `weight`, repeating the list over the sources by code point, NULL last.

    Ranks come from range partitions and their counts, so no task holds all sources.
    """
    spread = settle(
        sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    )
    counts = spread.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    place = (F.col("offset") + F.col("inside") - 1) % len(weights)
    ranked = spread.withColumn("inside", inside).join(offsets, "part")
    listed = F.array(*[F.lit(float(w)) for w in weights])
    return ranked.withColumn("weight", F.get(listed, place.cast("int"))).drop("part", "inside", "offset")


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """Adds `target` to (source_size, weight): shares of `total` by weight, none above max_epochs * source_size.

    The level (words per unit of weight) only rises from round to round, and a source is clamped
    once its share passes its cap, so the rounds end when the level stays. Sources without words
    get 0; a total above all caps together gives every source its cap.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, previous = 0.0, None
    while level != previous:
        above = F.col("weight") * F.lit(level) > cap
        row = sources.agg(
            F.sum(F.when(above, cap)).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("weight")
        ).first()
        previous = level
        if row["weight"]:
            level = (total - (row["held"] or 0.0)) / row["weight"]
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def _cuts(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds to each source the draw up to which its documents are in the partial repetition.

    Digit by digit, as in a radix sort: the words of each group of equal leading digits are summed,
    and only the group in which the words run out is looked at more closely. No window holds more
    rows than there are digits, whatever the source's size.
    """
    state = sources.withColumn("cut", F.lit("")).withColumn("left", F.col("extra"))
    for level in range(1, _LEVELS + 1):
        open_ = state.filter("extra > 0").select(F.col("source").alias("s"), "cut", "left")
        groups = (
            docs.join(open_, F.col("source").eqNullSafe(F.col("s")))
            .filter(F.col("draw").startswith(F.col("cut")))
            .groupBy("s", "left", F.substring("draw", 1, _DIGITS * level).alias("head"))
            .agg(F.sum("size").alias("words"))
        )
        order = Window.partitionBy("s").orderBy("head")
        found = (
            groups.withColumn("before", F.sum("words").over(order) - F.col("words"))
            .filter((F.col("before") <= F.col("left")) & (F.col("before") + F.col("words") > F.col("left")))
            .select("s", F.col("head").alias("new_cut"), (F.col("left") - F.col("before")).alias("new_left"), "words")
        )
        state = (
            state.drop("cut_words")
            .join(found, F.col("source").eqNullSafe(F.col("s")), "left")
            .withColumn("cut", F.coalesce("new_cut", "cut"))
            .withColumn("left", F.coalesce("new_left", "left"))
            .withColumnRenamed("words", "cut_words")
            .drop("s", "new_cut", "new_left")
        )
        state = settle(state)
    return state.withColumn("cut_in", F.coalesce(F.col("left") * 2 >= F.col("cut_words"), F.lit(False)))


def mix(
    docs: DataFrame,
    weights: list[float],
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = SEED,
) -> DataFrame:
    """Adds size, source_size, target, repeats and taken to documents (doc_id, text, source).

    `repeats` says how often the mix takes a document, `taken` how many words that is. A source's
    taken words miss its target by half a document at most, unless max_epochs is no whole number.
    Extra columns stay; columns of the added names are replaced. A NULL text has no words; a NULL
    source is a source. Rows alike in doc_id and text share their draw, hence their fate. An empty
    table gives an empty one. The same rows and seed give the same mix, however they are split.
    """
    added = ("size", "source_size", "target", "repeats", "taken")
    docs, restored = set_aside(docs, "s", "draw", "whole", "extra", "cut", "cut_in")
    sized = docs.drop(*added).withColumn("size", n_words(F.col("text"))).withColumn(
        "draw", draw(F.col("doc_id"), F.col("text"), seed)
    )
    slim = settle(sized.select("source", "size", "draw"))
    sums = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = settle(cyclic_weights(sums, weights))
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    filled = water_fill(sources, total, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    filled = filled.withColumn("whole", whole.cast("long"))
    filled = settle(filled.withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size")))
    cuts = _cuts(slim, filled).select(
        F.col("source").alias("s"), "source_size", "target", "whole", "extra", "cut", "cut_in"
    )
    partly = (F.col("extra") > 0) & ((F.col("draw") < F.col("cut")) | ((F.col("draw") == F.col("cut")) & F.col("cut_in")))
    if filled.count() <= MAX_BROADCAST_SOURCES:
        cuts = F.broadcast(cuts)  # so documents stay where they are
    return restored(
        sized.join(cuts, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("repeats", F.col("whole") + partly.cast("long"))
        .withColumn("taken", F.col("size") * F.col("repeats"))
        .drop("s", "draw", "whole", "extra", "cut", "cut_in")
    )


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """Sources weigh 5, 2, 1 in turn and share 150 % of all words, at most 2 epochs each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs, [5.0, 2.0, 1.0], 1.5, 2.0, SEED).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


OP8_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    left(md5(concat_ws('|', '{SEED}', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))), {_DIGITS * _LEVELS}) AS draw
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
    2.0::DOUBLE * source_size AS cap, (SELECT sum(size)::DOUBLE * 1.5::DOUBLE FROM d) AS total FROM s),
f AS (
  SELECT *, coalesce(sum(cap) OVER w, 0) AS held, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS rest
  FROM r WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((total - held) / rest) FILTER (WHERE (total - held) / rest * weight <= cap) AS level FROM f),
t AS (SELECT source, source_size, least(cap, weight * (SELECT level FROM l)) AS target FROM r),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
x AS (SELECT *, target - whole * source_size AS extra FROM e),
g AS (SELECT source, draw, sum(size) AS words FROM d GROUP BY source, draw),
c AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY draw) - words AS before FROM g)
SELECT d.doc_id, d.size, x.source_size, x.target,
  (d.size * (x.whole + CASE WHEN x.extra > 0 AND c.before + c.words / 2.0 <= x.extra THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source
  JOIN c ON c.source IS NOT DISTINCT FROM d.source AND c.draw = d.draw
"""
