"""Ordered work inside groups of any size.

A plain window puts a whole group into one task. Here a group is cut into buckets that follow
its order (an hour, a run of ids); each bucket is handled on its own, and what a bucket needs
from its predecessors comes from one summary row per bucket. A group holding a third of all rows
is thus spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worksignal.session import settle

_BUCKET = "__bucket"


def _join_summary(rows: DataFrame, summary: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    renamed = summary.select(*[F.col(c).alias(f"__{c}") for c in columns], *keep)
    condition = F.lit(True)
    for name in columns:
        condition = condition & F.col(name).eqNullSafe(F.col(f"__{name}"))
    return rows.join(renamed, condition, "left").drop(*[f"__{c}" for c in columns])


def running_sum(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: Column, name: str
) -> DataFrame:
    """Running sum of `value` within `keys` up to and including each row.

    `bucket` must rise with `order`, and `order` must not tie where the result should be stable.
    """
    rows = df.withColumn(_BUCKET, bucket).withColumn("__value", value)
    parts = [*keys, _BUCKET]
    totals = rows.groupBy(*parts).agg(F.sum("__value").alias("__total"))
    before = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__offset", F.coalesce(F.sum("__total").over(before), F.lit(0)))
    local = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = _join_summary(
        rows.withColumn("__local", F.sum("__value").over(local)), offsets, parts, ["__offset"]
    )
    return summed.withColumn(name, F.col("__local") + F.col("__offset")).drop(
        _BUCKET, "__value", "__local", "__offset"
    )


def ordinal(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str = "ordinal") -> DataFrame:
    """1-based position of each row within `keys`."""
    return running_sum(df, keys, bucket, order, F.lit(1), name).withColumn(name, F.col(name).cast("bigint"))


def range_buckets(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds `range_bucket`, which rises with the columns and holds about as many rows in each bucket.

    For orders without a natural bucket, such as texts with a common prefix. Where the ranges lie is
    sampled, so the rows are settled.
    """
    ranged = df.repartitionByRange(*columns).withColumn("range_bucket", F.spark_partition_id())
    return settle(ranged)


def next_value(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: str, name: str
) -> DataFrame:
    """`value` of the following row within `keys`, `value` being the leading order column."""
    rows = df.withColumn(_BUCKET, bucket)
    parts = [*keys, _BUCKET]
    firsts = rows.groupBy(*parts).agg(F.min(value).alias("__first"))
    following = firsts.withColumn(
        "__next", F.lead("__first").over(Window.partitionBy(*keys).orderBy(_BUCKET))
    )
    local = Window.partitionBy(*parts).orderBy(*order)
    found = _join_summary(
        rows.withColumn("__local", F.lead(value).over(local)), following, parts, ["__next"]
    )
    return found.withColumn(name, F.coalesce("__local", "__next")).drop(_BUCKET, "__local", "__next")


def fold_lines(
    lines: DataFrame,
    keys: list[str],
    position: str = "ordinal",
    line: str = "line",
    separator: str = "\n",
    name: str = "text",
    run: int = 5000,
) -> DataFrame:
    """Join ordered lines into one text for each group: (keys, text).

    Runs of `run` lines are joined first, each on its own, and then the few texts of the runs, so
    only the finished text of a group is ever in one row. How long a run is changes nothing.
    """
    runs = fold_runs(lines, keys, run, position, line, separator)
    return _joined(runs, keys, F.col("run"), F.col("text"), separator, name)


def fold_ordered(
    lines: DataFrame, keys: list[str], bucket: Column, order: list[Column], line: str = "line", separator: str = "\n", run: int = 5000
) -> DataFrame:
    """Join lines into one text for each group: (keys, text), in the order of their bucket and within it of `order`.

    As `fold_lines` of the `ordinal`, for lines whose number itself is not wanted: they are counted in their bucket only, so
    they are computed and shuffled once.
    """
    local = Window.partitionBy(*keys, _BUCKET).orderBy(*order)
    placed = lines.withColumn(_BUCKET, bucket).withColumn("place", F.row_number().over(local))
    cut = placed.withColumn("run", F.floor((F.col("place") - 1) / run))
    runs = _joined(cut, [*keys, _BUCKET, "run"], F.col("place"), F.col(line), separator, "text")
    return _joined(runs, keys, F.struct(_BUCKET, "run"), F.col("text"), separator, "text")


def fold_runs(
    lines: DataFrame, keys: list[str], run: int, position: str = "ordinal", line: str = "line", separator: str = "\n"
) -> DataFrame:
    """Join each `run` ordered lines into one text: (keys, run, text), runs counted from 0."""
    cut = lines.withColumn("run", F.floor((F.col(position) - 1) / run))
    return _joined(cut, [*keys, "run"], F.col(position), F.col(line), separator, "text")


def _joined(rows: DataFrame, by: list[str], place: Column, text: Column, separator: str, out: str) -> DataFrame:
    gathered = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), text.alias("l")))).alias("ls"))
    return gathered.select(*by, F.array_join(F.transform("ls", lambda x: x["l"]), separator).alias(out))
