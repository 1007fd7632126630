"""URL verdicts: host and path rules first, then logistic regression on hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksignal.llm.names import set_aside
from worksignal.llm.words import mix64, powers, text_bytes

#: (verdict, rule); a rule is a host, then a path from its first slash on.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
MAX_RULES = 1000
MAX_LABELLED = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BITS, _SIZES = 16, (3, 4, 5)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for NULL and without ://."""
    found = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, ties to the lesser rule; NULL if none does.

    A rule's host fits itself and its subdomains, its path every path that begins with it.
    """
    rules = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    found = None
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def features(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature): the distinct hashed n-grams of `^host$` and of the path, each kind apart."""
    rows, found = [], []
    for salt, column in enumerate((hosts, paths)):
        data, offsets = text_bytes(column)
        lengths = np.diff(offsets)
        n = len(lengths)
        width = lengths + 2  # with a mark at either end
        begins = np.cumsum(width) - width
        values = np.full(int(width.sum()), 256, dtype=np.uint64)
        at = np.arange(int(lengths.sum())) + np.repeat(begins + 1 - (np.cumsum(lengths) - lengths), lengths)
        values[at] = data[offsets[0] : offsets[-1]]
        row = np.repeat(np.arange(n), width)
        left = np.repeat(begins + width, width) - np.arange(len(values))
        values = mix64(values + np.uint64(salt << 20))
        up, _ = powers(max(_SIZES))
        for size in _SIZES:
            kept = np.flatnonzero(left >= size)
            code = np.zeros(len(kept), dtype=np.uint64)
            for k in range(size):
                code += values[kept + k] * up[k + 1]
            rows.append(row[kept])
            found.append((mix64(code + np.uint64(size)) >> np.uint64(64 - _BITS)).astype(np.int64))
    both = np.unique(np.concatenate(rows) << _BITS | np.concatenate(found))
    return both >> _BITS, both & ((1 << _BITS) - 1)


def fit(hosts: list[str], paths: list[str], blocked: np.ndarray, rounds: int = 200, decay: float = 1e-3) -> np.ndarray:
    """Weights and, last, the intercept: full-batch gradient steps with a step of its own for each weight."""
    weights = np.zeros((1 << _BITS) + 1)
    n = len(hosts)
    if not n:
        return weights
    row, feature = features(pa.array(hosts, pa.string()), pa.array(paths, pa.string()))
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))
    share = float(np.clip(blocked.mean(), 1 / (n + 2), 1 - 1 / (n + 2)))
    weights[-1] = np.log(share / (1 - share))
    squares = np.full(len(weights), 1e-8)
    for _ in range(rounds):
        z = np.bincount(row, weights=weights[feature] * scale[row], minlength=n) + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - blocked) / n
        gradient = np.append(np.bincount(feature, weights=(error * scale)[row], minlength=1 << _BITS), error.sum())
        gradient[:-1] += decay * weights[:-1]
        squares += gradient**2
        weights -= 0.1 * gradient / np.sqrt(squares)
    return weights


def train(labelled: DataFrame, limit: int = MAX_LABELLED) -> np.ndarray:
    """Fits on a labelled URL table (url, blocked boolean), at most `limit` rows of it, chosen by digest.

    Rows with a NULL label are left out; a NULL url has an empty host and path. With no rows, or with
    one label only, every URL gets that share's verdict.
    """
    rows = (
        labelled.filter("blocked IS NOT NULL")
        .select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("blocked").cast("int"))
        .distinct()
        .withColumn("at", F.md5(F.concat_ws("/", "host", "path").cast("binary")))
        .orderBy("at", "blocked")
        .limit(limit)
        .toPandas()
    )
    return fit(rows["host"].tolist(), rows["path"].tolist(), rows["blocked"].to_numpy(dtype=float))


def judge_urls(
    pages: DataFrame, weights: np.ndarray, rules: Iterable[tuple[str, str]] = RULES, threshold: float = 0.5
) -> DataFrame:
    """Adds host, path, rule, score (0 to 1, how likely it is to be blocked) and verdict to pages (url).

    The longest rule that fits decides; without one a score above the threshold blocks. Extra
    columns stay, those of the added names are replaced. A NULL url, and one without ://, has an
    empty host and path, and no rule fits it.
    """
    added = ("host", "path", "rule", "score", "verdict")
    pages, restored = set_aside(pages, "found")
    parted = pages.drop(*added).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    places = [parted.columns.index(c) for c in ("host", "path")]
    weights = np.asarray(weights, dtype=np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, feature = features(*[batch.column(p) for p in places])
            n = len(batch)
            scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))
            z = np.bincount(row, weights=weights[feature] * scale[row], minlength=n) + float(weights[-1])
            score = pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, "score"])

    scored = parted.mapInArrow(run, parted.withColumn("score", F.lit(0.5)).schema)
    found = best_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("score") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return restored(
        scored.withColumn("found", found)
        .withColumn("rule", F.col("found.rule"))
        .withColumn("verdict", F.coalesce("found.verdict", method))
        .drop("found")
    )


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's verdict. The labelled URLs are the pages that show a labelled document, by the number in their path."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    shown = pages.select("url", F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:[/.]|\z)", 1).alias("number"))
    labelled = shown.withColumn("doc_id", F.expr("try_cast(number AS bigint)")).join(labels, "doc_id")
    weights = train(labelled.select("url", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked")))
    return judge_urls(pages, weights).select("page_id", "host", "path", "rule", "verdict", "score")
