"""Text quality by a sparse rule ensemble.

Boosted trees of little depth are grown over statistics of labelled texts. The path to each of their
nodes is a rule, a conjunction of bounds on statistics. A logistic regression with a lasso penalty
over the rules keeps few of them, and these are compiled into one Spark column expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksignal.llm.names import unused
from worksignal.llm.words import Block, blocks, remainder, small_batches, windows

#: Labelled texts that a model is fitted on at most, chosen by digest.
MAX_LABELLED = 10_000
#: A score from here on predicts a good text.
GOOD = 0.7
TREES, DEPTH, RATE, BINS, LEAF = 40, 3, 0.3, 32, 20
PENALTY, STEPS = 5e-4, 400

STATISTICS = (
    "n_words", "word_bytes", "longest_word", "letter_share", "upper_share", "digit_share", "symbol_share", "bangs_per_word",
    "lines_per_word", "distinct_share", "same_as_last_share", "top_word_share", "capitals_share", "letterless_share",
    "short_share", "sentence_share", "symbol_end_share", "repeated_run_share",
)


def _classes() -> dict[str, np.ndarray]:
    def of(test):
        return np.array([test(b) for b in range(256)])

    letter = of(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 192)
    return {
        "inside": of(lambda b: b != 32 and not 9 <= b <= 13 and not 128 <= b < 192),
        "letter": letter,
        "upper": of(lambda b: 65 <= b <= 90),
        "lower": of(lambda b: 97 <= b <= 122),
        "digit": of(lambda b: 48 <= b <= 57),
        "symbol": of(lambda b: 33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:!?'\"()-"),
        "bang": of(lambda b: b == 33),
        "line": of(lambda b: b == 10),
    }


def statistics(block: Block, classes: dict[str, np.ndarray]) -> np.ndarray:
    """A row of STATISTICS for each text of a block; shares of nothing are 0."""
    n = len(block.offsets) - 1
    sums = {name: np.concatenate([[0], np.cumsum(table[block.data])]) for name, table in classes.items()}
    chars = {name: (total[block.offsets[1:]] - total[block.offsets[:-1]]).astype(float) for name, total in sums.items()}
    doc, size = block.doc, block.ends - block.begins
    words = np.bincount(doc, minlength=n).astype(float)

    def share(flags, of=words):
        return np.bincount(doc, weights=flags, minlength=n) / np.maximum(of, 1)

    def within(name):
        return sums[name][block.ends] - sums[name][block.begins]

    longest = np.zeros(n)
    np.maximum.at(longest, doc, size)
    order = np.lexsort((block.hashes, doc))
    sorted_doc, sorted_hash = doc[order], block.hashes[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (sorted_doc[1:] != sorted_doc[:-1]) | (sorted_hash[1:] != sorted_hash[:-1])
    begins = np.flatnonzero(new)
    top = np.zeros(n)
    np.maximum.at(top, sorted_doc[begins], np.diff(np.append(begins, len(doc))))
    same = np.zeros(len(doc), dtype=bool)
    same[1:] = (doc[1:] == doc[:-1]) & (block.hashes[1:] == block.hashes[:-1])
    runs, run_doc = windows(block.hashes, doc, 5)
    order = np.lexsort((runs, run_doc))
    again = np.zeros(len(runs), dtype=bool)
    again[1:] = (runs[order][1:] == runs[order][:-1]) & (run_doc[order][1:] == run_doc[order][:-1])
    n_runs = np.bincount(run_doc, minlength=n)
    last = block.data[block.ends - 1] if len(doc) else np.zeros(0, np.uint8)
    inside = np.maximum(chars["inside"], 1)
    return np.column_stack([
        words, np.bincount(doc, weights=size, minlength=n) / np.maximum(words, 1), longest, chars["letter"] / inside,
        chars["upper"] / np.maximum(chars["upper"] + chars["lower"], 1), chars["digit"] / inside, chars["symbol"] / inside,
        chars["bang"] / np.maximum(words, 1), chars["line"] / np.maximum(words, 1),
        np.bincount(sorted_doc[begins], minlength=n) / np.maximum(words, 1), share(same), top / np.maximum(words, 1),
        share((within("upper") >= 2) & (within("lower") == 0)), share(within("letter") == 0), share(size <= 3),
        share(np.isin(last, np.frombuffer(b".!?", np.uint8))), share(classes["symbol"][last]),
        np.bincount(run_doc[order], weights=again, minlength=n) / np.maximum(n_runs, 1),
    ])


def with_statistics(docs: DataFrame, name: str) -> DataFrame:
    """docs (text) with a struct column `name` of the statistics of every whole text; a NULL counts as empty."""
    small_batches(docs.sparkSession)
    place, fields = docs.columns.index("text"), [pa.field(x, pa.float64()) for x in STATISTICS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _classes()
        for batch in batches:
            parts = [statistics(block, classes) for block in blocks(batch.column(place))]
            table = np.concatenate(parts) if parts else np.zeros((0, len(fields)))
            struct = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x)) for x in table.T], fields=fields)
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], [*batch.schema.names, name])

    empty = F.struct(*[F.lit(0.0).alias(x) for x in STATISTICS])
    return docs.mapInArrow(run, docs.withColumn(name, empty).schema)


class Bound(NamedTuple):
    """statistic > value if above, else statistic <= value."""

    statistic: int
    above: bool
    value: float


class Ensemble(NamedTuple):
    intercept: float
    rules: list[tuple[tuple[Bound, ...], float]]


def _paths(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray, borders: list[np.ndarray], codes: np.ndarray):
    """Grows one tree on gradients and second derivatives; returns its rules and each row's step."""
    step, rules = np.zeros(len(x)), []

    def grow(rows, path):
        g, h = gradient[rows].sum(), weight[rows].sum()
        step[rows] = g / (h + 1)
        if path:
            rules.append(path)
        if len(path) == DEPTH or len(rows) < 2 * LEAF:
            return
        best = (1e-6, -1, -1)
        for k, edges in enumerate(borders):
            if not len(edges):
                continue
            bins = codes[rows, k]
            sums = [np.cumsum(np.bincount(bins, weights=w, minlength=len(edges) + 1))[:-1] for w in (gradient[rows], weight[rows], np.ones(len(rows)))]
            left, mass, count = sums
            gain = left**2 / (mass + 1) + (g - left) ** 2 / (h - mass + 1) - g**2 / (h + 1)
            gain[(count < LEAF) | (count > len(rows) - LEAF)] = -np.inf
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], k, at)
        _, k, at = best
        if k >= 0:
            above = codes[rows, k] > at
            grow(rows[~above], (*path, Bound(k, False, float(borders[k][at]))))
            grow(rows[above], (*path, Bound(k, True, float(borders[k][at]))))

    grow(np.arange(len(x)), ())
    return rules, step


def _merged(path: tuple[Bound, ...]) -> tuple[Bound, ...]:
    """The same conjunction with one bound for each statistic and direction."""
    tightest: dict[tuple[int, bool], float] = {}
    for b in path:
        old = tightest.get((b.statistic, b.above), b.value)
        tightest[b.statistic, b.above] = max(old, b.value) if b.above else min(old, b.value)
    return tuple(Bound(k, above, value) for (k, above), value in sorted(tightest.items()))


def fires(rule: tuple[Bound, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for b in rule:
        out &= (x[:, b.statistic] > b.value) == b.above
    return out


def extract_rules(x: np.ndarray, good: np.ndarray) -> list[tuple[Bound, ...]]:
    """Rules of boosted trees, once each: of rules that the same rows satisfy, the first."""
    borders = [np.unique(np.quantile(column, np.arange(1, BINS) / BINS, method="lower")) for column in x.T]
    borders = [edges[edges < column.max()] for edges, column in zip(borders, x.T)]
    codes = np.column_stack([np.searchsorted(edges, column, "left") for edges, column in zip(borders, x.T)])
    margin, found, seen = np.zeros(len(x)), [], set()
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        rules, step = _paths(x, good - p, p * (1 - p), borders, codes)
        margin += RATE * np.clip(step, -4, 4)
        for rule in map(_merged, rules):
            mark = np.packbits(fires(rule, x)).tobytes()
            if mark not in seen:
                seen.add(mark)
                found.append(rule)
    return found


def fit_lasso(active: np.ndarray, good: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Intercept and weights of the logistic regression with an absolute penalty, by accelerated proximal steps."""
    n, m = active.shape
    share = float(np.clip(good.mean(), 1 / (n + 2), 1 - 1 / (n + 2)))
    intercept, weights = np.log(share / (1 - share)), np.zeros(m)
    if not m:
        return float(intercept), weights
    # The largest eigenvalue bounds the curvature; some power iterations find it, from above with the margin.
    v = np.ones(m)
    for _ in range(30):
        v = active.T @ (active @ v) / n
        norm = np.linalg.norm(v)
        v = v / max(norm, 1e-12)
    rate = 1 / (0.25 * (1.1 * norm + 1))
    at, at0, t = weights.copy(), intercept, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(active @ at + at0, -30, 30))) - good
        moved = at - rate * (active.T @ error / n)
        new = np.sign(moved) * np.maximum(np.abs(moved) - rate * penalty, 0)
        new0 = at0 - rate * error.mean()
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at, at0 = new + (t - 1) / t1 * (new - weights), new0 + (t - 1) / t1 * (new0 - intercept)
        weights, intercept, t = new, new0, t1
    return float(intercept), weights


def fit(x: np.ndarray, good: np.ndarray) -> Ensemble:
    """The ensemble of rows of statistics and their labels (1 for good); without rows every score is 0.5."""
    if not len(x):
        return Ensemble(0.0, [])
    rules = extract_rules(x, good) if 0 < good.mean() < 1 else []
    active = np.column_stack([fires(r, x) for r in rules]).astype(np.float64) if rules else np.zeros((len(x), 0))
    intercept, weights = fit_lasso(active, good)
    return Ensemble(intercept, [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-9])


def train(labelled: DataFrame, limit: int = MAX_LABELLED) -> Ensemble:
    """Fits on texts (key, text, good boolean), at most `limit` of them, chosen by the key's digest.

    Rows with a NULL label are left out, NULL and empty texts are not. With one label only, every
    score is that label's share.
    """
    order = F.md5(F.coalesce(F.col("key").cast("string"), F.lit("")).cast("binary"))
    rows = labelled.filter("good IS NOT NULL").select("text", F.col("good").cast("double").alias("good"), order.alias("at"))
    rated = with_statistics(rows, "stats").select("at", "good", "stats.*")
    chosen = rated.orderBy("at", "good", *STATISTICS).limit(limit).toPandas()
    return fit(chosen[list(STATISTICS)].to_numpy(dtype=float), chosen["good"].to_numpy())


def compile_rules(model: Ensemble, stats: Column) -> Column:
    """The score, 0 to 1, as one expression over a struct of statistics."""
    total = F.lit(model.intercept)
    for rule, weight in model.rules:
        holds = F.lit(True)
        for b in rule:
            value = stats[STATISTICS[b.statistic]]
            holds = holds & (value > b.value if b.above else value <= b.value)
        total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def rate(docs: DataFrame, model: Ensemble, good: float = GOOD) -> DataFrame:
    """Adds score (0 to 1, higher: likelier good) and predicted (1 from `good` on, else 0) to docs (text).

    Whole texts are rated; NULL and empty texts have the score of statistics that are all 0. Repeated
    rows are rated alike. Extra columns stay, those of the added names are replaced. An empty table gives none.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    plain = docs.select(*[F.col(f"`{c}`") for c in kept])
    (stats,) = unused(docs.columns, "statistics")
    rated = with_statistics(plain, stats).withColumn("score", compile_rules(model, F.col(stats)))
    return rated.withColumn("predicted", (F.col("score") >= good).cast("int")).drop(stats)


def op11_rule_ensemble(spark, sf_dir: str) -> DataFrame:
    """The quality of every document; three quarters of the labelled ones may be learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (F.col("quality") == 1).alias("good"))
    # At most MAX_LABELLED ids, by the digest that `train` orders by too.
    chosen = labels.filter(F.col("good").isNotNull() & F.col("doc_id").isNotNull() & ~held)
    chosen = chosen.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "good").limit(MAX_LABELLED)
    labelled = docs.join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").alias("key"), "text", "good")
    rated = rate(docs, train(labelled))
    return rated.select("doc_id", held.alias("held_out"), "score", "predicted")
