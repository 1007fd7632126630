"""Hard negatives by angular triangle filtering.

Every vector stores its angles to a few reference directions. For two vectors with the angles s and t to
one direction, their own angle lies between |s - t| and min(s + t, 2 pi - s - t), so each direction gives
an interval of their cosine, and the norms make it an interval of their score. A cell holds the vectors
nearest to one direction within a band of angles. An anchor is compared with a cell only if the cell's
interval, over all directions, meets the scores that the anchor looks for, and there only with the window
of rows, in the order of their angle to the cell's direction, whose own interval does. All bounds are
widened by more than rounding can move them; the scores themselves are whole numbers.

Anchors and rows meet in groups of a block of anchors and a part of a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worksignal.llm.vectors import element_type, matrix, packed
from worksignal.session import settle

REFERENCES, SAMPLE = 16, 2048
#: Rows of a part of a cell, bands of a reference at most, anchors of a block, anchors scored at once.
CELL, MAX_BANDS, BLOCK, _CHUNK = 4096, 128, 4096, 64
#: Longest vector after scaling: a hundred times any score then fits 64 bits.
MAX_NORM = 2.0**28
_ANGLE, _COSINE, _EXACT = 1e-5, 1e-9, 2.0**53
_LEAST, _MOST = -(1 << 57), 1 << 57
_FIELDS = "vec_id long, vec binary, norm double, angles array<float>, home int, band int"


def _angles(vectors: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to the references. A zero vector's scores are zero whatever its angles."""
    norm = np.linalg.norm(vectors, axis=1)
    unit = vectors / np.where(norm > 0, norm, 1)[:, None]
    return norm, np.arccos(np.clip(unit @ references.T, -1, 1))


def choose_references(sample: np.ndarray, wanted: int = REFERENCES, rounds: int = 5) -> np.ndarray:
    """Unit directions: means of the groups that a few rounds of assignment to the nearest direction make of a sample."""
    norm = np.linalg.norm(sample, axis=1)
    unit = sample[norm > 0] / norm[norm > 0][:, None]
    if not len(unit):
        return np.eye(1, sample.shape[1])
    found = unit[: min(wanted, len(unit))]
    for _ in range(rounds):
        home = (unit @ found.T).argmax(axis=1)
        sums = np.stack([unit[home == k].sum(axis=0) for k in range(len(found))])
        length = np.linalg.norm(sums, axis=1)
        found = np.where(length[:, None] > 1e-9, sums / np.maximum(length, 1e-9)[:, None], found)
    return found


def band_edges(sample: np.ndarray, references: np.ndarray, n: int) -> list[np.ndarray]:
    """For each reference, the inner borders of its bands: about CELL of all n rows in each."""
    _, angles = _angles(sample, references)
    home = angles.argmin(axis=1)
    out = []
    for k in range(len(references)):
        own = angles[home == k, k]
        bands = min(MAX_BANDS, max(1, int(np.ceil(len(own) / max(1, len(sample)) * n / CELL))))
        out.append(np.quantile(own, np.arange(1, bands) / bands) if len(own) and bands > 1 else np.zeros(0))
    return out


def _placer(references: np.ndarray, edges: list[np.ndarray], kind: str):
    """Adds norm, angles, home and band to rows (vec_id, label, asks, vec); rows that are too long go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            norm, angles = _angles(matrix(batch.column(3).to_pandas(), kind), references)
            home = angles.argmin(axis=1)
            nearest = angles[np.arange(len(home)), home]
            band = np.zeros(len(home), dtype=np.int32)
            for k in np.unique(home).tolist():
                band[home == k] = np.searchsorted(edges[k], nearest[home == k], "right")
            ends = pa.array(np.arange(len(home) + 1, dtype=np.int32) * len(references))
            lists = pa.ListArray.from_arrays(ends, pa.array(angles.astype(np.float32).reshape(-1)))
            columns = [*batch.columns, pa.array(norm), lists, pa.array(home.astype(np.int32)), pa.array(band)]
            whole = pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "norm", "angles", "home", "band"])
            yield whole.filter(pa.array(norm <= MAX_NORM))

    return run


def reach(low: np.ndarray, norm: np.ndarray, shortest: float, longest: float) -> np.ndarray:
    """Least cosine at which an anchor and a vector of a norm between the two can score `low` or more."""
    other = np.where(low > 0, longest, shortest)
    product = norm * other
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(product > 0, low / product, np.where(low > 0, np.inf, -np.inf))
    return cosine - _COSINE * (1 + np.abs(cosine))


def keep(high: np.ndarray, norm: np.ndarray, shortest: float, longest: float) -> np.ndarray:
    """Greatest cosine at which an anchor and a vector of a norm between the two can score `high` or less."""
    return -reach(-high, norm, shortest, longest)


def overlapping(norm, angles, low, high, cells: dict) -> np.ndarray:
    """Whether the scores from low to high of each anchor (row) can occur in each cell (column)."""
    out = np.zeros((len(norm), len(cells["n"])), dtype=bool)
    for k in range(len(cells["n"])):
        least, most = cells["least"][k] - _ANGLE, cells["most"][k] + _ANGLE
        nearest = np.clip(np.maximum(least - angles, angles - most), 0, np.pi).max(axis=1)
        farthest = np.minimum(np.minimum(angles + most, 2 * np.pi - angles - least), np.pi).min(axis=1)
        shortest, longest = cells["shortest"][k], cells["longest"][k]
        near = np.cos(nearest) >= reach(low, norm, shortest, longest)
        out[:, k] = near & (np.cos(np.maximum(farthest, 0)) <= keep(high, norm, shortest, longest))
    return out


def windows(theta, norm, low, high, rows: np.ndarray, shortest: float, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """First row and end, for each anchor, of the rows (ascending angles to the cell's direction) that can score from low to high."""
    cosine = reach(low, norm, shortest, longest)
    far = np.where(cosine > 1, -1.0, np.arccos(np.clip(cosine, -1, 1)) + _ANGLE)
    far = np.where(cosine < -1, 2 * np.pi, far)
    # Nearer to the direction than this, a row's angle to the anchor is too small for so low a score.
    cosine = keep(high, norm, shortest, longest)
    close = np.where(cosine < -1, np.inf, np.where(cosine > 1, -np.inf, np.arccos(np.clip(cosine, -1, 1)) - theta - _ANGLE))
    begin = np.searchsorted(rows, np.maximum(theta - far, close), "left")
    end = np.searchsorted(rows, theta + far, "right")
    return begin, np.maximum(begin, end)


def _first(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n highest scores, ties to smaller ids, in order."""
    if len(scores) > n:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - n)[len(scores) - n])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:n]]


def _pairs(anchors: pd.DataFrame, rows: pd.DataFrame, kind: str):
    """(anchor's position, rows' positions, their whole scores) for the window of each anchor, and both frames in their orders."""
    anchors = anchors.sort_values(["theta", "vec_id"], ignore_index=True)
    rows = rows.sort_values(["theta", "vec_id"], ignore_index=True)
    a, b = matrix(anchors["vec"], kind), matrix(rows["vec"], kind)
    norms, others = anchors["norm"].to_numpy(), rows["norm"].to_numpy()
    if norms.max() * others.max() >= _EXACT:  # floating-point sums would not be exact
        a, b = a.astype(np.int64), b.astype(np.int64)
    begin, end = windows(
        anchors["theta"].to_numpy(), norms, anchors["low"].to_numpy().astype(float), anchors["high"].to_numpy().astype(float),
        rows["theta"].to_numpy(), others.min(), others.max(),
    )

    def found():
        for k in range(0, len(a), _CHUNK):
            some = np.arange(k, min(k + _CHUNK, len(a)))
            some = some[end[some] > begin[some]]
            if len(some):
                first, last = begin[some].min(), end[some].max()
                scores = (a[some] @ b[first:last].T).astype(np.int64)
                for i, row in zip(some.tolist(), scores):
                    yield i, begin[i], end[i], row[begin[i] - first : end[i] - first]

    return anchors, rows, found()


def _positives(anchors: pd.DataFrame, rows: pd.DataFrame, n: int, kind: str) -> pd.DataFrame:
    """(anchor, id, score): the n highest of each anchor's label among the rows."""
    out: list = []
    if len(anchors) and len(rows):
        anchors, rows, found = _pairs(anchors, rows, kind)
        ids, labels, own = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), anchors["label"].to_numpy()
        names = anchors["vec_id"].to_numpy()
        for i, begin, end, scores in found:
            at = np.flatnonzero((labels[begin:end] == own[i]) & (ids[begin:end] != names[i]))
            at = at[_first(scores[at], ids[begin + at], n)]
            out.append(pd.DataFrame({"anchor": names[i], "id": ids[begin + at], "score": scores[at]}))
    return pd.concat(out) if out else pd.DataFrame({"anchor": [], "id": [], "score": []})


def _negatives(anchors: pd.DataFrame, rows: pd.DataFrame, n: int, low: int, high: int, kind: str) -> pd.DataFrame:
    """(anchor, positive, id, score): for each score of an anchor's positives the first n of other labels in its range."""
    out: list = []
    if len(anchors) and len(rows):
        anchors, rows, found = _pairs(anchors, rows, kind)
        ids, labels, own = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), anchors["label"].to_numpy()
        names, wanted = anchors["vec_id"].to_numpy(), anchors["wanted"].tolist()
        lows, highs = anchors["low"].to_numpy(), anchors["high"].to_numpy()
        for i, begin, end, scores in found:
            at = np.flatnonzero((labels[begin:end] != own[i]) & (scores >= lows[i]) & (scores <= highs[i]))
            scores, others = scores[at], ids[begin + at]
            for p in wanted[i]:
                fits = np.flatnonzero((100 * scores <= high * p) & (100 * scores >= low * p))
                fits = fits[_first(scores[fits], others[fits], n)]
                out.append(pd.DataFrame({"anchor": names[i], "positive": p, "id": others[fits], "score": scores[fits]}))
    return pd.concat(out) if out else pd.DataFrame({"anchor": [], "positive": [], "id": [], "score": []})


def _cells(placed: DataFrame, references: int) -> dict:
    """What the driver knows of each cell: rows, norms, angles to every reference. Their number is bounded by the bands."""
    ends = [f(F.element_at("angles", k + 1)).alias(f"{name}{k}") for k in range(references) for f, name in ((F.min, "least"), (F.max, "most"))]
    rows = placed.groupBy("home", "band").agg(F.count(F.lit(1)).alias("n"), F.min("norm").alias("shortest"), F.max("norm").alias("longest"), *ends)
    rows = rows.orderBy("home", "band").toPandas()
    spans = {name: rows[[f"{name}{k}" for k in range(references)]].to_numpy(dtype=float) for name in ("least", "most")}
    return {name: rows[name].to_numpy() for name in ("home", "band", "n", "shortest", "longest")} | spans


def _aimer(cells: dict, blocks: dict, own_cell: bool, places: dict[str, int]):
    """One row for each anchor and part of a cell that it must be compared with: adds block, home, band, part and theta."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {pair: k for k, pair in enumerate(zip(cells["home"].tolist(), cells["band"].tolist()))}
        parts = -(-cells["n"] // CELL)
        for batch in batches:
            if not len(batch):
                continue
            column = {name: batch.column(at) for name, at in places.items()}
            norm = column["norm"].to_numpy(zero_copy_only=False)
            angles = column["angles"].flatten().to_numpy(zero_copy_only=False).reshape(len(norm), -1).astype(float)
            homes, bands = column["home"].to_pylist(), column["band"].to_pylist()
            if own_cell:
                who = np.arange(len(norm))
                cell = np.array([number[pair] for pair in zip(homes, bands)])
                part = np.zeros(len(who), dtype=np.int64)
            else:
                low, high = (column[x].to_numpy(zero_copy_only=False).astype(float) for x in ("low", "high"))
                who, cell = np.nonzero(overlapping(norm, angles, low, high, cells))
                n = parts[cell]
                part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                who, cell = np.repeat(who, n), np.repeat(cell, n)
            ids = column["vec_id"].to_numpy(zero_copy_only=False)
            block = np.array([blocks[h][0] + i % blocks[h][1] for h, i in zip(homes, (ids // 100).tolist())])
            home = cells["home"][cell]
            new = [pa.array(x) for x in (block[who], home.astype(np.int32), cells["band"][cell].astype(np.int32), part, angles[who, home])]
            names = ["vec_id", "label", "vec", "norm", *[x for x in ("low", "high", "wanted") if x in places]]
            old = [column[x].take(pa.array(who)) for x in names]
            yield pa.RecordBatch.from_arrays([*new, *old], ["block", "home", "band", "part", "theta", *names])

    return run


def _compare(placed: DataFrame, anchors: DataFrame, cells: dict, blocks: dict, own_cell: bool, compared, schema: str) -> DataFrame:
    """Groups of anchors and rows that must be compared, through `compared(anchors, rows)`."""
    places = {name: k for k, name in enumerate(anchors.columns)}
    fields = [f for f in anchors.schema.fields if f.name in ("vec_id", "label", "vec", "norm", "low", "high", "wanted")]
    order = ["vec_id", "label", "vec", "norm", *[x for x in ("low", "high", "wanted") if x in places]]
    kept = ", ".join(f"{name} {next(f for f in fields if f.name == name).dataType.simpleString()}" for name in order)
    aimed = settle(anchors.mapInArrow(
        _aimer(cells, blocks, own_cell, places), f"block long, home int, band int, part long, theta double, {kept}"
    ))
    parts = aimed.sparkSession.createDataFrame(
        [(int(h), int(b), int(-(-n // CELL))) for h, b, n in zip(cells["home"], cells["band"], cells["n"])] or [(0, 0, 1)],
        "home int, band int, parts int",
    )
    parted = placed.join(F.broadcast(parts), ["home", "band"])  # one row a cell
    parted = parted.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("long"))
    needed = aimed.select(F.col("block").alias("asking"), "home", "band", "part").distinct()
    rows = parted.join(needed, ["home", "band", "part"]).select(
        F.col("asking").alias("block"), "home", "band", "part", F.element_at("angles", F.col("home") + 1).cast("double").alias("theta"), "vec_id", "label", "vec", "norm"
    )
    keys = ["block", "home", "band", "part"]
    rows = rows.toDF(*rows.columns)
    return aimed.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(compared, schema)


def hard_negatives(
    vectors: DataFrame, asks: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, embedding, label).

    Each component x becomes floor(scale * x); the score of two rows is their inner product. Rows for
    which `asks` holds are anchors. An anchor's positives are its `positives` highest-scoring other rows
    of its label; for each positive the `negatives` highest-scoring rows of another label are returned
    whose score s satisfies low * p <= 100 * s <= high * p, p being the positive's score. Ties go to the
    smaller vec_id. An anchor without positives, and a positive without such rows, has none.

    A NULL vec_id, label or vector, NULL or non-finite components, empty vectors, vectors whose length is
    not the most frequent one, and vectors longer than 2^28 once scaled (their scores may leave 64 bits)
    take no part; zero vectors do. Rows of one vec_id are one row: the least label and, of it, the least
    bytes. Extra columns are ignored. An empty table gives none.
    """
    kind = element_type(vectors, "embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.coalesce(asks, F.lit(False)).alias("asks"), "embedding")
    limit = MAX_NORM / scale
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) <= limit), F.lit(False)))
    good = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & fine)
    usual = good.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = usual["dim"] if usual else 0
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    coded = packed(good.filter(F.size("embedding") == dim).withColumn("embedding", whole), "embedding", kind)
    once = settle(coded.groupBy("vec_id").agg(F.min(F.struct("label", "vec", "asks")).alias("r")).select("vec_id", "r.label", "r.asks", "r.vec"))
    n = once.count()
    draw = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / (1 << 30)
    picked = once.filter(draw < 2 * SAMPLE / max(1, n)).select(draw.alias("draw"), "vec_id", "vec").toPandas()
    picked = picked.sort_values(["draw", "vec_id"])["vec"].head(SAMPLE)
    sample = matrix(picked, kind) if len(picked) else np.zeros((1, max(1, dim)))
    references = choose_references(sample)
    placer = _placer(references, band_edges(sample, references, n), kind)
    schema = once.select("*", F.lit(0.0).alias("norm"), F.array(F.lit(0.0).cast("float")).alias("angles"), F.lit(0).alias("home"), F.lit(0).alias("band"))
    placed = settle(once.mapInArrow(placer, schema.schema))
    cells = _cells(placed, len(references))
    anchors = placed.filter("asks").drop("asks")
    blocks, first = {}, 0
    taken = BLOCK
    for row in anchors.groupBy("home").count().orderBy("home").collect():  # as many rows as references at most
        wanted = -(-row["count"] // BLOCK)
        if taken + row["count"] > BLOCK:
            blocks[row["home"]], first, taken = (first, wanted), first + wanted, row["count"] if wanted == 1 else BLOCK
        else:
            blocks[row["home"]], taken = (first - 1, 1), taken + row["count"]

    def top(found: DataFrame, by: list[str], n: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
        return found.withColumn("place", place).filter(F.col("place") <= n)

    pick = lambda a, r: _positives(a, r, positives, kind)
    found = "anchor long, id long, score long"
    open_ends = anchors.withColumn("low", F.lit(_LEAST)).withColumn("high", F.lit(_MOST))
    # An anchor's own cell says what its last positive must reach at least.
    seeds = top(_compare(placed, open_ends, cells, blocks, True, pick, found), ["anchor"], positives).groupBy("anchor").agg(
        F.when(F.count(F.lit(1)) == positives, F.min("score")).alias("seed")
    )
    seeded = anchors.join(seeds, F.col("vec_id") == F.col("anchor"), "left").drop("anchor")
    seeded = seeded.withColumn("low", F.coalesce("seed", F.lit(_LEAST))).withColumn("high", F.lit(_MOST)).drop("seed")
    best = settle(top(_compare(placed, seeded, cells, blocks, False, pick, found), ["anchor"], positives))
    # A negative score has no range: low * p <= high * p fails.
    wanted = best.filter("score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_set("score")).alias("wanted"))
    asked = anchors.join(wanted, F.col("vec_id") == F.col("anchor")).drop("anchor")
    asked = asked.withColumn("low", F.expr(f"wanted[0] * {low} div 100")).withColumn("high", F.expr(f"element_at(wanted, -1) * {high} div 100"))
    choose = lambda a, r: _negatives(a, r, negatives, low, high, kind)
    against = _compare(placed, asked, cells, blocks, False, choose, "anchor long, positive long, id long, score long")
    ranked = top(against, ["anchor", "positive"], negatives).select(
        "anchor", "positive", F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    chosen = best.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive"))
    return chosen.join(ranked, ["anchor", "positive"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", F.col("positive").alias("positive_score"), "negative_score"
    )


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector of `embeddings`; every seventh bears the next label instead of its own."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", shifted), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
  s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
WHERE 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""
