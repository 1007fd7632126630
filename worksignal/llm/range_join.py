"""Near-duplicate vectors by an exact metric range join over pivots.

Unit vectors whose cosine is at least c lie within the distance r = sqrt(2 - 2c). Every vector
belongs to the cell of its nearest pivot, p. It can be within r of a member of cell q only if
d(q) - d(p) <= 2r (triangle inequality, twice), so it is copied to just those cells, and each cell
joins its own members with all it holds, independently of the others. Cells of any size are cut
into blocks, and a group is a pair of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksignal.llm.components import components
from worksignal.llm.vectors import element_type, matrix, packed, takes_part
from worksignal.session import settle

#: A label gets a pivot for so many vectors, up to MAX_PIVOTS; all labels together up to ALL_PIVOTS. A label of one block has none.
CELL, MAX_PIVOTS, ALL_PIVOTS = 1024, 64, 4096
_BLOCK = 1024
_SLACK = 1e-9


def unit(m: np.ndarray) -> np.ndarray:
    scaled = m / np.abs(m).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _pivots(nodes: DataFrame, kind: str) -> dict:
    """Pivots of the largest labels, chosen by digest: (label, dim) -> matrix. Bounded by ALL_PIVOTS."""
    sizes = nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL)
    sizes = sizes.withColumn("wanted", F.least(F.ceil(F.col("n") / CELL), F.lit(MAX_PIVOTS)))
    largest = sizes.orderBy(F.desc("n"), "label", "dim").limit(ALL_PIVOTS // MAX_PIVOTS)
    share = 4 * F.col("wanted") / F.col("n")
    draw = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / (1 << 30)
    rows = nodes.join(F.broadcast(largest), ["label", "dim"]).filter(draw < share)
    rows = rows.select("label", "dim", "wanted", "vec", draw.alias("draw"), "node").toPandas()
    out = {}
    for key, group in rows.sort_values(["draw", "node"]).groupby(["label", "dim"], sort=True):
        out[key] = unit(matrix(group["vec"].head(int(group["wanted"].iat[0])), kind))
    return out


def cells(vectors: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit vector, and which cells it is copied to (its home among them)."""
    cosine = np.clip(vectors @ pivots.T, -1, 1)
    distance = np.sqrt(2 - 2 * cosine)
    home = distance.argmin(axis=1)
    return home, distance - distance[np.arange(len(vectors)), home][:, None] <= 2 * reach + _SLACK


def _assign(pivots: dict, reach: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            home, held = np.zeros(len(frame), np.int32), [[0]] * len(frame)
            for key, at in frame.groupby(["label", "dim"]).indices.items():
                if key in pivots:
                    home[at], inside = cells(unit(matrix(frame["vec"].iloc[at], kind)), pivots[key], reach)
                    for i, row in zip(at, inside):
                        held[i] = np.flatnonzero(row).tolist()
            columns = [pa.array(home), pa.array(held, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "home", "cells"])

    return run


def _join_blocks(frame: pd.DataFrame, least: float, kind: str) -> pd.DataFrame:
    """(a, b, n): links of each node a with this block (b NULL, n of them), and pairs (a, b) that connect what is linked."""
    own = np.flatnonzero(frame["own"].to_numpy())
    held = np.flatnonzero(~frame["own"].to_numpy())
    if not len(own) or not len(held):
        return pd.DataFrame({"a": [], "b": [], "n": []})
    vectors = unit(matrix(frame["vec"], kind))
    node, copies = frame["node"].to_numpy(), frame["copies"].to_numpy()
    near = (vectors[own] @ vectors[held].T >= least) & (node[own][:, None] != node[held][None, :])
    counts = near @ copies[held]
    some = np.flatnonzero(counts)
    rows = [pd.DataFrame({"a": node[own][some], "b": -1, "n": counts[some]})]
    # A spanning forest of the block connects what its pairs connect, in fewer rows than it has nodes.
    x, y = np.nonzero(near)
    root: dict[int, int] = {}

    def find(k):
        while root.setdefault(k, k) != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    edges = []
    for a, b in zip(node[own][x].tolist(), node[held][y].tolist()):
        ra, rb = find(a), find(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            edges.append((a, b, 0))
    rows.append(pd.DataFrame(edges, columns=["a", "b", "n"]))
    return pd.concat(rows).astype(np.int64)


def range_join(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of vectors (vec_id, embedding, label).

    Rows are linked if their labels are equal and their cosine, in double precision, is `least` or
    more. n_links counts the other rows linked directly, component_id is the least vec_id that
    links reach, kept says that it is the row's own. Equal vectors of a label are one node with a
    number of copies, so copies are never paired.

    A NULL label, a vector that is NULL, empty or zero or has a NULL or non-finite component, and a
    NULL vec_id link with nothing: no links, the component is the row's own id, kept. Vectors of
    different lengths link with nothing of each other. Repeated rows count as rows of their own.
    """
    kind = element_type(vectors, "embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    part = takes_part(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    good = rows.filter(part).withColumn("dim", F.size("embedding"))
    nodes = good.groupBy("label", "dim", "embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    nodes = settle(packed(nodes, "embedding", kind))
    reach = float(np.sqrt(2 - 2 * least))
    assign = _assign(_pivots(nodes, kind), reach, kind)
    schema = nodes.select("*", F.lit(0).alias("home"), F.array(F.lit(0)).alias("cells")).schema
    assigned = settle(nodes.mapInArrow(assign, schema))
    spread = assigned.withColumn("cell", F.explode("cells")).drop("cells")
    blocks = F.ceil(F.count(F.lit(1)) / _BLOCK).cast("int")
    own = F.ceil(F.sum((F.col("home") == F.col("cell")).cast("int")) / _BLOCK).cast("int")
    sizes = spread.groupBy("label", "dim", "cell").agg(blocks.alias("n_held"), own.alias("n_own")).filter("n_own > 0")
    sized = spread.join(sizes, ["label", "dim", "cell"])
    to_own = sized.filter("home = cell").select(
        "label", "dim", "cell", F.pmod(F.xxhash64("node"), "n_own").cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("n_held") - 1)).alias("j"), "node", "copies", "vec", F.lit(True).alias("own"),
    )
    to_held = sized.select(
        "label", "dim", "cell", F.explode(F.sequence(F.lit(0), F.col("n_own") - 1)).alias("i"),
        F.pmod(F.xxhash64("node"), "n_held").cast("int").alias("j"), "node", "copies", "vec", F.lit(False).alias("own"),
    )
    found = settle(
        to_own.union(to_held).groupBy("label", "dim", "cell", "i", "j")
        .applyInPandas(lambda f: _join_blocks(f, least, kind), "a long, b long, n long")
    )
    degrees = found.filter("n > 0").groupBy("a").agg(F.sum("n").alias("others"))
    linked = components(found.filter("n = 0").select("a", "b"))
    classes = nodes.select("node", "copies", "label", "dim", "vec").join(degrees, F.col("node") == F.col("a"), "left").drop("a")
    classes = classes.join(linked, "node", "left").select(
        F.col("label").alias("l"), F.col("dim").alias("d"), F.col("vec").alias("v"),
        (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"),
    )
    keyed = packed(good.select("vec_id", "label", "dim", "embedding"), "embedding", kind)
    same = (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d")) & (F.col("vec") == F.col("v"))
    linked_rows = keyed.join(classes, same, "left").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~part).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked_rows.union(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_range_join(spark, sf_dir: str) -> DataFrame:
    """All vectors of `embeddings` linked at cosine 0.93 or more within their labels."""
    return range_join(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP9_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least.component_id, e.vec_id = least.component_id AS kept
FROM embeddings e JOIN least ON least.a = e.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) n ON n.a = e.vec_id
"""
