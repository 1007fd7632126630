"""Approximate nearest neighbours: a graph by NN-descent, searched greedily.

The graph begins with the nearest in random cells (vectors on the same side of random planes).
Then each round joins every node with its neighbours, in both directions, and compares these with
each other: a neighbour of a neighbour is likely a neighbour. Rounds go on until few edges of the graph change;
pairs that a node's list held in the round before are not compared again. A query walks the graph: of the
nearest nodes it knows, those not yet opened are opened, their neighbours are measured, until none
of its nearest is closed. Every table is joined by node or by query; nothing is held whole anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worksignal.llm.vectors import element_type, matrix, packed, takes_part
from worksignal.session import settle

#: Neighbours of a node in the graph for each doubling of the nodes (`neighbours_of`); those a round compares in each direction.
NEIGHBOURS_A_DOUBLING, COMPARED = 4, 32
#: Rounds end after one in which at most this share of the graph's edges was new.
FEW_CHANGES = 0.02
#: Random partitions at the start, the size of their cells, neighbours taken from each.
TABLES, CELL, PER_CELL = 8, 1024, 24
#: Nodes a query keeps open.
BEAM = 24
#: The planes are fitted on so many vectors, chosen by digest.
SAMPLE = 2048
_GROUP = 128


def _planes(nodes: DataFrame, n: int, bits: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Normals (dim, TABLES * bits) and offsets: each plane parts the sample in halves, across the line of two of its vectors."""
    draw = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / (1 << 30)
    rows = nodes.filter(draw < 2 * SAMPLE / n).select(draw.alias("draw"), "node", "vec").toPandas()
    sample = matrix(rows.sort_values(["draw", "node"])["vec"].head(SAMPLE), kind)
    random = np.random.default_rng(5)
    first = random.integers(0, len(sample), TABLES * bits)
    second = (first + random.integers(1, max(2, len(sample)), TABLES * bits)) % len(sample)
    normals = (sample[first] - sample[second]).T
    return normals, np.median(sample @ normals, axis=0)


def _coder(normals: np.ndarray, offsets: np.ndarray, bits: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = matrix(batch.column(1).to_pandas(), kind) @ normals > offsets
            codes = side.reshape(len(batch), TABLES, bits) @ (1 << np.arange(bits))
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, (len(batch) + 1) * TABLES, TABLES, dtype=np.int32)), pa.array(codes.reshape(-1).astype(np.int64))
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["node", "codes"])

    return run


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of the last two axes; good enough to choose, not to report."""
    aa, bb = (a * a).sum(-1)[..., :, None], (b * b).sum(-1)[..., None, :]
    return np.maximum(aa + bb - 2 * (a @ np.swapaxes(b, -1, -2)), 0)


def _nearest_in_cell(frame: pd.DataFrame, per_cell: int, kind: str) -> pd.DataFrame:
    nodes, vectors = frame["node"].to_numpy(), matrix(frame["vec"], kind)
    n = min(per_cell, len(nodes) - 1)
    if n < 1:
        return pd.DataFrame({"src": [], "dst": [], "d": []})
    distance = squared(vectors, vectors)
    np.fill_diagonal(distance, np.inf)
    near = np.argpartition(distance, n - 1, axis=1)[:, :n]
    return pd.DataFrame(
        {"src": np.repeat(nodes, n), "dst": nodes[near].reshape(-1), "d": np.take_along_axis(distance, near, 1).reshape(-1)}
    )


def _compare_neighbours(frame: pd.DataFrame, kind: str) -> pd.DataFrame:
    """Offers (src, dst, d) among the neighbours of each node of a group, nearer than the farthest that src has.

    Of each two neighbours one at least is fresh; the others were compared before.
    """
    frame = frame.sort_values(["v", "u"], ignore_index=True)
    v = frame["v"].to_numpy()
    begins = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    sizes = np.diff(np.append(begins, len(v)))
    width = int(sizes.max())
    there = np.arange(width)[None, :] < sizes[:, None]
    at = np.minimum(begins[:, None] + np.arange(width)[None, :], len(v) - 1)
    vectors, u, far = matrix(frame["vec"], kind), frame["u"].to_numpy(), frame["far"].to_numpy()
    fresh = frame["fresh"].to_numpy().astype(bool)
    out = []
    for k in range(0, len(at), 64):
        part, inside = at[k : k + 64], there[k : k + 64]
        distance = squared(vectors[part], vectors[part])
        distance[~(inside[:, :, None] & inside[:, None, :])] = np.inf
        distance[:, np.arange(width), np.arange(width)] = np.inf
        either = fresh[part][:, :, None] | fresh[part][:, None, :]
        i, j, m = np.nonzero((distance < far[part][:, :, None]) & either)
        out.append(pd.DataFrame({"src": u[part[i, j]], "dst": u[part[i, m]], "d": distance[i, j, m]}))
    return pd.concat(out).drop_duplicates(["src", "dst"]) if out else pd.DataFrame({"src": [], "dst": [], "d": []})


def _nearest(edges: DataFrame, n: int) -> DataFrame:
    """Each src's n nearest dst, once each and new if all its edges are; one shuffle by src serves both steps."""
    once = edges.repartition("src").groupBy("src", "dst").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    place = F.row_number().over(Window.partitionBy("src").orderBy("d", "dst"))
    return once.withColumn("place", place).filter(F.col("place") <= n)


def _both_ways(graph: DataFrame, n: int) -> DataFrame:
    """(v, u): the n nearest neighbours u of each v, and the n nearest others that have v as theirs."""
    own = graph.filter(F.col("place") <= n).select(F.col("src").alias("v"), F.col("dst").alias("u"), "d", F.lit(0).alias("way"))
    back = graph.select(F.col("dst").alias("v"), F.col("src").alias("u"), "d", F.lit(1).alias("way"))
    once = own.union(back).repartition("v").groupBy("v", "u").agg(F.min("way").alias("way"), F.min("d").alias("d"))
    place = F.row_number().over(Window.partitionBy("v", "way").orderBy("d", "u"))
    return once.withColumn("place", place).filter(F.col("place") <= n).select("v", "u")


def _fresh(lists: DataFrame, before: DataFrame | None) -> DataFrame:
    """(v, u, fresh): which of the lists (v, u) were not there before; lists without any are left out."""
    if before is None:
        return lists.withColumn("fresh", F.lit(1))
    both = lists.withColumn("now", F.lit(1)).union(before.withColumn("now", F.lit(0))).repartition("v")
    marked = both.groupBy("v", "u").agg(F.max("now").alias("here"), F.min("now").alias("fresh")).filter("here = 1")
    some = F.max("fresh").over(Window.partitionBy("v"))
    return marked.withColumn("some", some).filter("some = 1").select("v", "u", "fresh")


def neighbours_of(n: int) -> int:
    """Neighbours of a node in a graph of n nodes.

    The quality of the lists bounds that of the search: with lists of a fixed length their recall
    falls as n grows, and a wider beam makes up for little of it at the price of many more distances.
    """
    return max(16, int(np.ceil(NEIGHBOURS_A_DOUBLING * np.log2(max(2, n)))))


def build_graph(nodes: DataFrame, n: int, kind: str) -> DataFrame:
    """(src, dst, d, new, place): about the `neighbours_of(n)` nearest of each of n nodes (node, vec), nearest first; `new` in the last round.

    Up to one node more than that, every list holds all other nodes and there is nothing to improve.
    """
    wanted = neighbours_of(n)
    whole = n <= wanted + 1
    bits = 0 if whole else max(1, int(np.ceil(np.log2(n / CELL))))
    tables, per_cell = (1, wanted) if whole else (TABLES, PER_CELL)
    if bits:
        normals, offsets = _planes(nodes, n, bits, kind)
        codes = nodes.select("node", "vec").mapInArrow(_coder(normals, offsets, bits, kind), "node long, codes array<long>")
        codes = codes.select("node", F.posexplode("codes").alias("table", "code"))
    else:
        codes = nodes.select("node", F.lit(0).alias("table"), F.lit(0).alias("code"))
    codes = settle(codes)
    parts = codes.groupBy("table", "code").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("parts"))
    placed = codes.join(parts, ["table", "code"]).withColumn("part", F.pmod(F.xxhash64("node", "table"), "parts"))
    cells = placed.join(nodes.select("node", "vec"), "node").groupBy("table", "code", "part")
    edges = cells.applyInPandas(lambda f: _nearest_in_cell(f, per_cell, kind), "src long, dst long, d double")
    graph = settle(_nearest(edges.withColumn("new", F.lit(1)), wanted))
    groups, before, changed = max(1, -(-n // _GROUP)), None, not whole
    while changed:
        # A list with room left takes any offer.
        far = graph.groupBy("src").agg(F.when(F.count(F.lit(1)) >= wanted, F.max("d")).otherwise(float("inf")).alias("far"))
        full = nodes.select("node", "vec").join(far, F.col("node") == F.col("src"))
        lists = settle(_both_ways(graph, COMPARED))
        near = _fresh(lists, before).join(full, F.col("u") == F.col("node")).select("v", "u", "fresh", "vec", "far")
        offers = near.groupBy(F.pmod(F.xxhash64("v"), F.lit(groups)).alias("g")).applyInPandas(
            lambda f: _compare_neighbours(f, kind), "src long, dst long, d double"
        )
        edges = graph.select("src", "dst", "d", F.lit(0).alias("new")).union(offers.withColumn("new", F.lit(1)))
        graph, before = settle(_nearest(edges, wanted)), lists
        new, every = graph.agg(F.sum("new"), F.count(F.lit(1))).first()
        changed = new > FEW_CHANGES * every
    return graph


def _measure(kind: str):
    """(query, d, node) with the exact distance of the vectors in the columns `asked` and `vec`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            a, b = (matrix(batch.column(k).to_pandas(), kind) for k in (2, 3))
            d = np.sqrt(((a - b) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d), batch.column(1)], ["query", "d", "node"])

    return run


def _walk(graph: DataFrame, nodes: DataFrame, asked: DataFrame, beam: int, kind: str) -> DataFrame:
    """(query, node, d): the `beam` nearest nodes that greedy search finds for each of asked (query, asked), from the node `query` on.

    A query is one row: its beam of nearest nodes so far, with the mark of those opened, and the
    nodes it has measured: a few beams' neighbours, whatever the number of nodes. A round opens all
    that are closed; the driver only learns whether there were any.
    """
    ways = _both_ways(graph, COMPARED).groupBy("v").agg(F.collect_list("u").alias("us"))
    ways = settle(ways.select(F.col("v").alias("src"), "us"))
    node = F.struct(F.lit(0.0).alias("d"), F.col("query").alias("node"), F.lit(False).alias("opened"))
    state = settle(asked.select("query", "asked", F.array(node).alias("beam"), F.array("query").alias("seen")))
    closed = F.transform(F.filter("beam", lambda x: ~x["opened"]), lambda x: x["node"])
    while state.agg(F.sum(F.size(closed))).first()[0]:
        opening = state.select("query", F.explode(closed).alias("src"))
        near = opening.join(ways, "src").select("query", F.explode("us").alias("node")).groupBy("query").agg(F.collect_set("node").alias("near"))
        fresh = state.join(near, "query").select("query", F.explode(F.array_except("near", "seen")).alias("node"), "asked")
        full = fresh.join(nodes.select("node", "vec"), "node").select("query", "node", "asked", "vec")
        hits = full.mapInArrow(_measure(kind), "query long, d double, node long").groupBy("query").agg(
            F.collect_list(F.struct("d", "node", F.lit(False).alias("opened"))).alias("hits")
        )
        kept = F.transform("beam", lambda x: x.withField("opened", F.lit(True)))
        found = F.coalesce("hits", F.filter("beam", lambda x: F.lit(False)))
        state = settle(
            state.join(hits, "query", "left").select(
                "query", "asked", F.slice(F.array_sort(F.concat(kept, found)), 1, beam).alias("beam"),
                F.concat("seen", F.transform(found, lambda x: x["node"])).alias("seen"),
            )
        )
    return state.select("query", F.explode("beam").alias("b")).select("query", "b.node", "b.d")


def nearest_neighbours(vectors: DataFrame, asks: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of vectors (vec_id, embedding) for which `asks` holds.

    Every other row is a candidate, copies of the query too. Score is the Euclidean distance in
    double precision on the vectors as given; ties go to the smaller vec_id. With fewer candidates
    than k, all that the graph reaches are returned. A search begins at the query's own node.

    Equal vectors are one node of the graph with their ids. Vectors that are NULL, empty or zero or
    hold a NULL or non-finite component, rows with a NULL vec_id, and vectors whose length is not
    the most frequent one take no part. Repeated rows count once. Extra columns are ignored.
    """
    kind = element_type(vectors, "embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(asks, F.lit(False)).alias("asks"))
    good = rows.filter(takes_part(F.col("embedding")) & F.col("vec_id").isNotNull())
    usual = good.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    good = packed(good.filter(F.size("embedding") == (usual["dim"] if usual else 0)), "embedding", kind)
    good = settle(good.dropDuplicates(["vec_id", "vec"]))
    nodes = settle(good.groupBy("vec").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")))
    n = nodes.count()
    graph = build_graph(nodes, n, kind)
    queries = good.filter("asks").join(nodes, "vec").select("vec_id", "node")
    asked = settle(queries.select("node").distinct()).join(nodes.select("node", "vec"), "node")
    asked = asked.select(F.col("node").alias("query"), F.col("vec").alias("asked"))
    found = _walk(graph, nodes, asked, max(BEAM, 2 * k + 1), kind)
    # Of a node's copies the k + 1 with the least ids can be in a result; a query is none of its own.
    place = F.row_number().over(Window.partitionBy("query").orderBy("d", "node"))
    nearest = found.withColumn("place", place).filter(F.col("place") <= k + 1).select("query", "node", "d")
    order = Window.partitionBy("node").orderBy("vec_id")
    copies = good.join(nodes.select("vec", "node"), "vec").select("node", "vec_id")
    copies = copies.withColumn("copy", F.row_number().over(order)).filter(F.col("copy") <= k + 1).drop("copy")
    hits = nearest.join(copies, "node").withColumn(
        "place", F.row_number().over(Window.partitionBy("query").orderBy("d", "vec_id"))
    ).filter(F.col("place") <= k + 1)
    hits = hits.select(F.col("query").alias("node"), "vec_id", "d")
    full = queries.withColumnRenamed("vec_id", "query_id").join(hits, "node").filter("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))
    return full.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("d").alias("score"))


def op7_nn_descent(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest of every hundredth vector of `embeddings`, of all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest_neighbours(vectors, F.col("vec_id") % 100 == 0, 10)
