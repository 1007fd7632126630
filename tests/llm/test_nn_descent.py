import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import worksignal.llm.nn_descent as nn_descent
from worksignal.llm.nn_descent import nearest_neighbours, op7_nn_descent

from .conftest import SF, given_tables


def exact(ids, vectors, query, k=10):
    d = np.sqrt(((vectors - vectors[query]) ** 2).sum(axis=1))
    d[query] = np.inf
    order = np.lexsort((ids, d))[: min(k, len(ids) - 1)]
    return ids[order], d


def recall(ids, vectors, got, k=10):
    found = {}
    for row in got:
        found.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"], row["score"]))
    hits, n = 0, 0
    place = {int(i): j for j, i in enumerate(ids)}
    for query, rows in found.items():
        want, d = exact(ids, vectors, place[query], k)
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, len(rows) + 1))
        assert all(s == d[place[v]] and v != query for _, v, s in rows)
        assert [(s, v) for _, v, s in rows] == sorted((s, v) for _, v, s in rows)
        hits, n = hits + len(set(want.tolist()) & {v for _, v, _ in rows}), n + len(want)
    return hits / n, len(found)


def test_recall_over_several_cells(frame, monkeypatch):
    monkeypatch.setattr(nn_descent, "CELL", 256)
    vectors = np.random.default_rng(3).normal(size=(1500, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    docs = frame(rows, "vec_id long, embedding array<float>")
    share, n = recall(np.arange(1500), vectors.astype(float), nearest_neighbours(docs, F.col("vec_id") % 50 == 0).collect())
    assert n == 30 and share >= 0.95


def test_copies_ties_odd_vectors_and_few_candidates(frame):
    rows = [(i, [1.0, 0.0], "x") for i in range(30)] + [(40, [0.0, 1.0], "x"), (41, [0.0, -1.0], "x"), (42, [1.0, 0.0, 3.0], "x")]
    rows += [(50, None, "x"), (51, [], "x"), (52, [0.0, 0.0], "x"), (53, [float("nan"), 1.0], "x"), (54, [None, 1.0], "x"), (None, [1.0, 1.0], "x")]
    rows.append(rows[3])
    docs = frame(rows, "vec_id long, embedding array<double>, rank string")
    got = nearest_neighbours(docs, F.col("vec_id").isin(5, 40, 50, 42)).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got if r["query_id"] == 5] == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10]
    assert [r["vec_id"] for r in got if r["query_id"] == 40] == list(range(10))
    assert {r["query_id"] for r in got} == {5, 40}
    few = frame([(1, [1.0]), (2, [3.0]), (3, [2.0])], "vec_id long, embedding array<double>")
    got = nearest_neighbours(few, F.col("vec_id") == 1).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 3, 1.0), (2, 2, 2.0)]
    assert nearest_neighbours(few.limit(0), F.lit(True)).count() == 0


@given_tables
def test_query(spark):
    rows = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    share, n = recall(np.array([i for i, _ in rows]), np.array([v for _, v in rows]), op7_nn_descent(spark, SF).collect())
    assert n == sum(i % 100 == 0 for i, _ in rows) and share >= 0.9


def test_a_round_offers_every_nearer_neighbour_of_a_fresh_pair():
    x = np.arange(8, dtype=np.float64)
    frame = pd.DataFrame({"v": 100, "u": np.arange(8), "fresh": [1, 1, 1, 1, 1, 1, 0, 0], "vec": [v.tobytes() for v in x], "far": 1e9})
    got = nn_descent._compare_neighbours(frame, "f8")
    pairs = {(a, b) for a in range(8) for b in range(8) if a != b} - {(6, 7), (7, 6)}
    assert set(zip(got["src"].astype(int), got["dst"].astype(int))) == pairs


def test_rounds_go_on_until_few_edges_change(frame, monkeypatch):
    for name, value in (("CELL", 32), ("TABLES", 2), ("PER_CELL", 4)):
        monkeypatch.setattr(nn_descent, name, value)
    vectors = np.random.default_rng(4).normal(size=(1500, 8))
    nodes = frame([(i, v.tobytes()) for i, v in enumerate(vectors)], "node long, vec binary")
    graph = nn_descent.build_graph(nodes, 1500, "f8").filter("place <= 10").collect()
    hits = 0
    for i in range(0, 1500, 10):
        want, _ = exact(np.arange(1500), vectors, i)
        hits += len(set(want.tolist()) & {r["dst"] for r in graph if r["src"] == i})
    assert hits / 1500 >= 0.95


def test_lists_grow_slowly_with_the_table():
    assert nn_descent.neighbours_of(10_000) == 54 and nn_descent.neighbours_of(10**8) == 107


@given_tables
@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_query_goes_through_rounds(spark, monkeypatch, sf):
    folder, rounds, fresh = SF.replace("0.001", sf), [], nn_descent._fresh
    monkeypatch.setattr(nn_descent, "_fresh", lambda lists, before: rounds.append(1) or fresh(lists, before))
    rows = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect())
    share, n = recall(np.array([i for i, _ in rows]), np.array([v for _, v in rows]), op7_nn_descent(spark, folder).collect())
    assert n == sum(i % 100 == 0 for i, _ in rows) and share >= 0.95 and len(rounds) >= 1
