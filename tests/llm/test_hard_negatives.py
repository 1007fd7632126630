import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import worksignal.llm.hard_negatives as hard_negatives
from worksignal.llm.hard_negatives import OP12_SQL, keep, op12_hard_negatives, overlapping, reach, windows

from .conftest import SF, given_tables


def brute(rows, positives, negatives, low, high, scale):
    """Every anchor against every row; rows (vec_id, vector, label, asks) of distinct ids that all take part."""
    out = []
    whole = [(i, [int(np.floor(x * scale)) for x in v], label, asks) for i, v, label, asks in rows]
    for i, v, label, asks in whole:
        if not asks:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other == label) for j, w, other, _ in whole if j != i)
        for p, j, _ in [s for s in scored if s[2]][:positives]:
            fits = [(n, k) for n, k, same in scored if not same and low * -p <= 100 * -n <= high * -p][:negatives]
            out += [(i, j, rank, k, -p, -n) for rank, (n, k) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind, cell, spread", [("float", 4096, 0.3), ("double", 12, 0.1), ("float", 20, 2.0)])
def test_negatives_are_those_of_all_pairs(frame, monkeypatch, kind, cell, spread):
    monkeypatch.setattr(hard_negatives, "CELL", cell)
    monkeypatch.setattr(hard_negatives, "BLOCK", 9)
    random = np.random.default_rng(cell)
    centres = random.normal(size=(6, 5)) * random.uniform(0.2, 3, (6, 1))
    vectors = centres[random.integers(0, 6, 240)] + spread * random.normal(size=(240, 5))
    vectors[30:50] = vectors[30]  # copies tie
    vectors[60:63] = 0
    rows = [(i, [float(np.float32(x)) for x in v], i % 4, i % 8 == 0) for i, v in enumerate(vectors)]
    lost = [(500, None, 1, True), (501, [1.0] * 4 + [None], 1, True), (502, [float("nan")] + [0.0] * 4, 1, True), (503, [1.0] * 5, None, True),
            (None, [1.0] * 5, 1, True), (504, [], 1, True), (505, [1.0] * 3, 1, True), (506, [float("inf")] + [0.0] * 4, 1, False), (507, [1e9] * 5, 1, True)]
    docs = frame([(*r, "x", 1) for r in rows + lost + rows[:20]], f"vec_id long, embedding array<{kind}>, label int, ask boolean, norm string, cell int")
    got = hard_negatives.hard_negatives(docs, F.col("ask"), 4, 3, 70, 100, 64.0)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 4, 3, 70, 100, 64.0)


def test_empty_and_lonely(frame):
    schema = "vec_id long, embedding array<float>, label int"
    docs = frame([(100, [1.0, 0.0], 1), (200, [1.0, 0.0], 2)], schema)
    every = F.col("vec_id") % 100 == 0
    assert hard_negatives.hard_negatives(docs, every).count() == 0  # no positives
    assert hard_negatives.hard_negatives(docs.limit(0), every).count() == 0
    docs = frame([(100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 2), (2, [0.9, 0.0], 3)], schema)
    assert [tuple(r) for r in hard_negatives.hard_negatives(docs, every).collect()] == [(100, 1, 1, 2, 65536, 65536)]


def test_bounds_never_exclude_a_score_in_range():
    random = np.random.default_rng(3)
    a, rows = random.normal(size=(40, 6)), random.normal(size=(300, 6)) * random.uniform(0.5, 2, (300, 1))
    reference = random.normal(size=6)
    reference /= np.linalg.norm(reference)
    norm, other = np.linalg.norm(a, axis=1), np.linalg.norm(rows, axis=1)
    theta = np.arccos(a @ reference / norm)
    angle = np.arccos(rows @ reference / other)
    order = np.argsort(angle)
    rows, other, angle = rows[order], other[order], angle[order]
    scores = a @ rows.T
    for low, high in ((-9.0, -1.0), (-1.0, 1.0), (0.0, 2.0), (2.0, 4.0), (1.0, 1e9)):
        lows, highs = np.full(40, low), np.full(40, high)
        begin, end = windows(theta, norm, lows, highs, angle, other.min(), other.max())
        cells = {"n": [300], "least": np.array([[angle.min()]]), "most": np.array([[angle.max()]]), "shortest": [other.min()], "longest": [other.max()]}
        near = overlapping(norm, theta[:, None], lows, highs, cells)[:, 0]
        for i in range(40):
            inside = np.flatnonzero((scores[i] >= low) & (scores[i] <= high))
            assert not len(inside) or (begin[i] <= inside.min() and inside.max() < end[i] and near[i])
    assert (end - begin).mean() < 300
    assert reach(np.array([1.0]), np.array([1.0]), 0.5, 2.0)[0] <= 0.5 <= keep(np.array([1.0]), np.array([1.0]), 0.5, 2.0)[0]


@given_tables
def test_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(tuple(r) for r in op12_hard_negatives(spark, SF).collect()) == sorted(con.execute(OP12_SQL).fetchall())
