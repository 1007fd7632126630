import duckdb
import numpy as np
import pytest

import worksignal.llm.range_join as range_join
from worksignal.llm.range_join import OP9_SQL, op9_range_join

from .conftest import SF, given_tables


def linked(rows, least=0.93):
    """vec_id: (links, component) by comparing all pairs; rows (vec_id, vector, label) of distinct ids."""
    good = [
        (i, np.array(v, dtype=np.float64), label) for i, v, label in rows
        if v and label is not None and i is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    root, links = {i: i for i, _, _ in good}, {i: 0 for i, _, _ in good}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, (a, x, p) in enumerate(good):
        for b, y, q in good[:k]:
            if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[a], links[b] = links[a] + 1, links[b] + 1
                c, d = find(a), find(b)
                root[max(c, d)] = min(c, d)
    least_id = {}
    for i in root:
        least_id[find(i)] = min(i, least_id.get(find(i), i))
    return {i: (links.get(i, 0), least_id[find(i)] if i in root else i) for i, _, _ in rows}


@pytest.mark.parametrize("cell, block", [(4096, 1024), (30, 16)])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_links_are_those_of_all_pairs(frame, monkeypatch, cell, block, kind):
    monkeypatch.setattr(range_join, "CELL", cell)
    monkeypatch.setattr(range_join, "_BLOCK", block)
    random = np.random.default_rng(7)
    centres = random.normal(size=(12, 8))
    vectors = centres[random.integers(0, 12, 260)] + 0.22 * random.normal(size=(260, 8))
    vectors[40:70] = vectors[40]  # copies
    rows = [(i, [float(np.float32(x)) for x in v], int(i % 3)) for i, v in enumerate(vectors)]
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 8, 1), (503, [float("nan")] * 8, 1), (504, [None] * 8, 1)]
    rows += [(505, rows[0][1], None), (506, [float("inf")] * 8, 0), (507, rows[0][1][:5], 0), (508, [3 * x for x in rows[1][1]], 1)]
    schema = f"vec_id long, embedding array<{kind}>, label int"
    got = range_join.range_join(frame(rows, schema)).collect()
    want = linked(rows)
    assert len(got) == len(rows) and len({r["vec_id"] for r in got}) == len(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_repeated_and_nameless_rows_and_an_empty_table(frame):
    rows = [(1, [1.0, -0.0], 1, "x"), (1, [1.0, 0.0], 1, "x"), (2, [0.0, 1.0], 1, "x"), (None, [1.0, 0.0], 1, "x")]
    docs = frame(rows, "vec_id long, embedding array<float>, label int, kept string")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in range_join.range_join(docs).collect())
    assert got == [(0, 0, None, True), (1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]
    assert range_join.range_join(docs.limit(0)).count() == 0


@given_tables
def test_query(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in op9_range_join(spark, SF).collect()}
    assert {i: x[:2] for i, x in got.items()} == linked(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert {i: (n, c, k) for i, n, c, k in con.execute(OP9_SQL).fetchall()} == got
