import os
import sys

import duckdb
import pytest

from worksignal.llm.mixing import OP8_SQL, mix, op8_mixing, water_fill

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
from check_queries import rows_of  # noqa: E402

from .conftest import SF, given_tables  # noqa: E402


def filled(sizes, weights, total, cap):
    """Clamp and share anew, one source at a time."""
    open_, target = set(range(len(sizes))), [0.0] * len(sizes)
    left = total
    while open_:
        level = left / sum(weights[i] for i in open_)
        above = [i for i in open_ if weights[i] * level > cap * sizes[i]]
        if not above:
            for i in open_:
                target[i] = weights[i] * level
            break
        for i in above:
            target[i] = cap * sizes[i]
            left -= target[i]
            open_.remove(i)
    return target


@pytest.mark.parametrize("total", [0.0, 50.0, 400.0, 840.0, 1000.0])
def test_water_fill(frame, total):
    sizes, weights = [10, 0, 200, 60, 150], [5.0, 1.0, 2.0, 5.0, 1.0]
    rows = [(i, s, w) for i, (s, w) in enumerate(zip(sizes, weights))]
    got = {r["i"]: r["target"] for r in water_fill(frame(rows, "i int, source_size long, weight double"), total, 2.0).collect()}
    want = filled(sizes, weights, total, 2.0)
    assert [got[i] for i in range(5)] == pytest.approx(want)


def test_mix_nears_targets_and_repeats_itself(frame):
    rows = [(i, "w " * (1 + i * 7 % 23), ["a", "b", "c", None, "é"][min(4, i % 9)], "extra", 5) for i in range(400)]
    rows += [(None, "w w", "a", "x", 1), (7, None, "b", "x", 1), (8, "", None, "x", 1), (9, "w " * 50000, "d", "x", 1)]
    schema = "doc_id long, text string, source string, other string, size long"
    got = mix(frame(rows, schema), [5.0, 2.0, 1.0]).collect()
    again = mix(frame(rows, schema, 7), [5.0, 2.0, 1.0]).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(rows)
    assert all(r["size"] == len((r["text"] or "").split()) and r["taken"] == r["size"] * r["repeats"] <= 2 * r["size"] for r in got)
    for source in ["a", "b", "c", None, "é"]:
        own = [r for r in got if r["source"] == source]
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2 + 1e-6
    assert all(r["repeats"] == 2 for r in got if r["source"] == "d") or sum(r["target"] for r in got if r["source"] == "d") < 100000
    assert mix(frame(rows[:1], schema).limit(0), [1.0]).count() == 0


@given_tables
def test_query_is_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = op8_mixing(spark, SF)
    result = con.execute(OP8_SQL)
    columns = [d[0] for d in result.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, result.fetchall())
