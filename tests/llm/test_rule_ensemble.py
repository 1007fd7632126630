import zlib

import numpy as np
import pyarrow as pa
import pytest

from worksignal.llm.rule_ensemble import STATISTICS, Bound, _classes, extract_rules, fires, fit, fit_lasso, op11_rule_ensemble, rate, statistics, train
from worksignal.llm.words import blocks

from .conftest import SF, given_tables

SF01 = SF.replace("0.001", "0.01")


def stats_of(texts):
    classes = _classes()
    return np.concatenate([statistics(b, classes) for b in blocks(pa.array(texts, pa.string()))])


def test_statistics_by_hand():
    names = list(STATISTICS)
    table = stats_of(["The the CAT!! 12 ##\nök a.", "", None, "x " * 30, "ab"])
    of = lambda row, name: table[row, names.index(name)]
    assert of(0, "n_words") == 7 and of(0, "distinct_share") == 6 / 7 and of(0, "same_as_last_share") == 1 / 7
    assert of(0, "capitals_share") == 1 / 7 and of(0, "letterless_share") == 2 / 7 and of(0, "bangs_per_word") == 2 / 7
    assert of(0, "longest_word") == 5 and of(0, "symbol_end_share") == 1 / 7 and of(0, "sentence_share") == 2 / 7 and of(0, "lines_per_word") == 1 / 7
    assert of(0, "digit_share") == 2 / 19 and of(0, "upper_share") == 4 / 11 and of(0, "short_share") == 6 / 7
    assert not table[1].any() and not table[2].any()
    assert of(3, "top_word_share") == 1 and of(3, "repeated_run_share") == 25 / 26
    assert np.array_equal(stats_of(["ab"] * 3)[1], table[4])  # nothing of its neighbours


def test_rules_are_conjunctions_and_the_lasso_keeps_few():
    random = np.random.default_rng(2)
    x = random.uniform(size=(1500, 6))
    good = ((x[:, 1] > 0.3) & (x[:, 4] <= 0.6)).astype(float)
    rules = extract_rules(x, good)
    assert all(1 <= len(r) <= 3 for r in rules) and len({r for r in rules}) == len(rules)
    assert fires((Bound(1, True, 0.3), Bound(4, False, 0.6)), x).tolist() == (good == 1).tolist()
    model = fit(x, good)
    assert 0 < len(model.rules) < len(rules)
    total = model.intercept + sum(w * fires(r, x) for r, w in model.rules)
    assert np.mean((total > 0) == (good == 1)) > 0.97
    _, none = fit_lasso(np.column_stack([fires(r, x) for r in rules]).astype(float), good, penalty=10.0)
    assert not none.any()


def test_frames(frame):
    texts = [f"some words of number {i} are here, as they should be" for i in range(60)] + [f"BUY!! NOW!! {i} ###" for i in range(60)]
    rows = [(i, t, i < 60) for i, t in enumerate(texts)] + [(200, "unlabelled", None), (None, None, True)]
    model = train(frame(rows, "key long, text string, good boolean"))
    docs = frame([(1, texts[3], 5, "a", "b"), (1, texts[3], 5, "a", "b"), (2, texts[70], 6, "a", "b"), (3, None, 7, "a", "b"), (None, "", 8, "a", "b"),
                  (4, "long " * 200_000, 9, "a", "b")], "doc_id long, text string, score int, statistics string, n_words string")
    got = {(r["doc_id"], r["text"]): r for r in rate(docs, model).collect()}
    assert rate(docs, model).columns == ["doc_id", "text", "statistics", "n_words", "score", "predicted"]
    assert got[1, texts[3]]["score"] > 0.7 > 0.3 > got[2, texts[70]]["score"] and got[1, texts[3]]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) and r["statistics"] == "a" for r in got.values())
    assert got[3, None]["score"] == got[None, ""]["score"]
    table = stats_of([r["text"] for r in got.values()])
    total = model.intercept + sum(w * fires(r, table) for r, w in model.rules)
    assert [r["score"] for r in got.values()] == pytest.approx((1 / (1 + np.exp(-total))).tolist())
    nothing = frame(rows, "key long, text string, good boolean").limit(0)
    assert {r["score"] for r in rate(docs, train(nothing)).collect()} == {0.5}
    assert rate(docs.limit(0), model).count() == 0
    one = train(frame([(1, "a", True), (2, "b", True)], "key long, text string, good boolean"))
    assert all(r["score"] > 0.7 for r in rate(docs, one).collect())


@given_tables
def test_query_on_held_out_documents(spark):
    got = op11_rule_ensemble(spark, SF01).collect()
    assert len(got) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    held = [r for r in got if r["held_out"] and r["doc_id"] in quality]
    assert np.mean([r["predicted"] == quality[r["doc_id"]] for r in held]) >= 0.95
    assert np.mean([r["predicted"] for r in held if quality[r["doc_id"]] == 0]) < 0.2
