import collections
import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from worksignal.llm.interpolation import learn_mixture, op6_interpolation, pack, pack_sorted, score_documents, unpack, unpack_sorted

from .conftest import SF, given_tables

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD)), None]


def counted(rows):
    """Unigrams and bigrams of the rows' texts."""
    words, pairs, starts = collections.Counter(), collections.Counter(), 0
    for text in rows:
        found = tokens(text)
        words.update(found)
        pairs.update(zip(["<start>", *found], found))
        starts += 1
    contexts = collections.Counter(words)
    contexts["<start>"] = starts
    return words, pairs, contexts


def test_packing():
    for values in ([], [0], [3, 2**40, 1], [2**32 - 1]):
        assert unpack(pack(np.array(values, dtype=np.int64))).tolist() == values
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64))
    assert np.array_equal(unpack_sorted(pack_sorted(keys)), keys) and len(unpack_sorted(pack_sorted(keys[:0]))) == 0


def test_mixture_finds_the_weights_that_made_the_counts():
    random = np.random.default_rng(1)
    p = np.array([[0.5, 0.01, 0.001], [0.001, 0.2, 0.001], [0.0, 0.0, 0.001], [0.02, 0.02, 0.001]])
    n = (100000 * (p @ np.array([0.6, 0.3, 0.1]))).round()
    steps = np.where(p > 0, 1 + np.round(-4 * np.log2(np.maximum(p, 1e-9))), 0).astype(int)
    counts = pd.DataFrame({"class": 3, "two": steps[:, 0], "one": steps[:, 1], "n": n * random.uniform(0.99, 1.01, 4)})
    weights = learn_mixture(counts, 999)
    assert np.allclose(weights.sum(axis=1), 1) and (weights > 0).all()
    assert np.allclose(learn_mixture(counts[:0], 5), 1 / 3)


def test_scores_are_those_of_the_counts(frame, monkeypatch):
    rows = [(i, "The cat sat on the %s mat" % ["red", "Blue", "old"][i % 3], "x", 1.0) for i in range(60)]
    rows += [(100, None, "x", 0.0), (101, "", None, 0.0), (102, "unseen words only", "x", 0.0), (None, "the cat", "x", 0.0)]
    rows += [(103, "cat " * 9000, "x", 0.0), rows[0]]
    docs = frame(rows, "doc_id long, text string, other string, score double")
    learned, gone = F.col("doc_id") < 50, F.col("doc_id") % 5 == 0
    got = score_documents(docs, learned, gone).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    words, _, _ = counted([t for i, t, _, _ in rows if i is not None and i < 50])
    n, v = sum(words.values()), len(words)
    for row in got:
        found = tokens(texts[row["doc_id"]])
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in found)
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(found), sum(words[w] > 0 for w in found), n)
        assert row["base_score"] == pytest.approx(base) and row["score"] < 0
    score = {r["doc_id"]: r["score"] / r["n_tokens"] for r in got}
    assert score[55] > score[102] and score[55] > max(r["base_score"] / r["n_tokens"] for r in got if r["doc_id"] == 55)
    assert score_documents(docs.limit(0), learned, gone).count() == 0
    none = score_documents(docs, F.lit(False), gone).collect()
    assert all(r["train_tokens"] == 0 and r["base_score"] == 0 for r in none)


@given_tables
def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rest = {i: zlib.crc32(str(i).encode()) % 7 for i in texts}
    words, pairs, contexts = counted([t for i, t in texts.items() if rest[i] != 2])
    n, v = sum(words.values()), len(words)
    got = op6_interpolation(spark, SF).collect()
    assert len(got) == len(texts)
    held = [r for r in got if r["held_out"]]
    for row in got:
        found = tokens(texts[row["doc_id"]])
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in found)
        assert row["base_score"] == pytest.approx(base, rel=1e-9) and row["held_out"] == (rest[row["doc_id"]] == 2)
        # No mixture can give a token more than its best part, nor all parts less than their least.
        parts = [
            (pairs[a, b] / contexts[a] if contexts[a] else 0, words[b] / n, 1 / (v + 1)) for a, b in zip(["<start>", *found], found)
        ]
        assert sum(math.log10(max(p)) for p in parts) >= row["score"] - 1e-9
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
