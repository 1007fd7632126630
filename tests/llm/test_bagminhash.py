import collections
import random
import re

import numpy as np
import pytest

import worksignal.llm.bagminhash as bagminhash
from worksignal.llm.bagminhash import near_duplicates, op3_bagminhash, signatures
from worksignal.llm.words import mix64

from .conftest import SF, given_tables


def bag(text):
    words = [w.encode().lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(bool(words), len(words) - 4)))


def classes(rows, similarity=0.8):
    """The least doc_id of each document's component, by comparing all texts."""
    texts = {}
    for doc_id, text in rows:
        if doc_id is not None:
            texts.setdefault(text, []).append(doc_id)
    nodes = [(min(ids), bag(text)) for text, ids in texts.items()]
    root = {n: n for n, _ in nodes}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, x) in enumerate(nodes):
        for b, y in nodes[:i]:
            shared = sum((x & y).values())
            if shared and shared >= similarity * (sum(x.values()) + sum(y.values()) - shared):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    out = {}
    for text, ids in texts.items():
        for i in ids:
            out[i] = find(min(ids)) if bag(text) else i
    return out


def test_places_agree_as_often_as_weighted_jaccard_says():
    random.seed(1)
    errors = []
    for trial in range(40):
        a, b = ({k: random.choice([1, 1, 2, 3, 8, 30]) for k in range(s, s + 20)} for s in (0, 5))
        shingle = mix64(np.array([1000 * trial + k for k in [*a, *b]], dtype=np.uint64))
        doc, weight = np.repeat([0, 1], 20), np.array([*a.values(), *b.values()])
        sig = signatures(shingle, doc, weight, 3, 256)
        assert np.isinf(sig[2]).all() and np.isfinite(sig[:2]).all()
        a, b = collections.Counter(a), collections.Counter(b)
        errors.append((sig[0] == sig[1]).mean() - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.05


def made():
    random.seed(3)
    vocabulary = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 5))) for _ in range(900)]

    def words(n):
        return [random.choice(vocabulary) for _ in range(n)]

    rows, base = [], words(150)
    for i in range(60):  # near copies of a text that is not there itself
        copy = list(base)
        for _ in range(random.randint(0, 6)):
            copy[random.randrange(150)] = "edited%d" % random.randrange(10**6)
        rows.append((1000 + i, " ".join(copy)))
    rows += [(i, " ".join(words(random.randint(1, 120)))) for i in range(60)]
    rows += [(200 + i, rows[60][1]) for i in range(20)] + [(300 + i, "tiny text") for i in range(5)]
    rows += [(400, None), (401, ""), (402, " \n"), (None, "tiny text"), (403, "TINY  text"), (404, "the " * 30000)]
    return rows + rows[:3]


@pytest.mark.parametrize("small", [16, 1])
def test_classes_are_those_of_all_pairs(frame, monkeypatch, small):
    monkeypatch.setattr(bagminhash, "_SMALL", small)
    monkeypatch.setattr(bagminhash, "_CHUNK_DOCS", 10)
    rows = made()
    got = near_duplicates(frame([(*r, "x") for r in rows], "doc_id long, text string, class_id string")).collect()
    assert len(got) == len(rows)
    want = classes(rows)
    for row in got:
        assert row["class_id"] == want.get(row["doc_id"])
        assert row["kept"] == (row["doc_id"] is None or row["class_id"] == row["doc_id"])


def test_empty_table(frame):
    assert near_duplicates(frame([(1, "a")], "doc_id long, text string").limit(0)).count() == 0


@given_tables
def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {r["doc_id"]: r["class_id"] for r in op3_bagminhash(spark, SF).collect()} == classes(rows)
