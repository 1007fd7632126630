import random

import numpy as np

from worksignal.llm.chunking import chunks, drop_repeats, op10_chunking
from worksignal.llm.words import mix64

from .conftest import SF, given_tables


def cut_words(values):
    begins, digests = chunks(mix64(np.array(values, dtype=np.uint64)), np.zeros(len(values), np.int64))
    return begins, digests


def test_an_insertion_moves_no_far_cut():
    random.seed(1)
    text = [random.randrange(10**6) for _ in range(600)]
    changed = text[:300] + [1, 2, 3] + text[300:]
    a, b = cut_words(text), cut_words(changed)
    assert [x for x in a[0] if x < 290] == [x for x in b[0] if x < 290]
    assert [x + 3 for x in a[0] if x > 312] == [x for x in b[0] if x > 315]
    assert len(set(a[1].tolist()) - set(b[1].tolist())) <= 4
    assert 4 <= 600 / len(a[0]) <= 12


def test_planted_passages_stay_once_and_clean_texts_stay(frame):
    random.seed(3)
    vocabulary = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 6))) for _ in range(3000)]

    def words(n):
        return [random.choice(vocabulary) for _ in range(n)]

    passages = [words(51) for _ in range(40)]
    rows = []
    for i in range(300):
        inside = passages[i % 40] if i < 200 else []
        rows.append((i, " ".join(words(random.randint(5, 150)) + inside + words(random.randint(5, 150))), "x", -1))
    rows += [(900, None, "x", 0), (901, "", "x", 0), (902, " one two ", "x", 0), (None, "three\n", "x", 0), rows[250]]
    long = words(60)
    rows.append((903, " ".join(long + words(9000) + long), "x", 0))
    docs = frame(rows, "doc_id long, text string, other string, n_words int", 5)
    got = drop_repeats(docs).collect()
    assert len(got) == len(rows)
    texts = {r["doc_id"]: r for r in got}
    for k, passage in enumerate(passages):
        assert sum(" ".join(passage) in (texts[i]["text"]) for i in range(k, 200, 40)) == 1
    for doc_id, text, _, _ in rows:
        if doc_id is None or 200 <= doc_id < 903:
            assert texts[doc_id]["text"] == text and texts[doc_id]["n_repeated"] == 0 and texts[doc_id]["passages"] == []
    assert texts[903]["n_repeated"] >= 35 and len(texts[903]["passages"]) == 1
    for row in got:
        assert len((row["text"] or "").split()) == row["n_words"] - row["n_repeated"]
    assert drop_repeats(docs.limit(0)).count() == 0


@given_tables
def test_query_against_brute_force(spark):
    """No chunk run of the result occurs twice, and what is gone occurs elsewhere."""
    docs = {r["doc_id"]: (r["text"] or "").split() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    runs = {}
    for doc_id, words in docs.items():
        lowered = [w.lower() for w in words]
        for i in range(len(words) - 19):
            runs.setdefault(tuple(lowered[i : i + 20]), set()).add((doc_id, i))
    got = op10_chunking(spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(docs) and any(r["n_repeated"] for r in got)
    for row in got:
        assert row["n_words"] == len(docs[row["doc_id"]])
        gone = sum(p["n_words"] for p in row["passages"])
        assert gone == row["n_repeated"] and len((row["text"] or "").split()) == row["n_words"] - gone


def test_chunks_of_a_document_do_not_depend_on_its_neighbours():
    random.seed(4)
    for _ in range(300):
        docs = [mix64(np.array([random.randrange(10**6) for _ in range(random.randint(1, 30))], dtype=np.uint64)) for _ in range(3)]
        doc = np.repeat(np.arange(3), [len(d) for d in docs])
        begins, digests = chunks(np.concatenate(docs), doc)
        for k, alone in enumerate(docs):
            first = np.searchsorted(doc, k)
            own = doc[begins] == k
            want = chunks(alone, np.zeros(len(alone), np.int64))
            assert (begins[own] - first).tolist() == want[0].tolist() and digests[own].tolist() == want[1].tolist()


def test_short_exact_copies_go_wholly_under_any_layout(spark, frame):
    random.seed(5)

    def words(n):
        return " ".join("".join(random.choice("abcdefghij") for _ in range(6)) for _ in range(n))

    short = [words(n) for n in range(20, 40) for _ in range(5)]
    rows = [(i, text) for i, text in enumerate(short)] + [(1000 + i, text) for i, text in enumerate(short)]
    rows += [(2000 + i, words(random.randint(1, 60))) for i in range(150)]
    random.shuffle(rows)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, results = spark.conf.get(name), []
    try:
        for parts, size in ((1, 500), (7, 3)):
            spark.conf.set(name, str(size))
            results.append(sorted(drop_repeats(frame(rows, "doc_id long, text string", parts)).collect()))
    finally:
        spark.conf.set(name, before)
    assert results[0] == results[1]
    got = {r["doc_id"]: r for r in results[0]}
    for i, text in enumerate(short):
        assert sorted([got[i]["text"], got[1000 + i]["text"]]) == ["", text]
