import collections

from pyspark.sql import functions as F

import corpus_pipeline
from worksignal.llm.pieces import decode

from .conftest import SF, given_tables
from .test_bagminhash import classes


def stages(spark, docs):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


@given_tables
def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start, known, single, cut, mixed, ended = stages(spark, docs)
    assert known.columns == single.columns == cut.columns == mixed.columns == docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = {r["doc_id"] for r in known.collect()}
    assert kept == {i for i, r in rows.items() if any(c.isalpha() for c in r["text"])}
    group = classes([(i, rows[i]["text"]) for i in kept])
    assert {r["doc_id"] for r in single.collect()} == set(group.values()) == {i for i in group if group[i] == i}
    for row in cut.collect():
        assert row["n_chars"] == len(row["text"]) and collections.Counter(row["text"].split()) <= collections.Counter(rows[row["doc_id"]]["text"].split())
    total = sum(len(r["text"].split()) for r in cut.collect())
    times = collections.Counter(r["doc_id"] for r in mixed.collect())
    taken = sum(len(r["text"].split()) * times[r["doc_id"]] for r in cut.collect())
    assert max(times.values()) <= 2 and abs(taken - 1.5 * total) < 0.1 * total
    assert ended.filter("NOT exact").count() == 0 and ended.count() == mixed.count()


def test_odd_documents_pass(frame, spark):
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (3, "1 2 3", "en", "a", 5), (None, "the same words again here", "en", "a", 1)]
    rows += [(4, "the other words are here now", "en", "b", 1)] * 2 + [(5, "the words", "en", "b", 1)]
    docs = frame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    *_, mixed, ended = stages(spark, docs)
    assert ended.filter("NOT exact").count() == 0 and {r["doc_id"] for r in mixed.collect()} <= {None, 4, 5}
    assert stages(spark, docs.limit(0))[-1].count() == 0


@given_tables
def test_run_is_its_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "lang", "source", "ids", "exact"] and got.filter("NOT exact").count() == 0
    import public_tokenizers

    texts = decode(got, public_tokenizers.path("piece_bpe_32k.model"))
    assert texts.filter(F.length("decoded") == 0).count() == 0


def test_texts_that_share_a_doc_id_are_kept_together(frame, spark):
    words = [" ".join(f"{letter}{k}" for k in range(30)) for letter in "abcd"]
    rows = [(1, words[0], "en", "s", 1, "x"), (1, words[1], "en", "s", 1, "x"), (1, words[0], "en", "s", 1, "x"), (2, words[1], "en", "s", 1, "x"),
            (3, words[2], "en", "s", 1, "x"), (None, words[3], None, None, None, "x"), (None, words[3], None, None, None, "x"), (4, None, "en", "s", 0, "x")]
    docs = frame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string")
    got = corpus_pipeline.one_of_each(spark, docs, SF)
    assert got.columns == docs.columns
    found = sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect())
    assert found == sorted([(0, words[3])] * 2 + [(1, words[0]), (1, words[1]), (3, words[2]), (4, "")])
