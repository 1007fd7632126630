import random
import zlib

import numpy as np

from worksignal.llm.language_id import build_filters, identify, letters, ngrams, op5_language_id, scores, train

from .conftest import SF, given_tables


def test_filters_hold_all_and_little_else():
    random.seed(1)
    codes = np.array([random.getrandbits(64) for _ in range(4000)], dtype=np.uint64)
    lang = np.array([random.randrange(3) for _ in range(4000)])
    model = build_filters(["a", "b", "c"], codes, lang)
    from worksignal.llm.language_id import _slots

    def languages(code):
        slots = _slots(np.array([code], dtype=np.uint64), len(model.masks))
        return int(np.bitwise_and.reduce([model.masks[s] for s in slots])[0])

    assert all(languages(c) >> int(k) & 1 for c, k in zip(codes[:500], lang))
    strangers = [languages(random.getrandbits(64)) for _ in range(3000)]
    for k in range(3):
        assert abs(np.mean([s >> k & 1 for s in strangers]) - model.by_chance[k]) < 0.01


def test_ngrams_of_letters_only():
    table = letters()
    a, doc = ngrams(["Ab, cd!", "", "  ab CD  ", "é", "123"], table)
    assert sorted(a[doc == 0]) == sorted(a[doc == 2]) and set(doc.tolist()) == {0, 2, 3}
    wide, owner = ngrams(["x" * 3 + "y"] * 3, table)
    assert len(wide) == 3 * 5 and sorted(set(owner.tolist())) == [0, 1, 2]


def test_frames(frame):
    random.seed(2)
    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["grüße", "welt", "haus"]}
    rows = [(i, " ".join(random.choice(words[k]) for _ in range(30)), k, 0.5) for i in range(40) for k in words]
    rows += [(100, None, "aa", 0.0), (101, "1234 !", "bb", 0.0), (102, "haus", None, 0.0), (None, "LOREM", None, 0.0)]
    docs = frame(rows, "doc_id long, text string, lang string, score double")
    model = train(docs)
    got = identify(docs, model).collect()
    assert len(got) == len(rows)
    for row in got:
        assert 0 <= row["score"] <= 1
        if row["doc_id"] in (100, 101):
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
        else:
            assert row["lang_pred"] == (row["lang"] or {102: "bb", None: "aa"}[row["doc_id"]])
    nothing = train(docs.limit(0))
    assert {r["lang_pred"] for r in identify(docs, nothing).collect()} == {"und"}
    share, known = scores(model, ["lorem ipsum", "?"], letters())
    assert known.tolist() == [True, False] and share[0, 0] > 0.9 > share[0, 1]


@given_tables
def test_query_on_held_out_documents(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op5_language_id(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"] and lang[r["doc_id"]]]
    assert len(got) == len(lang) and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) >= 0.95
