import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import worksignal.llm.collocations as collocations
from worksignal.llm.collocations import OP13_SQL, extend, holds, mine, op13_collocations, places

from .conftest import SF, given_tables

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest, top, per_cent):
    """The rows of `mine` by counting every phrase; rows (lang, text)."""
    counts, total = {}, Counter()
    for lang, text in rows:
        of = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(_LOWER)):
            words = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(words)
            for n in range(1, longest + 1):
                of.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, of in counts.items():
        found = {p: a for p, a in of.items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in found.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    most[p[i : i + n]] = max(most[p[i : i + n]], a)
        kept = []
        for p, a in found.items():
            score, k = min((2000000 * a // (of[p[:k]] + of[p[k:]]), k) for k in range(1, len(p)))
            if 100 * most[p] < per_cent * a:
                kept.append((-score, -a, " ".join(p).encode(), a, of[p[:k]], of[p[k:]], total[lang]))
        for rank, (score, _, phrase, a, left, right, n) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), a, left, right, n, -score))
    return sorted(out)


def corpus(seed, n=120):
    random.seed(seed)
    words = ["a", "B", "ö", "cc", "d-d", " x", "e\x1ce"]
    rows = []
    for i in range(n):
        text = "".join(random.choice(words) + random.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " !"]) for _ in range(random.randrange(0, 40)))
        rows.append((i % 100, random.choice(["en", "en", "fr", None]), text, i, i))
    rows += [(None, "en", None, 0, 0), (None, None, "", 0, 0), (7, "en", "z " * 3000, 0, 0), (7, "en", "z " * 3000, 0, 0), (8, "und", "a b a b", 0, 0)]
    return rows


@pytest.mark.parametrize("shards, part_bytes, held", [(3, 32 << 20, 1 << 19), (5, 300, 50), (1, 1000, 200)])
def test_every_count_is_exact(frame, monkeypatch, shards, part_bytes, held):
    monkeypatch.setattr(collocations, "_PART_BYTES", part_bytes)
    monkeypatch.setattr(collocations, "_HELD", held)
    monkeypatch.setattr(collocations, "_FEWEST", 4)  # a filter that errs often changes nothing
    rows = corpus(shards)
    docs = frame(rows, "doc_id long, lang string, text string, shard int, key int")
    got = mine(docs, least=6, longest=4, top=25, per_cent=80, shards=shards)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute([(r[1], r[2]) for r in rows], 6, 4, 25, 80)


def test_an_empty_table_has_no_phrases(frame):
    docs = frame([(1, "en", "a b")], "doc_id long, lang string, text string")
    assert mine(docs.limit(0)).count() == 0 == mine(docs).count()
    with pytest.raises(ValueError):
        mine(docs, longest=1)


def test_large_counts_stay_exact(spark):
    big = 7 * 10**15
    rows = [("en", b"A" * 8, big + 3), ("en", b"B" * 8, big), ("en", b"A" * 8 + b"B" * 8, big - 1)]
    cut = collocations.score_cuts(spark.createDataFrame(rows, "lang string, key binary, n long")).collect()
    assert [(r["a"], r["l"], r["r"], r["score"]) for r in cut] == [(big - 1, big + 3, big, 2000000 * (big - 1) // (2 * big + 3))]


def test_filters_hold_all_they_were_given():
    codes = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)
    hashes = extend(np.zeros_like(codes), codes)
    words = np.zeros(1024, dtype=np.uint64)
    at, bits = places(hashes[:400], 1024)
    np.bitwise_or.at(words, at, bits)
    assert holds(words, hashes[:400]).all() and holds(words, hashes[400:]).mean() < 0.2
    assert not holds(np.zeros(0, np.uint64), hashes).any()


@given_tables
def test_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(tuple(r) for r in op13_collocations(spark, SF).collect()) == sorted(con.execute(OP13_SQL).fetchall())
