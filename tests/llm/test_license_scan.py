import itertools
import random

import pytest

from worksignal.llm.license_scan import _increasing, align, op2_license_scan, prepare, scan, words_of
from worksignal.llm.license_templates import TEMPLATES

from .conftest import SF, given_tables

TEXT = dict(TEMPLATES)
NOTICES = {name: text for name, text in TEMPLATES if name.endswith("notice")}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_longest_increasing_subsequence():
    random.seed(1)
    for _ in range(200):
        places = random.sample(range(20), random.randint(0, 8))
        best = max((len(c) for n in range(len(places) + 1) for c in itertools.combinations(places, n) if list(c) == sorted(c)), default=0)
        got = [places[i] for i in _increasing(places)]
        assert len(got) == best and got == sorted(got)


def test_alignment_rises_on_both_sides_and_finds_edited_copies():
    random.seed(2)
    template = words_of(TEXT["MIT"])
    for _ in range(30):
        text = list(template)
        for _ in range(random.randint(0, 25)):
            k = random.randrange(len(text))
            text[k : k + random.randint(0, 1)] = ["inserted%d" % random.randrange(99)]
        pairs = align(text, template)
        assert all(text[i] == template[j] for i, j in pairs)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
        assert 0.95 * lcs(text, template) <= len(pairs) <= lcs(text, template)


def test_telling_words_cannot_all_be_missing():
    for coverage in (0.5, 0.8, 1.0):
        for t in prepare(TEMPLATES, coverage):
            rest = [w for w in t.words if w not in t.places]
            assert len(rest) < coverage * len(t.words)


def test_scan(frame):
    random.seed(3)
    filler = [random.choice(["the", "of", "license", "and", "under", "wood", "river"]) for _ in range(4000)]
    edited = words_of(TEXT["BSD-3-Clause"])
    for k in range(0, len(edited), 12):
        edited[k] = "changed"
    rows = [
        (1, "Copyright 2020 Ada\n\n" + TEXT["MIT"].replace("Software", "Program"), "x"),
        (2, " ".join(filler[:300]) + " " + NOTICES["MIT notice"] + "\n" + NOTICES["MIT notice"], "x"),
        (3, " ".join(filler), "x"), (4, None, "x"), (5, "", "x"), (6, " ".join(edited), None), (None, NOTICES["GPL-3.0 notice"].upper(), "x"),
        (7, NOTICES["Apache-2.0 notice"] + " " + NOTICES["reserved notice"], "x"), (8, "license " * 20000, "x"), (2, "released under a license", "x"),
    ]
    docs = frame(rows, "doc_id long, text string, license string")
    got = scan(docs).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["n_words"]): r for r in got}
    found = {r["doc_id"]: r["license"] for r in got if r["license"]}
    assert found == {1: "MIT", 2: "MIT notice", 6: "BSD-3-Clause", None: "GPL-3.0 notice", 7: "Apache-2.0 notice"}
    two = by[2, 310]
    assert (two["coverage"], two["first_word"], two["n_spanned"]) == (1.0, 300, 5)
    assert [x["name"] for x in by[7, 11]["licenses"]] == ["Apache-2.0 notice", "reserved notice"]
    assert all(r["licenses"] == [] and r["coverage"] is None for r in got if r["license"] is None)
    assert scan(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        scan(docs, [("x", "y")] * 1001)


@given_tables
def test_query_finds_the_planted_notices_and_nothing_else(spark):
    docs = {r["doc_id"]: words_of(r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op2_license_scan(spark, SF).collect()
    assert len(got) == len(docs) and any(r["license"] for r in got)
    for row in got:
        text = f" {' '.join(docs[row['doc_id']])} "
        assert row["n_words"] == len(docs[row["doc_id"]])
        exact = {name for name, t in TEMPLATES if f" {' '.join(words_of(t))} " in text}
        assert exact == {x["name"] for x in row["licenses"] if x["coverage"] == 1.0}


NEAR_MISSES = [
    ("Released under the BSD License.", "BSD notice"), ("Released under the XYZ License.", None),
    ("Licensed under CC BY 4.0.", "CC-BY-4.0 notice"), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0 notice"),
    ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0 notice"), ("Licensed under CC BY-NC 3.0.", None),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0 notice"),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0 notice"),
    ("This work is licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1 notice"),
    ("Licensed under the Apache License, Version 1.1.", None), ("All rights are reserved.", None),
    ("Released under the terms of the MIT License.", "MIT notice"), ("Released under an MIT License.", "MIT notice"),
    (TEXT["GPL-3.0 header"].replace("version 3", "version 2"), None),
    (TEXT["GPL-3.0 header"].replace("GNU General", "GNU Lesser General"), None),
]


def test_near_misses_are_not_taken_for_their_siblings(frame):
    rows = [(i, f"river {text} wood") for i, (text, _) in enumerate(NEAR_MISSES)]
    got = {r["doc_id"]: [x["name"] for x in r["licenses"]] for r in scan(frame(rows, "doc_id long, text string")).collect()}
    assert got == {i: [name] if name else [] for i, (_, name) in enumerate(NEAR_MISSES)}
