import re

import numpy as np
import pyarrow as pa

from worksignal.llm.words import WORD, blocks, windows

TEXTS = ["", None, "one", "  two  Words\t\n", "é ß 日本 x\x0by", "a" * 3000 + " b", "same same", "SAME same", " "]


def spoken(limit):
    out = {}
    for block in blocks(pa.array(TEXTS, pa.string()), limit=limit):
        for begin, end, doc, code in zip(block.begins, block.ends, block.doc, block.hashes):
            out.setdefault(block.first + int(doc), []).append((bytes(block.data[begin:end]).decode(), int(code)))
    return out


def test_words_are_those_of_the_pattern_whatever_the_block():
    want = {i: re.findall(WORD, t) for i, t in enumerate(TEXTS) if t and re.findall(WORD, t)}
    whole, cut = spoken(1 << 20), spoken(8)
    assert {i: [w for w, _ in ws] for i, ws in whole.items()} == want
    assert whole == cut


def test_hashes_fold_ascii_only():
    found = spoken(1 << 20)
    assert found[6][0][1] == found[7][0][1]
    assert len({c for ws in found.values() for _, c in ws}) == len({w.lower() for ws in want_words() for w in ws})


def want_words():
    return [re.findall(WORD, t) for t in TEXTS if t]


def test_windows_of_a_sliced_column():
    column = pa.array(["x y z w v u", "a b c", "a b c", None, "d"], pa.string()).slice(1)
    (block,) = blocks(column)
    codes, doc = windows(block.hashes, block.doc, 5)
    assert doc.tolist() == [0, 1, 3]
    assert codes[0] == codes[1] != codes[2]
    assert np.array_equal(windows(block.hashes, block.doc, 2)[1], [0, 0, 1, 1, 3])
