import hashlib
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from worksignal.llm.pieces import Encoder, PieceModel, decode, encode, encode_and_decode, op4_sentencepiece, read_model  # noqa: E402

from .conftest import SF, given_tables  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")
HARD = [
    "", " ", "   ", "a", "▁", " a  b ", "hello world", "aaaaaaaaaaaaaaa", "ababab" * 40, "<s></s><0x41><unk>", "\x00",
    "\r\n\t x", " " * 100 + "x" + " " * 37, "日本語 👍́", "1234567890", "https://example.com/a?b=1&c=2", "é",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    random.seed(4)
    signs = list("aeiouthnsrl  \t\nÉßñ▁.,!0123456789日本👍́")
    made = ["".join(random.choice(signs) for _ in range(random.randint(0, 50))) for _ in range(1500)]
    return HARD + made + [" " * k + w for k in range(1, 40) for w in ("x", "é", "", "the", "👍")]


def test_ids_are_the_librarys(library):
    encoder, every = Encoder(read_model(PATH)), texts()
    flat, counts = encoder.encode(every)
    at = 0
    for text, n in zip(every, counts.tolist()):
        assert flat[at : at + n].tolist() == library.encode(text), repr(text)
        at += n


def test_texts_are_the_librarys_for_any_ids(library):
    import numpy as np

    random.seed(5)
    rows = [[random.randrange(600 if random.random() < 0.7 else 32000) for _ in range(random.randint(0, 9))] for _ in range(3000)]
    model = PieceModel(read_model(PATH))
    data, lengths = model.decode(np.array([i for r in rows for i in r], np.int32), np.array([len(r) for r in rows]))
    data, at = data.tobytes(), 0
    for row, n in zip(rows, lengths.tolist()):
        assert data[at : at + n].decode() == library.decode(row), row
        at += n


def test_frames_keep_extra_columns_and_replace_their_own(frame, library):
    rows = [(1, "the cat", 7), (2, None, None), (2, None, None), (None, "", 3), (3, "word " * 20000, 1)]
    docs = frame(rows, "doc_id long, text string, ids long")
    got = decode(encode(docs, PATH), PATH).collect()
    assert len(got) == len(rows) and sorted(map(repr, got)) == sorted(map(repr, encode_and_decode(docs, PATH).collect()))
    for row in got:
        assert row["ids"] == library.encode(row["text"] or "") and row["decoded"] == (row["text"] or "")
    assert decode(frame([(1, None), (2, [None, 450])], "id int, ids array<int>"), PATH).orderBy("id").collect()[0]["decoded"] == ""
    assert encode(docs.limit(0), PATH).count() == 0


@given_tables
def test_query(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op4_sentencepiece(spark, SF).collect()
    assert len(got) == len(docs)
    for row in got:
        ids = library.encode(docs[row["doc_id"]])
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
