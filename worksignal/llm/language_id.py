"""Language identification by bit-sliced Bloom filters of character n-grams.

One table of bit masks holds a Bloom filter for every language: bit l of a slot belongs to language
l. The masks at an n-gram's slots, ANDed, name all languages that have it. A text's count for each
language, less what the filter finds by chance, decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksignal.llm.words import mix64, powers, remainder, small_batches
from worksignal.session import settle

N, HASHES = 4, 3
#: An n-gram is a language's own from this share of its n-grams on, so no language has more than 1 / LEAST_RATE.
LEAST_RATE = 2e-5
#: ... and from this part of the rate it has where it is most frequent.
LEAST_PART = 0.25
MAX_LANGUAGES = 64
UNKNOWN = "und"
_BLOCK_CHARS = 1 << 19
_COMPACT = 1 << 21


class LanguageModel(NamedTuple):
    languages: list[str]
    masks: np.ndarray  # by slot, a power of two of them
    by_chance: np.ndarray  # false-positive rate of each language


def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngrams(texts: list[str], letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all n-grams of the lower-cased texts; what is no letter is one space between words."""
    lowered = [t.lower() for t in texts]
    chars = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    is_letter = letter[chars]
    kept = is_letter.copy()
    kept[1:] |= is_letter[:-1] & (doc[1:] == doc[:-1])
    chars, doc, is_letter = np.where(is_letter, chars, 32)[kept], doc[kept], is_letter[kept]
    pad = N - 2
    counts = np.bincount(doc, minlength=len(texts))
    padded = counts + 2 * pad * (counts > 0)
    begins = np.cumsum(padded) - padded
    flat, real = np.full(int(padded.sum()), 32, dtype=np.uint64), np.zeros(int(padded.sum()), dtype=bool)
    at = np.arange(len(chars)) + (begins + pad - (np.cumsum(counts) - counts))[doc]
    flat[at], real[at] = chars, is_letter
    owner = np.repeat(np.arange(len(texts)), padded)
    left = np.repeat(begins + padded, padded) - np.arange(len(flat))
    starts = left >= N
    size = len(flat) - N + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    flat = mix64(flat)
    up, _ = powers(N)
    code, some = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=bool)
    for k in range(N):
        code += flat[k : k + size] * up[k + 1]
        some |= real[k : k + size]
    chosen = starts[:size] & some
    return mix64(code[chosen]), owner[:size][chosen]


def _blocks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    first, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= _BLOCK_CHARS:
            yield first, texts[first : k + 1]
            first, size = k + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def _count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, code, n) of a task's texts, each n-gram once a language where memory allows."""
    letter = letters()
    held: dict[str, list] = {}
    sizes: dict[str, int] = {}

    def compact(lang):
        codes = np.concatenate([c for c, _ in held[lang]])
        counts = np.concatenate([n for _, n in held[lang]])
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order]
        new = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        held[lang] = [(codes[new], np.add.reduceat(counts, new))]
        sizes[lang] = 0

    def rows(lang):
        compact(lang)
        codes, counts = held.pop(lang)[0]
        return pa.RecordBatch.from_arrays(
            [pa.array([lang]).take(pa.array(np.zeros(len(codes), np.int32))), pa.array(codes.view(np.int64)), pa.array(counts)],
            ["lang", "code", "n"],
        )

    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), dtype=object)
        texts = batch.column(0).to_pylist()
        for lang in sorted(set(langs)):
            own = [texts[i] for i in np.flatnonzero(langs == lang)]
            for _, block in _blocks(own):
                codes, _ = ngrams(block, letter)
                if not len(codes):
                    continue
                codes, counts = np.unique(codes, return_counts=True)
                held.setdefault(lang, []).append((codes, counts))
                sizes[lang] = sizes.get(lang, 0) + len(codes)
                if sizes[lang] > _COMPACT:
                    compact(lang)
                    if len(held[lang][0][0]) > 2 * _COMPACT:
                        yield rows(lang)
    for lang in sorted(held):
        yield rows(lang)


def train(docs: DataFrame) -> LanguageModel:
    """Learns from text and lang; rows with a NULL in either are left out. All rows count.

    The driver receives n-grams above LEAST_RATE only, 1 / LEAST_RATE a language at most.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    counted = rows.mapInArrow(_count_ngrams, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    counted = settle(counted)
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    languages = [r["lang"] for r in totals.select("lang").orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"at most {MAX_LANGUAGES} languages")
    rate = F.col("n") / F.col("total")
    frequent = counted.join(totals, "lang").select("lang", "code", rate.alias("rate")).filter(F.col("rate") >= LEAST_RATE)
    found = frequent.toPandas()
    most = found.groupby("code")["rate"].transform("max")
    found = found[found["rate"] >= LEAST_PART * most]
    codes = found["code"].to_numpy(dtype=np.int64).view(np.uint64)
    lang = found["lang"].map({name: k for k, name in enumerate(languages)}).to_numpy(dtype=np.int64)
    return build_filters(languages, codes, lang)


def build_filters(languages: list[str], codes: np.ndarray, lang: np.ndarray) -> LanguageModel:
    """The filters of the n-grams codes[k] of the languages lang[k]."""
    largest = int(np.bincount(lang, minlength=1).max(initial=1)) if len(lang) else 1
    size = 1 << max(10, (10 * largest).bit_length())
    kind = np.dtype("u1") if len(languages) <= 8 else np.dtype("u8")
    masks = np.zeros(size, dtype=kind)
    for slot in _slots(codes, size):
        np.bitwise_or.at(masks, slot, np.left_shift(np.ones(len(lang), kind), lang.astype(kind)))
    fill = np.array([((masks >> kind.type(k)) & kind.type(1)).mean() for k in range(len(languages))])
    return LanguageModel(languages, masks, fill**HASHES)


def _slots(codes: np.ndarray, size: int) -> list[np.ndarray]:
    return [(codes >> np.uint64(21 * k)).astype(np.int64) & (size - 1) for k in range(HASHES)]


def scores(model: LanguageModel, texts: list[str], letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(share of each text's n-grams that each language has, corrected), and whether the text has any."""
    codes, doc = ngrams(texts, letter)
    slots = _slots(codes, len(model.masks))
    masks = model.masks[slots[0]]
    for slot in slots[1:]:
        masks &= model.masks[slot]
    n = np.bincount(doc, minlength=len(texts))
    out = np.zeros((len(texts), len(model.languages)))
    for k, chance in enumerate(model.by_chance):
        hits = np.bincount(doc[(masks >> masks.dtype.type(k)) & masks.dtype.type(1) > 0], minlength=len(texts))
        out[:, k] = np.clip((hits / np.maximum(n, 1) - chance) / max(1 - chance, 1e-9), 0, 1)
    return out, n > 0


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Adds lang_pred and score (0 to 1, the share of the text's n-grams that the language has).

    Only the text decides. `und` with score 0 stands for a NULL text, one without a letter, and for
    all if nothing was learned; a tie goes to the lesser name. Extra columns stay, those of the
    added names are replaced.
    """
    small_batches(docs.sparkSession)
    kept = docs.drop("lang_pred", "score")
    place = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = letters()
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            names, best = [], []
            for _, block in _blocks(texts):
                if model.languages:
                    share, known = scores(model, block, letter)
                    top = share.argmax(axis=1)
                    names += [model.languages[k] if ok else UNKNOWN for k, ok in zip(top.tolist(), known.tolist())]
                    best += np.where(known, share.max(axis=1), 0.0).tolist()
                else:
                    names += [UNKNOWN] * len(block)
                    best += [0.0] * len(block)
            columns = [pa.array(names, pa.string()), pa.array(best, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, kept.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.filter(remainder(F.col("doc_id"), 4) != 2))
    asked = docs.select("doc_id", "text", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"))
    return identify(asked, model).select("doc_id", "held_out", "lang_pred", "score")
