"""Repeated passages by content-defined chunks: a gear rolling hash cuts, digests find repeats.

The gear hash runs over words: shift, add the word's value, keep as many bits as there are words in
its window. A cut lies after a word whose hash is the least among its neighbours' in the document, so
cuts depend on the document's text around them only, an insertion moves none but those beside it, and no stretch of text goes
without cuts for long. Only the first occurrence of a chunk stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksignal.llm.names import set_aside
from worksignal.llm.words import blocks, columns_of, mix64, small_batches
from worksignal.session import settle

WINDOW, REACH = 4, 3
MIN_WORDS = 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def gear(hashes: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The rolling hash at each word: the sum of the last `window` words' values, each shifted by its age.

    Each word shifts the older ones out by 64 / window bits. Words of another document add nothing.
    """
    shift = np.uint64(64 // window)
    out = np.zeros(len(hashes), dtype=np.uint64)
    for age in range(window):
        older = len(hashes) - age
        moved = np.zeros_like(out)
        moved[age:] = np.where(doc[age:] == doc[:older], hashes[:older], np.uint64(0))
        out += moved << (shift * np.uint64(age))
    return out


def chunks(hashes: np.ndarray, doc: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """First word of each chunk and its digest. Chunks end with their document and depend on nothing outside it."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), hashes
    rolled = mix64(gear(hashes, doc))
    least = np.ones(n, dtype=bool)
    for k in range(1, reach + 1):
        other = doc[k:] != doc[:-k]
        least[k:] &= (rolled[k:] < rolled[:-k]) | other
        least[:-k] &= (rolled[:-k] <= rolled[k:]) | other
    cut = np.zeros(n, dtype=bool)
    cut[1:] = least[:-1]
    cut[0] = True
    cut[1:] |= doc[1:] != doc[:-1]
    begins = np.flatnonzero(cut)
    place = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
    digest = np.add.reduceat(mix64(hashes + place.astype(np.uint64) * _BASE), begins)
    return begins, mix64(digest)


def _row_key(*columns) -> F.Column:
    return F.xxhash64(*columns)


def _chunker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        for block in blocks(batch.column(1)):
            begins, digest = chunks(block.hashes, block.doc)
            doc = block.doc[begins]
            first = np.searchsorted(block.doc, doc, "left")
            size = np.diff(np.append(begins, len(block.hashes)))
            at = np.minimum(begins - first, (1 << 31) - 1) << 31 | size
            yield pa.RecordBatch.from_arrays(
                [pa.array(digest.view(np.int64)), pa.array(keys[doc + block.first]), pa.array(at)], ["digest", "key", "at"]
            )


def _cutter(min_words: int, places: tuple[int, int], names: list[str]):
    """Removes the passages from texts; a text without any stays as it is."""

    def passages(block, doc, found):
        begin = np.searchsorted(block.doc, doc, "left")
        out = []
        found = sorted(found)
        k = 0
        while k < len(found):
            low, high = found[k] >> 31, (found[k] >> 31) + (found[k] & (1 << 31) - 1)
            k += 1
            while k < len(found) and found[k] >> 31 == high:
                high += found[k] & (1 << 31) - 1
                k += 1
            if high - low >= min_words:
                base = block.offsets[doc]
                out.append((low, high, int(block.begins[begin + low] - base), int(block.ends[begin + high - 1] - base)))
        return out

    def without(data, spans):
        kept, at = [], 0
        for _, _, a, b in spans:
            # White space before a passage goes with it where other white space or the end follows.
            part = data[at:a]
            kept.append(part.rstrip(b" \t\n\x0b\x0c\r") if b == len(data) or at == a else part)
            at = b
            if not part or part[-1:] in b" \t\n\x0b\x0c\r":
                while at < len(data) and data[at : at + 1] in (b" ", b"\t"):
                    at += 1
        kept.append(data[at:])
        return b"".join(kept).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_at, found_at = places
        for batch in batches:
            found = batch.column(found_at).to_pylist()
            texts, words, gone, spans = batch.column(text_at).to_pylist(), [], [], []
            for block in blocks(batch.column(text_at)):
                counts = np.bincount(block.doc, minlength=len(block.offsets) - 1)
                for doc, count in enumerate(counts.tolist()):
                    row = block.first + doc
                    cut = passages(block, doc, found[row]) if found[row] else []
                    if cut:
                        texts[row] = without(bytes(block.data[block.offsets[doc] : block.offsets[doc + 1]]), cut)
                    words.append(count)
                    gone.append(sum(b - a for a, b, _, _ in cut))
                    spans.append([{"first_word": a, "n_words": b - a} for a, b, _, _ in cut])
            columns = [c for i, c in enumerate(batch.columns) if i not in places]
            span = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64())]))
            columns += [pa.array(texts, pa.string()), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Documents (doc_id, text) without repeated passages; adds n_words, n_repeated and passages.

    A chunk that occurred before, in another document or earlier in the same one, is a repeat;
    consecutive repeats of `min_words` words or more together are cut from the text, with nothing
    else changed but the white space that would double. `passages` lists them by first word and
    number of words, `n_repeated` counts their words. The occurrence that stays is the first in the
    order of the documents' digests. Words are compared with A-Z folded.

    Rows alike in doc_id and text are one document. NULL and empty texts stay and hold nothing; a
    NULL doc_id is an id like others. Extra columns stay, those of the added names are replaced.
    """
    small_batches(docs.sparkSession)
    added = ["n_words", "n_repeated", "passages"]
    docs, restored = set_aside(docs, "key", "__key", "__found")
    keyed = docs.drop(*added).withColumn("__key", _row_key("doc_id", "text"))
    every = keyed.select("__key", "text").mapInArrow(_chunker, "digest long, key long, at long")
    firsts = every.groupBy("digest").agg(F.min(F.struct("key", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = settle(firsts.filter("n > 1").select("digest", "first"))
    again = every.join(firsts, "digest").filter(F.struct("key", "at") != F.col("first"))
    found = again.groupBy("key").agg(F.collect_set("at").alias("__found"))
    joined = keyed.join(found, F.col("__key") == F.col("key"), "left").drop("key", "__key")
    rest = [c for c in joined.columns if c not in ("text", "__found")]
    out = [*rest, "text", *added]
    schema = joined.select(
        *[F.col(f"`{c}`") for c in rest], "text", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_repeated"),
        F.expr("cast(array() as array<struct<first_word:bigint,n_words:bigint>>)").alias("passages"),
    ).schema
    places = tuple(joined.columns.index(c) for c in ("text", "__found"))
    cut = joined.mapInArrow(_cutter(min_words, places, out), schema)
    return restored(cut.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added], *added))


def op10_chunking(spark, sf_dir: str) -> DataFrame:
    """Every document without the passages that occurred before."""
    docs = columns_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return drop_repeats(docs).select("doc_id", "n_words", "n_repeated", "passages", "text")
