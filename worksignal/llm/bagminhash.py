"""Near-duplicate documents by BagMinHash signatures of word shingles, banding and verification.

A shingle that occurs w times has weight w. Every shingle owns one Poisson process over (weight
level, time); its weight levels are cut into intervals that double in width, each with its own
arrivals in time order, so a heavy shingle costs a few intervals and not w hashes. A point below
the shingle's weight counts for the signature place it names, and the earliest time wins. Two
documents agree in a place with the probability of their weighted Jaccard similarity. A process
stops once its next arrival lies after every place's time, so most give one point.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksignal.llm.components import components
from worksignal.llm.words import blocks, columns_of, mix64, small_batches, windows
from worksignal.session import release, settle

N_WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SMALL, _CHUNK_DOCS, _CHUNK_CHARS = 16, 512, 1 << 19


def bag(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document with their counts: (shingle, document, count)."""
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return hashes[at], doc[at], np.diff(np.append(at, len(hashes)))


def signatures(shingle: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, places: int) -> np.ndarray:
    """(n_docs, places) earliest times; infinity throughout for a document without shingles."""
    least = np.full(n_docs * places, np.inf)
    # Intervals [0, 1), [1, 2), [2, 4), ... of the weights; one stream for each that a weight reaches.
    n_intervals = np.ceil(np.log2(weight)).astype(np.int64) + 1
    of = np.repeat(np.arange(len(shingle)), n_intervals)
    interval = np.arange(len(of)) - np.repeat(np.cumsum(n_intervals) - n_intervals, n_intervals)
    low = np.where(interval == 0, 0.0, np.exp2(np.maximum(interval, 1) - 1.0))
    width = np.maximum(low, 1.0)
    seed = mix64(shingle[of] + interval.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    owner, top, time = doc[of], weight[of].astype(float), np.zeros(len(of))
    step, q = 1, 1
    while len(seed):
        ks = np.arange(step, step + q, dtype=np.uint64)
        random = mix64(seed[:, None] + ks[None, :] * _STEP)
        waits = -np.log(((random >> np.uint64(11)).astype(float) + 1.0) * 2.0**-53) / width[:, None]
        waits[:, 0] += time
        times = np.cumsum(waits, axis=1)
        second = mix64(random ^ np.uint64(0xA5A5A5A55A5A5A5A))
        level = low[:, None] + width[:, None] * ((second & np.uint64(0xFFFFFFFF)).astype(float) * 2.0**-32)
        place = ((second >> np.uint64(32)) % np.uint64(places)).astype(np.int64) + owner[:, None] * places
        counted = level < top[:, None]
        np.minimum.at(least, place[counted], times[counted])
        time = times[:, -1]
        last = least.reshape(n_docs, places).max(axis=1)
        active = time < last[owner]
        seed, owner, top, time, low, width = (x[active] for x in (seed, owner, top, time, low, width))
        step += q
        q = int(np.clip(200_000 // max(1, len(seed)), 1, 32)) if step > 2 else 1
    return least.reshape(n_docs, places)


def band_codes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit code of each band, other bands having other codes."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), bands)).copy()
    for k in range(rows):
        out = mix64(out * _STEP + bits[:, :, k])
    return out.view(np.int64)


def _signer(bands: int, rows: int, n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            codes, counts = [np.zeros((0, bands), np.int64)], np.zeros(len(texts), np.int64)
            keys = []
            for block in blocks(texts):
                n = len(block.offsets) - 1
                shingle, doc, weight = bag(*windows(block.hashes, block.doc, n_words))
                full = np.bincount(doc, minlength=n) > 0
                codes.append(band_codes(signatures(shingle, doc, weight, n, bands * rows)[full], bands, rows))
                counts[block.first : block.first + n] = full * bands
                view = memoryview(block.data)
                keys += [hashlib.md5(view[a:b]).digest() for a, b in zip(block.offsets[:-1], block.offsets[1:])]
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(codes).reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), lists], ["doc_id", "key", "bands"]
            )

    return run


def elements(texts: pa.Array, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The bags of all texts as sets: (element, text), an element being a shingle and which occurrence of it."""
    out, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for block in blocks(texts):
        shingle, doc, count = bag(*windows(block.hashes, block.doc, n_words))
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        out.append(mix64(np.repeat(shingle, count) + nth.astype(np.uint64) * _STEP))
        owner.append(np.repeat(doc, count) + block.first)
    return np.concatenate(out), np.concatenate(owner)


def pair_similarities(left: pa.Array, right: pa.Array, n_words: int) -> np.ndarray:
    """Weighted Jaccard similarity of the bags of each pair of texts."""
    a, pa_ = elements(left, n_words)
    b, pb = elements(right, n_words)
    n = len(left)
    na, nb = np.bincount(pa_, minlength=n), np.bincount(pb, minlength=n)
    pair, element = np.concatenate([pa_, pb]), np.concatenate([a, b])
    order = np.lexsort((element, pair))
    pair, element = pair[order], element[order]
    both = (pair[1:] == pair[:-1]) & (element[1:] == element[:-1])
    shared = np.bincount(pair[1:][both], minlength=n)
    return shared / np.maximum(na + nb - shared, 1)


def _verified(pairs: DataFrame, texts: DataFrame, n_words: int, similarity: float) -> DataFrame:
    """Pairs (a, b) whose texts are similar enough."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 64):
                part = batch.slice(k, 64)
                found = pair_similarities(part.column(2), part.column(3), n_words) >= similarity
                yield part.select(["a", "b"]).filter(pa.array(found))

    return joined.mapInArrow(run, "a long, b long")


def _centres(entries: DataFrame) -> DataFrame:
    """Adds to (code, node, degree) the bucket's member that meets most others over all bands."""
    best = entries.groupBy("code").agg(F.max(F.struct("degree", (-F.col("node")).alias("n"))).alias("m"))
    return entries.join(best.select("code", (-F.col("m.n")).alias("centre")), "code")


def _block_links(frame: pd.DataFrame, n_words: int, similarity: float) -> pd.DataFrame:
    """Links between members of two chunks of one bucket, as a spanning forest.

    A pair counts here only if this is the first band it meets in and its components differ.
    """
    frame = frame.drop_duplicates("node").reset_index(drop=True)
    i, j, band = frame["i"].iat[0], frame["j"].iat[0], frame["band"].iat[0]
    codes = np.stack(frame["bands"].to_numpy())
    rows, cols = (np.flatnonzero(frame["chunk"].to_numpy() == k) for k in (i, j))
    comp = frame["comp"].to_numpy()
    todo = comp[rows][:, None] != comp[cols][None, :]
    for k in range(band):
        todo &= codes[rows, k][:, None] != codes[cols, k][None, :]
    out = np.zeros((0, 2), np.int64)
    if todo.any():
        element, owner = elements(pa.array(frame["text"], pa.string()), n_words)
        size = np.bincount(owner, minlength=len(frame))
        _, element, times = np.unique(element, return_inverse=True, return_counts=True)
        shared_by = times[element] > 1
        _, column = np.unique(element[shared_by], return_inverse=True)
        owner = owner[shared_by]
        shared = np.zeros((len(rows), len(cols)), np.float32)
        for low in range(0, int(column.max(initial=-1)) + 1, 4096):
            at = (column >= low) & (column < low + 4096)
            table = np.zeros((len(frame), 4096), np.float32)
            table[owner[at], column[at] - low] = 1
            shared += table[rows] @ table[cols].T
        total = size[rows][:, None] + size[cols][None, :] - shared
        x, y = np.nonzero(todo & (shared >= similarity * total))
        out = _forest(frame["node"].to_numpy(), rows[x], cols[y])
    return pd.DataFrame(out, columns=["a", "b"])


def _forest(nodes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Edges (node, node) that connect what the pairs connect, one less than nodes at most."""
    root = list(range(len(nodes)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    kept = []
    for a, b in zip(x.tolist(), y.tolist()):
        ra, rb = find(a), find(b)
        if ra != rb:
            root[ra] = rb
            kept.append((nodes[a], nodes[b]))
    return np.array(kept, dtype=np.int64).reshape(-1, 2)


def _large_buckets(mixed: DataFrame, texts: DataFrame, reps: DataFrame, n_words: int, similarity: float) -> DataFrame:
    """Links inside buckets of any size: chunks of bounded texts, each pair of chunks a group of its own."""
    sized = texts.select("node", "text", F.length("text").alias("chars"))
    slim = mixed.join(sized.select("node", "chars"), "node")
    k = F.ceil(F.greatest(F.count(F.lit(1)) / _CHUNK_DOCS, F.sum("chars") / _CHUNK_CHARS)).cast("int")
    chunks = slim.groupBy("code").agg(k.alias("k"))
    placed = mixed.join(chunks, "code").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    spread = placed.withColumn("other", other).select(
        "code", "band", "node", "comp", "chunk",
        F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
    )
    full = spread.join(texts.select("node", "text"), "node").join(reps.select("node", "bands"), "node")
    return full.groupBy("code", "i", "j").applyInPandas(lambda f: _block_links(f, n_words, similarity), "a long, b long")


def near_duplicates(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    n_words: int = N_WORDS,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """(doc_id, class_id, kept) of documents (doc_id, text): the class is the least doc_id of texts linked.

    Texts whose bags of n_words-word shingles have a weighted Jaccard similarity of `similarity` or
    more are linked, words being compared with A-Z folded; every link that shares a band is verified
    on the whole texts. Equal texts are one node, and of the rest only what can still join two
    components is compared: first with each bucket's best-connected member, then exactly.

    A NULL text and one without words link with nothing. A text of fewer words than n_words is one
    shingle. Rows of one doc_id are one document, and all of them are kept or none; a row with a
    NULL doc_id has a NULL class and is kept. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    docs = columns_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = settle(docs.mapInArrow(_signer(bands, rows, n_words), "doc_id long, key binary, bands array<long>"))
    reps = settle(
        signed.filter("doc_id IS NOT NULL AND size(bands) > 0")
        .groupBy("key")
        .agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    )
    entries = reps.select("node", F.posexplode("bands").alias("band", "code"))
    shared = entries.groupBy("code").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    entries = settle(entries.join(shared, "code"))
    degrees = entries.groupBy("node").agg(F.sum("n").alias("degree"))
    nodes = degrees.select("node").join(reps.select("node", "key"), "node")
    keyed = docs.withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    texts = settle(
        keyed.join(nodes.withColumnRenamed("node", "doc_id"), ["doc_id", "key"])
        .dropDuplicates(["doc_id", "key"])
        .select(F.col("doc_id").alias("node"), "text")
    )
    starred = _centres(entries.join(degrees, "node"))
    pairs = starred.filter("node <> centre").select(
        F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")
    ).distinct()
    links = settle(_verified(pairs, texts, n_words, similarity))
    release(docs.sparkSession)
    labels = components(links)
    labelled = entries.join(labels, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    several = labelled.groupBy("code").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    mixed = settle(labelled.join(several.select("code"), "code").select("code", "band", "node", "comp", "n"))
    small = mixed.filter(F.col("n") <= _SMALL).select("code", "node", "comp")
    other = small.select("code", F.col("node").alias("b"), F.col("comp").alias("comp_b"))
    near = small.withColumnRenamed("node", "a").join(other, "code").filter("a < b AND comp <> comp_b")
    near = near.select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
    release(docs.sparkSession)
    found = [links, _verified(near, texts, n_words, similarity)]
    found.append(_large_buckets(mixed.filter(F.col("n") > _SMALL), texts, reps, n_words, similarity))
    linked = found[0].union(found[1]).union(found[2])
    classes = components(linked).select("node", F.col("component").alias("class_id"))
    classes = reps.select("key", "node").join(classes, "node", "left").select(
        "key", F.coalesce("class_id", "node").alias("class_id")
    )
    out = signed.select("doc_id", "key", (F.size("bands") > 0).alias("worded")).join(classes, "key", "left")
    out = out.withColumn(
        "class_id", F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("worded"), F.col("class_id")).otherwise(F.col("doc_id"))
    )
    return out.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def op3_bagminhash(spark, sf_dir: str) -> DataFrame:
    """The class of every document among all near copies."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
