"""Language-model scores by deleted interpolation of word n-grams.

The probability of a word is a mixture of the maximum-likelihood estimates of its bigram and its
unigram and of a uniform share; the mixture weights depend on how frequent the context is and are
learned by expectation-maximisation on a deleted part of the training documents, with the counts
that remain.

Counting goes by chunks of documents: a chunk sends its distinct words and bigrams once, as sorted
hashes cut into ranges; a range's group sums them over all chunks and answers each chunk with the
totals. So a frequent word costs one entry a chunk, no group grows beyond its range, and nothing of
the vocabulary is broadcast. Words are known by 64-bit hashes, bigrams by 48-bit ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksignal.llm.names import set_aside, unused
from worksignal.llm.words import blocks, mix64, remainder, small_batches
from worksignal.session import fresh_path, settle

_END, _START = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_HELD_TOKENS = 1 << 22
_CHUNK_BYTES = 4 << 20
_STEPS = 4  # of a probability's logarithm in the counts that the mixture is learned from
_REQUEST = "bucket int, chunk long, words binary, word_counts binary, pairs binary, pair_counts binary"
_REPLY = "chunk long, bucket int, words binary, deleted_words binary, pairs binary, deleted_pairs binary, n_types long, n_tokens long"


class Mixture(NamedTuple):
    """Weights of (bigram, unigram, uniform) by the context's frequency class, and the corpus's size."""

    weights: np.ndarray
    tokens: int
    types: int
    deleted_tokens: int


def frequency_class(count: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(1.0 + count)).astype(np.int64)


def _bytes(text: str) -> int:
    """The value of a size setting such as 128MB or 16m."""
    number = text.strip().lower().rstrip("b")
    return int(number[:-1]) << {"k": 10, "m": 20, "g": 30}[number[-1]] if number[-1].isalpha() else int(number)


def pack(values: np.ndarray) -> bytes:
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return bytes([kind.itemsize]) + zlib.compress(values.astype(kind).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), dtype=f"u{data[0]}").astype(np.int64)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending keys as their differences, which are short where keys are many."""
    return pack(np.diff(keys, prepend=keys.dtype.type(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data).view(np.uint64), dtype=np.uint64)


def with_ends(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, context, document) of all documents, each closed by an end and begun by a start."""
    counts = np.bincount(doc, minlength=n_docs)
    token = np.full(len(hashes) + n_docs, _END, dtype=np.uint64)
    context = np.full(len(hashes) + n_docs, _START, dtype=np.uint64)
    at = np.arange(len(hashes)) + doc
    token[at], context[at + 1 - (at + 1 == len(context))] = hashes, hashes
    return token, context, np.repeat(np.arange(n_docs), counts + 1)


def pair_keys(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix64(context * _BASE + token) >> np.uint64(16)


def _bucket_edges(keys: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Where each of n equal ranges of `bits`-bit keys begins, and the end."""
    at = [np.searchsorted(keys, np.uint64(k * (1 << bits) // n)) for k in range(n)]
    return np.array([*at, len(keys)])


def _requests(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def flush():
            out = []
            for chunk, parts in sorted(held.items()):
                token, pair = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
                learned = np.concatenate([p[2] for p in parts])
                words, at = np.unique(token, return_inverse=True)
                word_counts = np.bincount(at, weights=learned, minlength=len(words)).astype(np.int64)
                pairs, at = np.unique(pair, return_inverse=True)
                pair_counts = np.bincount(at, weights=learned, minlength=len(pairs)).astype(np.int64)
                w, p = _bucket_edges(words, 64, n_buckets), _bucket_edges(pairs, 48, n_buckets)
                for b in range(n_buckets):
                    i, j, k, m = w[b], w[b + 1], p[b], p[b + 1]
                    if i < j or k < m:
                        out.append((b, chunk, pack_sorted(words[i:j]), pack(word_counts[i:j]), pack_sorted(pairs[k:m]), pack(pair_counts[k:m])))
            held.clear()
            names = ["bucket", "chunk", "words", "word_counts", "pairs", "pair_counts"]
            kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
            for k in range(0, len(out), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 1000]), kinds)], names)

        for batch in batches:
            chunks = batch.column(0).to_numpy(zero_copy_only=False)
            learn = batch.column(1).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(2)):
                n = len(block.offsets) - 1
                token, context, doc = with_ends(block.hashes, block.doc, n)
                pair, of = pair_keys(context, token), chunks[block.first + doc]
                for chunk in np.unique(of).tolist():
                    own = of == chunk
                    held.setdefault(chunk, []).append((token[own], pair[own], learn[block.first + doc[own]]))
                size += len(token)
            if size > _HELD_TOKENS:
                yield from flush()
                size = 0
        yield from flush()

    return run


def _totals(frame: pd.DataFrame, per_split: int) -> pd.DataFrame:
    """Answers of one range: for each chunk, the totals of its sorted distinct keys, in all and in the deleted part."""

    def answers(keys_of, counts_of):
        keys = [unpack_sorted(k) for k in keys_of]
        counts = np.concatenate([unpack(c) for c in counts_of])
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        ends = np.cumsum([len(k) for k in keys])
        total = np.zeros(len(every), np.int64)
        deleted = np.zeros(len(every), np.int64)
        np.add.at(total, at, counts)
        dropped = np.repeat(chunk % per_split == per_split - 1, [len(k) for k in keys])
        np.add.at(deleted, at[dropped], counts[dropped])
        out = {}
        for c in np.unique(chunk).tolist():
            rows = np.flatnonzero(chunk == c)
            own = at[ends[rows[0]] - len(keys[rows[0]]) : ends[rows[0]]] if len(rows) == 1 else np.unique(
                np.concatenate([at[ends[r] - len(keys[r]) : ends[r]] for r in rows])
            )
            out[c] = (pack(total[own]), pack(deleted[own]) if c % per_split == per_split - 1 else b"")
        return out, int((total > 0).sum()), int(total.sum()), int(deleted.sum())

    chunk = frame["chunk"].to_numpy()
    bucket = int(frame["bucket"].iat[0])
    words, types, tokens, gone = answers(frame["words"], frame["word_counts"])
    pairs, _, _, _ = answers(frame["pairs"], frame["pair_counts"])
    rows = [(c, bucket, *words[c], *pairs[c], 0, 0) for c in words]
    rows += [(-1, bucket, b"", b"", b"", b"", types, tokens), (-2, bucket, b"", b"", b"", b"", 0, gone)]
    return pd.DataFrame(rows, columns=[f.split()[0] for f in _REPLY.split(", ")])


def _pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, rows): the rows of each chunk as compressed Arrow streams, far smaller to shuffle than texts."""
    for batch in batches:
        chunks = batch.column(0).to_numpy(zero_copy_only=False)
        kept = batch.select(batch.schema.names[1:])
        found = np.unique(chunks)
        streams = []
        for chunk in found:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kept.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(kept.filter(pa.array(chunks == chunk)))
            streams.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(streams, pa.binary())], ["chunk", "rows"])


def _unpack_rows(packed: pa.Table) -> pa.Table:
    if not len(packed):
        raise ValueError("the documents changed between two reads; store them first")
    return pa.concat_tables([pa.ipc.open_stream(x.as_py()).read_all() for x in packed.column("rows")])


def _chunk_counts(texts: pa.ChunkedArray, replies: pd.DataFrame, deleted: bool):
    """Counts at each token of a chunk: (document, word, pair, context), with the deleted part's taken off if asked."""
    hashes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for block in blocks(texts):
        hashes.append(block.hashes)
        docs.append(block.doc + block.first)
    token, context, doc = with_ends(np.concatenate(hashes), np.concatenate(docs), len(texts))
    words, at_word = np.unique(token, return_inverse=True)
    pairs, at_pair = np.unique(pair_keys(context, token), return_inverse=True)
    replies = replies.sort_values("bucket")

    def of(column, size):
        counts = np.concatenate([unpack(x) for x in replies[column]])
        if len(counts) != size:
            raise ValueError("the documents changed between two reads; store them first")
        return counts

    word, pair = of("words", len(words)), of("pairs", len(pairs))
    if deleted:
        word, pair = word - of("deleted_words", len(words)), pair - of("deleted_pairs", len(pairs))
    word_counts = word[at_word]
    ends = int(word[np.searchsorted(words, _END)])  # as many starts as ends
    before = np.concatenate([[ends], word_counts[:-1]])
    before[np.concatenate([[True], doc[1:] != doc[:-1]])] = ends
    return doc, word_counts, pair[at_pair], before


def _shares(word, pair, context, tokens):
    return pair / np.maximum(context, 1), word / max(tokens, 1)


def _mixture_counts(rows: pa.Table, replies: pa.Table, tokens: int) -> pa.Table:
    """How many deleted tokens have which context class, bigram share and unigram share, the shares on a fine logarithmic scale."""
    _, word, pair, context = _chunk_counts(_unpack_rows(rows).column("text"), replies.to_pandas(), True)
    two, one = _shares(word, pair, context, tokens)

    def steps(p):
        return np.where(p > 0, 1 + np.round(-_STEPS * np.log2(np.maximum(p, 1e-300))), 0).astype(np.int64)

    rows, n = np.unique(np.stack([frequency_class(context), steps(two), steps(one)]), axis=1, return_counts=True)
    return pa.table({"class": rows[0], "two": rows[1], "one": rows[2], "n": n})


def learn_mixture(counts: pd.DataFrame, types: int, rounds: int = 100, prior: float = 20.0) -> np.ndarray:
    """Weights (64 classes, 3) by expectation-maximisation; a class of few tokens stays near the weights over all."""

    def share(steps):
        return np.where(steps > 0, 2.0 ** (-(steps - 1) / _STEPS), 0.0)

    p = np.stack([share(counts["two"].to_numpy()), share(counts["one"].to_numpy()), np.full(len(counts), 1.0 / (types + 1))])
    n = counts["n"].to_numpy(dtype=float)
    kind = counts["class"].to_numpy()

    def run(kind, n_kinds, start, pull):
        weights = np.repeat(start[None, :], n_kinds, axis=0)
        for _ in range(rounds):
            joint = weights[kind].T * p
            part = n * joint / np.maximum(joint.sum(axis=0), 1e-300)
            sums = np.stack([np.bincount(kind, weights=x, minlength=n_kinds) for x in part], axis=1) + pull * start
            weights = sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-300)
        weights = np.maximum(weights, 1e-6)
        return weights / weights.sum(axis=1, keepdims=True)

    start = np.full(3, 1 / 3)
    if not len(counts):
        return np.repeat(start[None, :], 64, axis=0)
    overall = run(np.zeros(len(kind), np.int64), 1, start, 1e-3)[0]
    return run(kind, 64, overall, prior)


def _scores(rows: pa.Table, replies: pa.Table, mixture: Mixture) -> pa.Table:
    rows = _unpack_rows(rows)
    doc, word, pair, context = _chunk_counts(rows.column("text"), replies.to_pandas(), False)
    two, one = _shares(word, pair, context, mixture.tokens)
    weights = mixture.weights[frequency_class(context)]
    p = weights[:, 0] * two + weights[:, 1] * one + weights[:, 2] / (mixture.types + 1)
    base = np.log10((word + 1.0) / (mixture.tokens + mixture.types + 1.0))
    n = len(rows)
    columns = {name: rows.column(name) for name in rows.column_names if name != "text"}
    columns["n_tokens"] = np.bincount(doc, minlength=n)
    columns["n_known"] = np.bincount(doc[word > 0], minlength=n)
    columns["train_tokens"] = np.full(n, mixture.tokens)
    columns["base_score"] = np.bincount(doc, weights=base, minlength=n)
    columns["score"] = np.bincount(doc, weights=np.log10(p), minlength=n)
    return pa.table(columns)


def score_documents(
    docs: DataFrame, train: Column, deleted: Column, stored: bool = False, chunk_bytes: int = _CHUNK_BYTES
) -> DataFrame:
    """Adds n_tokens, n_known, train_tokens, base_score and score to documents (doc_id, text), without the text.

    `train` says which rows the model learns from (NULL: not), `deleted` which of these the mixture
    is learned on; both are expressions over the rows. `score` is the base-10 logarithm of the
    text's probability, `base_score` that of add-one unigrams. A text's tokens are its words, A-Z
    folded, and one end; a NULL text has the end only. Extra columns stay, those of the added
    names are replaced. Without training rows all words are unknown. An empty table gives an empty one.

    The documents are read several times and must split the same each time; they are written to
    the shared folder first unless `stored` says that they are read from files as they are. Where the
    session leaves `spark.sql.files.minPartitionNum` unset, it is set to the parallelism at hand.

    `chunk_bytes` of input make a chunk. Chunks times ranges is the number of entries sent, and ranges
    grow with the input: for many terabytes, larger chunks (and executors) keep entries from getting small.
    """
    spark = docs.sparkSession
    small_batches(spark)
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    # The conditions are over the columns as they are called; then those called like the operator's own step aside.
    learned, taken_off = unused(docs.columns, "learned", "taken_off")
    rows = docs.withColumn(learned, F.coalesce(train, F.lit(False))).withColumn(taken_off, F.coalesce(deleted, F.lit(False))).drop(*added)
    rows, restored = set_aside(rows, "chunk", "learn", "__deleted")
    rows = rows.withColumn("learn", F.col(learned)).withColumn("__deleted", F.col(learned) & F.col(taken_off)).drop(learned, taken_off)
    if not stored:
        path = fresh_path(spark, "scored-documents")
        rows.write.parquet(path)
        rows = spark.read.parquet(path)
    # How files split must not follow the number of executors, which come and go between the reads.
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    size = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    splits = max(1, -(-size // chunk_bytes))
    per_split = splits + 1  # the last one holds the deleted rows
    part = F.when(F.col("__deleted"), splits).otherwise(F.pmod(F.xxhash64("doc_id", "text"), F.lit(splits)))
    rows = rows.withColumn("chunk", F.spark_partition_id().cast("long") * per_split + part).drop("__deleted")
    n_splits = (rows.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0) + 1
    n_buckets = 2 * n_splits
    asked = rows.select("chunk", "learn", "text").mapInArrow(_requests(n_buckets), _REQUEST)
    answered = asked.groupBy("bucket").applyInPandas(lambda f: _totals(f, per_split), _REPLY)
    replies = settle(answered)
    sums = {r["chunk"]: r for r in replies.filter("chunk < 0").groupBy("chunk").agg(F.sum("n_types").alias("v"), F.sum("n_tokens").alias("n")).collect()}
    tokens, types = (int(sums[-1]["n"]), int(sums[-1]["v"])) if -1 in sums else (0, 0)
    gone = int(sums[-2]["n"]) if -2 in sums else 0
    replies = replies.filter("chunk >= 0").drop("n_types", "n_tokens")
    last = F.col("chunk") % per_split == splits
    names = [c for c in rows.columns if c != "learn" and c != "chunk"]

    def packed(part):
        return part.select("chunk", *names).mapInArrow(_pack_rows, "chunk long, rows binary").groupBy("chunk")

    seen = packed(rows.filter(last)).cogroup(replies.filter(last).groupBy("chunk"))
    kept = tokens - gone
    counts = seen.applyInArrow(lambda a, b: _mixture_counts(a, b, kept), "class long, two long, one long, n long")
    counts = counts.groupBy("class", "two", "one").agg(F.sum("n").alias("n")).orderBy("class", "two", "one").toPandas()
    mixture = Mixture(learn_mixture(counts, types), tokens, types, gone)
    schema = rows.drop("chunk", "text", "learn").withColumns(
        {"n_tokens": F.lit(0).cast("long"), "n_known": F.lit(0).cast("long"), "train_tokens": F.lit(0).cast("long"), "base_score": F.lit(0.0), "score": F.lit(0.0)}
    ).schema
    both = packed(rows).cogroup(replies.groupBy("chunk"))
    return restored(both.applyInArrow(lambda a, b: _scores(a, b, mixture), schema))


def op6_interpolation(spark, sf_dir: str) -> DataFrame:
    """Every document's score under the model of those that are not held out; one sixth of these is the deleted part."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rest = remainder(F.col("doc_id"), 7)
    docs = docs.withColumn("held_out", F.coalesce(rest == 2, F.lit(False)))
    return score_documents(docs, rest != 2, rest == 3, stored=True).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
