"""Phrase collocations by dynamic itemset counting: lengths are interleaved in cyclic scans of shards.

The documents are dealt into shards that are scanned in turn, over and over. Words are counted from the
first scan on. After each scan, a longer phrase becomes active once both phrases that it begins and ends
with have reached the threshold, and it is counted from the next shard on until it has seen every shard
once. So lengths do not wait for each other, and a phrase that cannot be frequent is never counted.

Tasks learn what has reached the threshold from a filter of bounded size: a hashed bit set per scan, to
which bits are only ever added. A phrase is active in a scan if the scan's filter holds both its parts
and the filter of one cycle earlier did not. That is an interval of just one cycle whether or not a
filter errs, so a filter's error makes a rare phrase be counted, and every count is still exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worksignal.llm.words import _block, byte_values, columns_of, mix64, powers, small_batches, text_bytes
from worksignal.session import discard, fresh_path, settle

SHARDS, LONGEST, LEAST = 3, 4, 30
#: A longer phrase that has so many per cent of a phrase's occurrences stands for it.
COVERED = 80
TOP = 2000
UNKNOWN = "und"
#: Filters have a 64-bit word for so many bytes of text, within these bounds: 32 MB at most.
_BYTES_A_WORD, _FEWEST, _MOST = 8192, 1 << 10, 1 << 22
#: Text that a part's phrases come from; occurrences that a task combines at once.
_PART_BYTES, _BLOCK_BYTES, _HELD = 32 << 20, 1 << 20, 1 << 19
#: Phrases of one language and length whose hashes fall into one part, as arrays: words' codes, counts, first scans.
_PACKED = "lang string, length int, part int, often boolean, keys binary, n binary, since binary"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.zeros(0, dtype=np.uint64)


def lang_code(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def extend(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hash of each phrase with one word more; the hash of no words is the language's code."""
    return mix64(hashes * _BASE + codes)


def places(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Word of a filter of `size` words and the four bits in it that stand for each hash."""
    bits = np.zeros(len(hashes), dtype=np.uint64)
    for shift in (40, 46, 52, 58):
        bits |= np.uint64(1) << (hashes >> np.uint64(shift) & np.uint64(63))
    return (hashes & np.uint64(size - 1)).astype(np.int64), bits


def holds(filter_words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(filter_words):
        return np.zeros(len(hashes), dtype=bool)
    at, bits = places(hashes, len(filter_words))
    return filter_words[at] & bits == bits


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes part words, and which of them part pieces too."""
    pieces = np.zeros(256, dtype=bool)
    pieces[[10, 11, 12, 13, *b".,;:!?"]] = True
    words = pieces.copy()
    words[[9, 32]] = True
    return words, pieces


def _blocks(batch: pa.RecordBatch, known: dict[str, int]) -> Iterator[tuple]:
    """(block, linked, language of each word) of the rows (lang, text); linked: the next word is in the same piece.

    `known` numbers the languages met.
    """
    data, offsets = text_bytes(batch.column(1))
    gap, ends_piece = _tables()
    values = byte_values()
    up, down = powers(_BLOCK_BYTES)
    names = batch.column(0).dictionary_encode()
    numbers = np.array([known.setdefault(x, len(known)) for x in names.dictionary.to_pylist()], dtype=np.int64)
    lang = numbers[names.indices.to_numpy(zero_copy_only=False)] if len(numbers) else numbers
    first, n = 0, len(batch)
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _BLOCK_BYTES, "right")) - 1)
        part = data[offsets[first] : offsets[last]]
        block = _block(first, part, offsets[first : last + 1] - offsets[first], values, gap, up, down)
        piece = np.cumsum(ends_piece[part])[block.begins] if len(part) else block.begins
        linked = np.zeros(len(block.doc), dtype=bool)
        linked[:-1] = (block.doc[1:] == block.doc[:-1]) & (piece[1:] == piece[:-1])
        yield block, linked, lang[block.doc + first]
        first = last


def _after(x: np.ndarray) -> np.ndarray:
    """The next position's value; False or 0 after the last."""
    out = np.zeros_like(x)
    out[:-1] = x[1:]
    return out


def _words_from(codes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    return np.stack([codes[at + k] for k in range(length)])


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where each run of rows that are alike in all columns begins."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0)
    return np.flatnonzero(new)


def _row(lang, length, part, often, words, n, since) -> tuple:
    """A packed row; words (length, phrases) are stored word by word, which sorted phrases make compress well."""
    return lang, length, part, often, np.ascontiguousarray(words).tobytes(), n.astype(np.int64).tobytes(), since.astype(np.int32).tobytes()


def _unpacked(keys: bytes, n: bytes, since: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(keys, np.uint64).reshape(length, -1), np.frombuffer(n, np.int64), np.frombuffer(since, np.int32)


def _scanner(now, old, step: int, with_words: bool, longest: int, parts: int):
    """Packed rows of the active phrases' occurrences, those of some 500,000 occurrences combined.

    `now` and `old` are broadcast filters, of what had reached the threshold before this scan and
    before the scan of this shard one cycle ago.
    """

    def combined(length: int, held: list, names: list[str]) -> pa.RecordBatch:
        hashes, lang, words = (np.concatenate([part[k] for part in held], axis=-1) for k in range(3))
        part = (hashes >> np.uint64(24)) % np.uint64(parts)
        order = np.lexsort((*words[::-1], part, lang))
        lang, part, words = lang[order], part[order], words[:, order]
        first = _runs(lang, part, *words)
        n = np.diff(np.append(first, len(lang)))
        lang, part, words = lang[first], part[first], words[:, first]
        begins = _runs(lang, part)
        ends = np.append(begins[1:], len(lang))
        since = np.full(len(lang), step, dtype=np.int32)
        rows = [_row(names[lang[a]], length, int(part[a]), False, words[:, a:b], n[a:b], since[a:b]) for a, b in zip(begins, ends)]
        return _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached, before = now.value, old.value
        known: dict[str, int] = {}
        held: dict[int, list] = {length: [] for length in range(1, longest + 1)}
        sizes = dict.fromkeys(held, 0)
        for batch in batches:
            for block, linked, lang in _blocks(batch, known):
                codes = block.hashes
                salts = np.array([lang_code(x) for x in known], dtype=np.uint64)
                hashes = extend(salts[lang], codes)
                here = np.ones(len(codes), dtype=bool)
                active, inside, was = (here if with_words else ~here), here, here
                for length in range(1, longest + 1):
                    at = np.flatnonzero(active)
                    if len(at):
                        held[length].append((hashes[at], lang[at], _words_from(codes, at, length)))
                        sizes[length] += len(at)
                        if sizes[length] >= _HELD:
                            yield combined(length, held[length], list(known))
                            held[length], sizes[length] = [], 0
                    if length == longest:
                        break
                    # Which phrases of this length have reached the threshold, and which had a cycle ago.
                    inside, was = inside.copy(), was.copy()
                    some = np.flatnonzero(inside)
                    inside[some] = holds(reached, hashes[some])
                    some = np.flatnonzero(was & inside)
                    was[:] = False
                    was[some] = holds(before, hashes[some])
                    inside, was = inside & _after(inside) & linked, was & _after(was) & linked
                    active = inside & ~was
                    following = np.zeros_like(codes)
                    following[: max(0, len(codes) - length)] = codes[length:]
                    hashes = extend(hashes, following)
        for length, rest in held.items():
            if rest:
                yield combined(length, rest, list(known))

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
    names = ["lang", "length", "part", "often", "keys", "n", "since"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def _merger(step: int, shards: int, least: int):
    """Adds up the packed rows of one language, length and part: those at the threshold, and those still in their cycle."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        lang, length, part = rows[0]["lang"], rows[0]["length"], rows[0]["part"]
        found = [_unpacked(r["keys"], r["n"], r["since"], length) for r in rows]
        words, n, since = (np.concatenate([x[k] for x in found], axis=-1) for k in range(3))
        order = np.lexsort(words[::-1])
        words, n, since = words[:, order], n[order], since[order]
        first = _runs(*words)
        words, n, since = words[:, first], np.add.reduceat(n, first), np.minimum.reduceat(since, first)
        often, going = n >= least, (n < least) & (since > step - shards + 1)
        kept = [_row(lang, length, part, name, words[:, x], n[x], since[x]) for name, x in ((True, often), (False, going)) if x.any()]
        return pa.Table.from_batches([_batch(kept)])

    return run


def _bits_of(size: int):
    """(slot, bits) of packed phrases in a filter of `size` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, _, _ = _unpacked(row["keys"], row["n"], row["since"], row["length"])
                hashes = np.full(words.shape[1], lang_code(row["lang"]), dtype=np.uint64)
                for codes in words:
                    hashes = extend(hashes, codes)
                at, bits = places(hashes, size)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits.view(np.int64))], ["slot", "bits"])

    return run


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, key, n) of packed phrases: a key holds the eight bytes of each word's code, one after the other."""
    for batch in batches:
        for row in batch.to_pylist():
            words, n, _ = _unpacked(row["keys"], row["n"], row["since"], row["length"])
            ends = np.arange(len(n) + 1, dtype=np.int32) * np.int32(8 * row["length"])
            flat = np.ascontiguousarray(words.T.astype("<u8"))
            key = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(n), pa.string()), key, pa.array(n)], ["lang", "key", "n"])


def _gathered(slots: DataFrame, size: int) -> np.ndarray:
    """A filter of `size` words from rows (slot, bits), put together on the cluster and handed to the driver."""
    rows = slots.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(size, dtype=np.uint64)
    out[rows["slot"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def build_filter(packed: DataFrame, size: int) -> np.ndarray:
    """The filter of packed phrases."""
    return _gathered(packed.mapInArrow(_bits_of(size), "slot long, bits long"), size)


def code_filter(codes: DataFrame, size: int) -> np.ndarray:
    """The filter of words' codes (code), whatever their language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at, bits = places(extend(np.zeros_like(code), code), size)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits.view(np.int64))], ["slot", "bits"])

    return _gathered(codes.mapInArrow(run, "slot long, bits long"), size)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS) -> DataFrame:
    """(lang, key, n): every phrase of up to `longest` words that occurs `least` times or more in its language's texts.

    docs hold (lang, text, shard), shard from 0 on. Counts travel packed, by language, length and part;
    parts grow in number with the text. Each scan's counts are added to those before in a table of the
    shared folder, and the table before is deleted once the next is written. Phrases that completed
    their cycle below the threshold leave the table. The driver sees one filter a scan.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "shards")
    docs.write.partitionBy("shard").parquet(path)
    dealt = spark.read.schema("lang string, text string, shard int").parquet(path)
    n_bytes = dealt.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = 1 << int(np.clip(n_bytes // _BYTES_A_WORD, _FEWEST, _MOST) - 1).bit_length()
    parts = 1 + n_bytes // _PART_BYTES
    filters, table, folder, step = {0: _NONE}, None, None, 0
    while step < shards or not np.array_equal(filters[step], filters[step - shards]):
        before = filters.pop(step - shards, _NONE)
        shared = [spark.sparkContext.broadcast(x) for x in (filters[step], before)]
        scanned = dealt.filter(F.col("shard") == step % shards).select("lang", "text")
        counts = scanned.mapInArrow(_scanner(*shared, step, step < shards, longest, parts), _PACKED)
        both = counts if table is None else counts.unionByName(table)
        written = fresh_path(spark, f"phrases{step}")
        both.groupBy("lang", "length", "part").applyInArrow(_merger(step, shards, least), _PACKED).write.parquet(written)
        for x in shared:
            x.destroy()  # the scan is in files now
        if folder:
            discard(spark, folder)
        table, folder = spark.read.schema(_PACKED).parquet(written), written
        step += 1
        filters[step] = build_filter(table.filter(F.col("often") & (F.col("length") < longest)), size)
    discard(spark, path)
    return table.filter("often").mapInArrow(_rows_of, "lang string, key binary, n long")


def _part(key: Column, first: Column, words: Column) -> Column:
    return F.substring(key, first * 8 + 1, words * 8)


def score_cuts(phrases: DataFrame) -> DataFrame:
    """(lang, key, a, l, r, score) of the phrases of two words or more, by their lowest-scoring cut."""
    size = F.floor(F.octet_length("key") / 8).cast("int")
    cuts = phrases.filter("octet_length(key) > 8").select(
        "lang", "key", F.col("n").alias("a"), size.alias("size"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k")
    )
    cuts = cuts.withColumn("left", _part(F.col("key"), F.lit(0), F.col("k")))
    cuts = cuts.withColumn("right", _part(F.col("key"), F.col("k"), F.col("size") - F.col("k")))
    ends = [phrases.select("lang", F.col("key").alias(side), F.col("n").alias(name)) for side, name in (("left", "l"), ("right", "r"))]
    both = cuts.join(ends[0], ["lang", "left"]).join(ends[1], ["lang", "right"])
    score = F.expr("cast(cast(a AS decimal(20, 0)) * 2000000 div (cast(l AS decimal(20, 0)) + r) AS bigint)")
    worst = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return both.groupBy("lang", "key", "a").agg(worst.alias("cut")).select("lang", "key", "a", "cut.l", "cut.r", "cut.score")


def not_covered(candidates: DataFrame, per_cent: int = COVERED) -> DataFrame:
    """The candidates (lang, key, a) that no longer candidate contains with `per_cent` of their occurrences or more."""
    spans = "flatten(transform(sequence(2, size - 1), w -> transform(sequence(0, size - w), p -> struct(p, w))))"
    longer = candidates.filter("octet_length(key) > 16").select("lang", "key", "a", F.expr("cast(octet_length(key) / 8 AS int)").alias("size"))
    inner = longer.select("lang", "a", "key", F.explode(F.expr(spans)).alias("s"))
    inner = inner.select("lang", "a", _part(F.col("key"), F.col("s.p"), F.col("s.w")).alias("key"))
    most = inner.groupBy("lang", "key").agg(F.max("a").alias("most"))
    free = F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * per_cent)
    return candidates.join(most, ["lang", "key"], "left").filter(free).drop("most")


def _speller(wanted):
    """(lang, code, word, n): words that the filter of wanted codes holds, once a block, and each block's words by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needed = wanted.value
        for batch in batches:
            known: dict[str, int] = {}
            for block, _, lang in _blocks(batch, known):
                n = np.bincount(lang, minlength=len(known))
                codes, first = np.unique(block.hashes, return_index=True)
                first = first[holds(needed, extend(np.zeros_like(codes), codes))]
                data = block.data.tobytes()
                words = [data[block.begins[i] : block.ends[i]].decode().translate(_LOWER) for i in first.tolist()]
                columns = [
                    pa.array([*known, *[None] * len(words)], pa.string()),
                    pa.array([*[None] * len(known), *block.hashes[first].view(np.int64).tolist()], pa.int64()),
                    pa.array([*[None] * len(known), *words], pa.string()),
                    pa.array([*n.tolist(), *[0] * len(words)], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "code", "word", "n"])

    return run


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _codes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, key, place, code): the words of each phrase (lang, key)."""
    for batch in batches:
        keys = batch.column(1).to_pylist()
        sizes = np.array([len(k) // 8 for k in keys], dtype=np.int64)
        codes = np.frombuffer(b"".join(keys), dtype="<u8").view(np.int64)
        rows = np.repeat(np.arange(len(keys)), sizes)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        row = pa.array(rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(row), batch.column(1).take(row), pa.array(place), pa.array(codes)], ["lang", "key", "place", "code"]
        )


def mine(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, per_cent: int = COVERED, shards: int = SHARDS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` collocations of each language in docs (doc_id, lang, text).

    A-Z are lower-cased; `.,;:!?` and 0x0A-0x0D part pieces, space and tab part words. A phrase has 2 to
    `longest` words in one piece and occurs a >= `least` times, overlaps included. Of its cuts into two
    parts, which occur l and r times, the one of the lowest floor(2000000 a / (l + r)) counts, ties to
    the earliest. A phrase inside a longer one with `per_cent` of its occurrences or more is left out.
    Order: score, then a, both falling, then the phrase's bytes. n counts the language's words.

    A NULL lang is `und`, together with texts of that name; NULL and empty texts have no words; a
    language without candidates has no rows. Repeated rows count as often as they are there, doc_id (NULL or
    not) and text only say which shard a row is in. Extra columns are ignored. Words have 64-bit codes: among
    10^8 different words two share one with probability 3e-4.
    """
    if not 2 <= longest <= 16 or shards < 1 or least < 1:
        raise ValueError("phrases have 2 to 16 words, shards and least are 1 or more")
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.filter("text <> ''").select(
        F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard")
    )
    phrases = frequent_phrases(texts, least, longest, shards)
    candidates = settle(not_covered(score_cuts(phrases), per_cent))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    # Ties at the last rank stay until the phrases are spelt out.
    ahead = settle(candidates.withColumn("place", F.rank().over(best)).filter(F.col("place") <= top).drop("place"))
    coded = settle(ahead.select("lang", "key").mapInArrow(_codes_of, "lang string, key binary, place long, code long"))
    codes = coded.select("code").distinct()
    size = 1 << int(np.clip(codes.count(), _FEWEST, _MOST) - 1).bit_length()
    wanted = spark.sparkContext.broadcast(code_filter(codes, size))
    spelt = settle(
        texts.select("lang", "text").mapInArrow(_speller(wanted), "lang string, code long, word string, n long")
        .groupBy("lang", "code", "word").agg(F.sum("n").alias("n"))
    )
    words = spelt.filter("code IS NOT NULL").join(codes, "code", "left_semi").groupBy("code").agg(F.min("word").alias("word"))
    phrase = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ")
    named = coded.join(words, "code").groupBy("lang", "key").agg(phrase.alias("phrase"))
    totals = spelt.filter("code IS NULL").select("lang", "n")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = ahead.join(named, ["lang", "key"]).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language of `documents`."""
    return mine(columns_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "lang", "text"))


OP13_SQL = r"""
WITH text AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
piece AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM text),
word AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM word),
sizes AS (SELECT lang, w, i, unnest([1, 2, 3, 4]) AS k FROM starts),
f AS (
  SELECT lang, w[i : i + k - 1] AS p, count(*) AS f FROM sizes WHERE i + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(p) = 1 GROUP BY lang),
candidate AS (SELECT lang, p, f AS a FROM f WHERE len(p) > 1 AND f >= 30),
cut AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM candidate),
scored AS (
  SELECT c.lang, c.p, c.a, c.k, x.f AS l, y.f AS r, ((2000000 * c.a::HUGEINT) // (x.f + y.f))::BIGINT AS score
  FROM cut c JOIN f x ON x.lang = c.lang AND x.p = c.p[1 : c.k] JOIN f y ON y.lang = c.lang AND y.p = c.p[c.k + 1 :]),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_size AS (SELECT lang, p, a, unnest(range(2, len(p))) AS w FROM candidate WHERE len(p) > 2),
inner_span AS (SELECT lang, p, a, w, unnest(range(1, len(p) - w + 2)) AS s FROM inner_size),
most AS (SELECT lang, p[s : s + w - 1] AS p, max(a) AS most FROM inner_span GROUP BY ALL),
kept AS (SELECT w.* FROM worst w LEFT JOIN most m ON m.lang = w.lang AND m.p = w.p WHERE m.most IS NULL OR 100 * m.most < 80 * w.a),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank,
    array_to_string(p, ' ') AS phrase, a, l, r, score FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
