"""SentencePiece encoding (byte-pair models) by vectorised merge rounds, and decoding.

A text is cut where no piece can reach across (before each run of space symbols), its distinct
parts are encoded together: all symbols lie in one flat array, and each round finds the best pair
of every part by a segmented minimum, merges it at all its places from the left, and compacts.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksignal.llm.words import columns_of, small_batches

SPACE = "▁"
_NEVER = np.int32(2**31 - 1)
_SPREAD = 0x9E3779B97F4A7C15
_MOST_CACHED = 200_000
_BLOCK_CHARS = 1 << 20


def read_model(path: str) -> bytes:
    return Path(path).read_bytes()


class PieceModel:
    """The tables of a byte-pair model. It must add a space in front, keep white space and fall back to bytes."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        spec = ModelProto.FromString(model)
        norm = spec.normalizer_spec
        if (
            spec.trainer_spec.model_type != 2
            or not spec.trainer_spec.byte_fallback
            or norm.precompiled_charsmap
            or norm.remove_extra_whitespaces
            or not (norm.add_dummy_prefix and norm.escape_whitespaces)
        ):
            raise ValueError("not a byte-pair model with identity normalisation and byte fallback")
        library = SentencePieceProcessor(model_proto=model)
        n = library.get_piece_size()
        self.pieces = [library.id_to_piece(i) for i in range(n)]
        normal = [p.type == 1 for p in spec.pieces]
        self.byte_ids = np.zeros(256, dtype=np.int32)
        self.byte_of = np.full(n, -1, dtype=np.int16)
        for i, p in enumerate(self.pieces):
            if spec.pieces[i].type == 6:
                self.byte_ids[int(p[3:5], 16)], self.byte_of[i] = i, int(p[3:5], 16)
        self.control = np.array([p.type == 3 for p in spec.pieces])
        self.unknown = {i for i, p in enumerate(spec.pieces) if p.type == 2}
        self.unk_surface = spec.trainer_spec.unk_surface
        symbols = {p: i for i, p in enumerate(self.pieces) if normal[i]}
        scores = {p: spec.pieces[i].score for p, i in symbols.items()}
        for c in sorted({c for p in scores for c in p}):  # characters that occur in pieces only
            symbols.setdefault(c, len(symbols) + n)
        self.n_pieces, self.foreign = n, max(symbols.values()) + 1
        self.of_char = np.full(0x110000, self.foreign, dtype=np.int32)
        for p, i in symbols.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = {}
        for p in scores:
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = (order[scores[p]], symbols[p])
        self._hash_pairs(pairs)
        if any(SPACE in p.lstrip(SPACE) for p in scores):
            raise ValueError("a piece holds a space after other characters")
        # Long white space: pieces of 2 to `widest` spaces that all come last are filled from the left.
        blank = {len(p): scores[p] for p in scores if not p.strip(SPACE) and len(p) > 1}
        widest = max(blank, default=1)
        last = len(set(blank.values())) == 1 and min(blank.values(), default=0) == min(scores.values())
        regular = widest > 1 and last and set(blank) == set(range(2, widest + 1))
        cut = f"{SPACE}{{{widest}}}(?={SPACE}{SPACE})|" if regular else ""
        self.parts = re.compile(f"{cut}{SPACE}*[^{SPACE}]+|{SPACE}+")

    def _hash_pairs(self, pairs: dict[int, tuple[int, int]]) -> None:
        """An open hash table in arrays: key, rank and merged symbol by slot."""
        self.bits = max(4, (4 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, dtype=np.int64)
        self.ranks, self.merged = np.full(size, _NEVER), np.zeros(size, dtype=np.int32)
        for key, (rank, symbol) in pairs.items():
            slot = key * _SPREAD % (1 << 64) >> 64 - self.bits
            while self.keys[slot] >= 0:
                slot = (slot + 1) % size
            self.keys[slot], self.ranks[slot], self.merged[slot] = key, rank, symbol

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (the lowest is merged first) and the slot of its entry."""
        key = left.astype(np.int64) << 32 | right
        slot = (key.view(np.uint64) * np.uint64(_SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.keys[slot]
        open_ = np.flatnonzero((there != key) & (there >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.keys)
            there = self.keys[slot[open_]]
            open_ = open_[(there != key[open_]) & (there >= 0)]
        return np.where(self.keys[slot] == key, self.ranks[slot], _NEVER), slot

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, one after the other, and how many each has."""
        chars = np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32)
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        symbol, part, place = self.of_char[chars], owner, np.arange(len(chars))
        done = []
        while len(symbol):
            symbol, part, place, finished = self._round(symbol, part, place)
            done.append(finished)
        symbol, part, place = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in range(3))
        order = np.argsort(place, kind="stable")
        symbol, part, place = symbol[order], part[order], place[order]
        return self._with_bytes(symbol, part, chars[place], len(parts))

    def _round(self, symbol, part, place):
        joined = part[:-1] == part[1:]
        rank, entry = np.full(len(symbol), _NEVER), np.zeros(len(symbol), dtype=np.int64)
        rank[:-1], entry[:-1] = self.pair_ranks(symbol[:-1], symbol[1:])
        rank[:-1][~joined] = _NEVER
        heads = np.flatnonzero(np.concatenate([[True], ~joined]))
        sizes = np.diff(np.append(heads, len(symbol)))
        least = np.repeat(np.minimum.reduceat(rank, heads), sizes)
        over = least == _NEVER
        finished = (symbol[over], part[over], place[over])
        best = (rank == least) & ~over
        # From the left: of places that follow each other directly, every other one.
        at = np.flatnonzero(best)
        if not len(at):
            return symbol[:0], part[:0], place[:0], finished
        fresh = np.concatenate([[True], np.diff(at) > 1])
        run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        made = self.merged[entry[at]]
        # A new pair that comes before the next place ends the round for its part.
        before, after = at - 1, at + 2
        left = np.where(before >= 0, symbol[before], -1)
        if len(at) > 1:
            touch = np.concatenate([[False], at[1:] - at[:-1] == 2])
            left[touch] = made[:-1][touch[1:]]
        has_left = (before >= 0) & (part[before] == part[at])
        right_at = np.minimum(after, len(symbol) - 1)
        has_right = (after < len(symbol)) & (part[right_at] == part[at])
        soon = has_left & (self.pair_ranks(left, made)[0] <= rank[at])
        soon |= has_right & (self.pair_ranks(made, symbol[right_at])[0] <= rank[at])
        if soon.any():
            stop = np.flatnonzero(soon)
            parts, firsts = np.unique(part[at[stop]], return_index=True)
            where = np.minimum(np.searchsorted(parts, part[at]), len(parts) - 1)
            kept = (parts[where] != part[at]) | (at <= at[stop[firsts]][where])
            at, made = at[kept], made[kept]
        symbol = symbol.copy()
        symbol[at] = made
        stay = ~over
        stay[at + 1] = False
        return symbol[stay], part[stay], place[stay], finished

    def _with_bytes(self, symbol, part, chars, n):
        """A symbol that is no piece is written as the bytes of its character."""
        foreign = symbol >= self.n_pieces
        if foreign.any():
            code = chars.astype(np.int64)
            width = np.where(foreign, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), 1)
            at = np.repeat(np.arange(len(symbol)), width)
            k = np.arange(len(at)) - np.repeat(np.cumsum(width) - width, width)
            c, w = code[at], width[at]
            low = 0x80 | (c >> 6 * (w - 1 - k)) & 0x3F
            lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[w] | c >> 6 * (w - 1)
            byte = np.where(w == 1, c, np.where(k == 0, lead, low)) & 0xFF
            symbol, part = np.where(foreign[at], self.byte_ids[byte], symbol[at]), part[at]
        return symbol.astype(np.int32), np.bincount(part, minlength=n)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The library's texts of rows of ids, as UTF-8 bytes and the length of each.

        The space in front goes, byte pieces join to characters, bad bytes become U+FFFD.
        """
        if not hasattr(self, "surface"):
            self._surfaces()
        ends = np.cumsum(counts)
        begins = ends - counts
        widths = self.width[ids]
        sums = np.concatenate([[0], np.cumsum(widths)])
        at = np.arange(sums[-1]) + np.repeat(self.surface_at[ids] - sums[:-1], widths)
        data, lengths = self.surface[at], sums[ends] - sums[begins]
        odd = np.concatenate([[0], np.cumsum(self.odd[ids])])
        odd_rows = np.flatnonzero((odd[ends] > odd[begins]) & (counts > 0))
        front = np.zeros(len(counts), dtype=np.int64)
        front[counts > 0] = self.spaced[ids[begins[counts > 0]]]
        front[odd_rows] = 0
        if not len(odd_rows) and not front.any():
            return data, lengths
        starts = np.cumsum(lengths) - lengths
        rows = {k: self._odd_row(ids[begins[k] : ends[k]]) for k in odd_rows.tolist()}
        keep = np.ones(len(data), dtype=bool)
        keep[starts[front > 0]] = False
        if not rows:
            return data[keep], lengths - front
        out = [rows[k] if k in rows else data[starts[k] : starts[k] + n][keep[starts[k] : starts[k] + n]] for k, n in enumerate(lengths.tolist())]
        return np.concatenate(out), np.array([len(x) for x in out])

    def _odd_row(self, ids: np.ndarray) -> np.ndarray:
        """A row that holds bytes, control ids or the unknown id."""
        out, run, begun = [], bytearray(), False
        for i in ids.tolist():
            if self.byte_of[i] >= 0:
                run.append(int(self.byte_of[i]))
                continue
            if run:
                out.append(run.decode("utf-8", "worksignal_each_byte"))
                run, begun = bytearray(), True
            piece = self.unk_surface if i in self.unknown else "" if self.control[i] else self.pieces[i].replace(SPACE, " ")
            if piece and not begun:
                piece = piece[1:] if self.spaced[i] else piece
                begun = True
            out.append(piece)
        out.append(run.decode("utf-8", "worksignal_each_byte"))
        return np.frombuffer("".join(out).encode(), dtype=np.uint8)

    def _surfaces(self) -> None:
        codecs.register_error("worksignal_each_byte", _each_byte)
        plain = [p.replace(SPACE, " ").encode() for p in self.pieces]
        self.width = np.array([len(p) for p in plain])
        self.surface, self.surface_at = np.frombuffer(b"".join(plain), np.uint8), np.cumsum(self.width) - self.width
        self.spaced = np.array([p.startswith(SPACE) for p in self.pieces])
        self.odd = (self.byte_of >= 0) | self.control
        self.odd[sorted(self.unknown)] = True


def _each_byte(error):
    return "�", error.start + 1


class Encoder:
    """Encodes texts with a bounded cache of parts."""

    def __init__(self, model: bytes):
        self.model = PieceModel(model)
        self._clear()

    def _clear(self):
        self.index: dict[str, int] = {}
        self.flat, self.begin, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, parts: set[str]):
        if len(self.index) + len(parts) > _MOST_CACHED:
            self._clear()
        new = sorted(parts.difference(self.index))
        if new:
            flat, counts = self.model.encode_parts([SPACE + p for p in new])
            begin = np.cumsum(counts) - counts + len(self.flat)
            self.flat, self.begin = np.concatenate([self.flat, flat]), np.concatenate([self.begin, begin])
            self.count = np.concatenate([self.count, counts])
            for p in new:
                self.index[p] = len(self.index)

    def parts_of(self, text: str) -> list[str]:
        """Parts of a text, each without the space symbol that all begin with."""
        if not text:
            return []
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            return [p[1:] for p in self.model.parts.findall(SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        split = [self.parts_of(t) for t in texts]
        every = [p for parts in split for p in parts]
        self._learn(set(every))
        index = np.fromiter(map(self.index.__getitem__, every), dtype=np.int64, count=len(every))
        counts = self.count[index]
        total = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(total[-1]) + np.repeat(self.begin[index] - total[:-1], counts)
        ends = total[np.cumsum([0, *map(len, split)])]
        return self.flat[at], np.diff(ends)


def _batched(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= _BLOCK_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _encoded(encoder: Encoder, column: pa.Array) -> pa.Array:
    found, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for group in _batched([t or "" for t in column.to_pylist()]):
        flat, n = encoder.encode(group)
        found.append(flat)
        counts.append(n)
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))


def _decoded(model: PieceModel, column: pa.Array) -> pa.Array:
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten()
    if values.null_count:
        owner = np.repeat(np.arange(len(counts)), counts)[values.is_valid().to_numpy(zero_copy_only=False)]
        counts, values = np.bincount(owner, minlength=len(counts)), values.drop_null()
    data, lengths = model.decode(values.to_numpy(zero_copy_only=False), counts)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(counts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def _with_columns(docs: DataFrame, model_path: str, read: str, added: dict, work) -> DataFrame:
    """docs with the columns `added` (name: a value of its type), filled by work(model)(column `read`)."""
    model = read_model(model_path)
    small_batches(docs.sparkSession)
    kept = docs.drop(*added)
    place, names = kept.columns.index(read), list(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fill = work(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *fill(batch.column(place))], [*batch.schema.names, *names])

    return kept.mapInArrow(run, kept.withColumns(added).schema)


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of each whole text (array<int>), without begin and end ids; a NULL text has none.

    A column of the name of the added one is replaced. Empty texts give empty arrays.
    """

    def work(model):
        encoder = Encoder(model)
        return lambda column: [_encoded(encoder, column)]

    return _with_columns(docs, model_path, text, {ids: F.array(F.lit(0))}, work)


def decode(docs: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of each array of ids as the library decodes it; a NULL array gives an empty text.

    A column of the name of the added one is replaced. NULL ids inside an array are skipped; an id
    that the model has not is an error.
    """

    def work(model):
        tables = PieceModel(model)
        return lambda column: [_decoded(tables, column)]

    return _with_columns(docs, model_path, ids, {text: F.lit("")}, work)


def encode_and_decode(
    docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """`encode` and then `decode` of what it gave, in one pass with one set of tables."""

    def work(model):
        encoder = Encoder(model)

        def fill(column):
            found = _encoded(encoder, column)
            return [found, _decoded(encoder.model, found)]

        return fill

    return _with_columns(docs, model_path, text, {ids: F.array(F.lit(0)), decoded: F.lit("")}, work)


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded again; digests of both."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = columns_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    coded = encode_and_decode(docs, path).drop("text")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
