"""Counting which keywords rows mention, block of queries by block of rows.

Queries and rows of a tenant are dealt by hash over blocks of about `BLOCK_TERMS` terms, and every block of queries
meets every block of the tenant's rows in one task. What is shuffled is each side once for each block of the other,
as 64-bit hashes, and pairs exist only inside a task, so neither grows with the number of pairs. Two of 10^7
different words share a hash with probability 3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from worksignal.functions.keywords import index_word, is_compound, mention_pattern, word_set
from worksignal.session import settle

BLOCK_TERMS = 1 << 20
_SIDE = 2048  # queries and rows counted at once
_DENSE = 2048  # words of a matrix product at most
_STEP = 1 << 20  # counts added at once
_BATCH = 1 << 14  # rows given back at once
_FEW_TENANTS = 10_000


def hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def small(tenants: DataFrame) -> DataFrame:
    """A settled table of tenants, to be broadcast where these are few."""
    return F.broadcast(tenants) if tenants.limit(_FEW_TENANTS + 1).count() <= _FEW_TENANTS else tenants


def compound_terms(keywords: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """(*key, terms): hashes of the compound keywords that rows mention.

    Keywords: (tenant_id, keyword), lower-cased; rows: (*key, glued), `key` beginning with tenant_id. Each
    different run is tested once, against the keywords that begin with one of its words.
    """
    compound = keywords.filter(is_compound(F.col("keyword"))).distinct().withColumn("word", index_word(F.col("keyword")))
    runs = rows.select(*key, F.explode("glued").alias("run"))
    links = (
        runs.select("tenant_id", "run").distinct()
        .withColumn("word", F.explode(word_set(F.col("run"))))
        .join(compound, ["tenant_id", "word"])
        .filter(F.rlike("run", mention_pattern(F.col("keyword"))))
        .groupBy("tenant_id", "run").agg(F.collect_set(F.xxhash64("keyword")).alias("terms"))
    )
    return runs.join(links, ["tenant_id", "run"]).select(*key, "terms")


def meet(queries: DataFrame, rows: DataFrame, row_key: list[str], count, schema: str, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """`count(queries, rows)`, Arrow tables one after the other, for every block of a tenant's queries with every block of its rows.

    Both have tenant_id, `terms` and n_terms, the number of these; a tenant's rows with equal `row_key` share a block. Queries are dealt by `query`.
    A task holds two blocks and the table that `count` gives next, whatever the number of pairs.
    """
    def sizes(df, name):
        return df.groupBy("tenant_id").agg(F.ceil(F.sum("n_terms") / block_terms).cast("int").alias(name))

    blocks = settle(sizes(queries, "q").join(sizes(rows, "r"), "tenant_id").withColumns({x: F.greatest(F.col(x), F.lit(1)) for x in "qr"}))
    blocks = small(blocks)

    def dealt(df, key, own, other):
        at = F.pmod(F.xxhash64(*key), F.col(own)).cast("int")
        return df.join(blocks, "tenant_id").withColumns(
            {f"{own}_block": at, f"{other}_block": F.explode(F.sequence(F.lit(0), F.col(other) - 1))}
        ).drop("q", "r").withColumn("asks", F.lit(own == "q"))

    names = {True: queries.columns, False: rows.columns}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = {True: [], False: []}
        for batch in batches:
            for side, columns in names.items():
                some = batch.select(columns).filter(pc.equal(batch.column("asks"), side))
                if some.num_rows:
                    sides[side].append(some)
        if sides[True] and sides[False]:
            q, r = (pa.Table.from_batches(sides.pop(side)) for side in (True, False))
            for found in count(q, r):
                yield from found.combine_chunks().to_batches(max_chunksize=_BATCH)

    both = dealt(queries, ["query"], "q", "r").unionByName(dealt(rows, row_key, "r", "q"), allowMissingColumns=True)
    return both.groupBy("tenant_id", "q_block", "r_block").applyInArrow(counted, schema)


def flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """The row of each element of a column of lists, and the elements."""
    lists = lists.combine_chunks()
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(n)), n), lists.flatten().to_numpy(zero_copy_only=False)


def codes(table: pa.Table, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row's values in the columns, and the first row of each number."""
    # The length before a value keeps values apart whatever they hold.
    parts = []
    for c in columns:
        text = table.column(c).cast(pa.string())
        parts += [pc.fill_null(pc.utf8_length(text).cast(pa.string()), "-"), pc.fill_null(text, "")]
    joined = pc.binary_join_element_wise(*parts, ":").combine_chunks().dictionary_encode()
    code = joined.indices.to_numpy(zero_copy_only=False)
    return code, np.unique(code, return_index=True)[1]


def hits(
    query: np.ndarray, term: np.ndarray, needed: np.ndarray, row: np.ndarray, word: np.ndarray, once: bool = False
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, rows, counts) of the pairs where the row's words are `needed[query]` of the query's terms or more.

    A term that a query has several times counts as often. With `once`, queries found are looked for no further,
    the rows of most words being tried first.
    """
    for _, _, *found in ranges(query, term, needed, row, word, once):
        yield tuple(found)


def ranges(
    query: np.ndarray, term: np.ndarray, needed: np.ndarray, row: np.ndarray, word: np.ndarray, once: bool = False
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """`hits`, each with the range of its rows: (first row, first row of the next range, queries, rows, counts).

    Without `once`, ranges come in the order of the rows, and each gives a query's pairs at once.
    """
    vocabulary, term = np.unique(term, return_inverse=True)
    v = len(vocabulary)
    if not v or not len(word):
        return
    key, weight = np.unique(query.astype(np.int64) * v + term, return_counts=True)
    query, term, weight = ((key // v).astype(np.int32), (key % v).astype(np.int32), weight.astype(np.int32))
    at = np.minimum(np.searchsorted(vocabulary, word), v - 1)
    same = vocabulary[at] == word
    key = np.unique(row[same].astype(np.int64) * v + at[same])
    row, word = (key // v).astype(np.int32), (key % v).astype(np.int32)
    del at, same, key
    if not len(row):
        return
    wide, n_words = np.unique(row, return_counts=True)
    if once:
        wide = wide[np.argsort(-n_words, kind="stable")]
    place = np.full(row.max() + 1, -1, np.int32)
    place[wide] = np.arange(len(wide))
    row = place[row]
    order = np.lexsort((word, row // _SIDE))
    row, word = row[order], word[order]
    del order
    kind = np.float32 if np.bincount(query, weights=weight).max() < 1 << 24 else np.float64
    open_ = np.ones(len(needed), bool)
    for low in range(0, len(wide), _SIDE):
        a, b = np.searchsorted(row // _SIDE, (low // _SIDE, low // _SIDE + 1))
        start_row, next_row = wide[low], wide[low + _SIDE] if low + _SIDE < len(wide) else len(place)
        rows, words = row[a:b] - low, word[a:b]
        n_row = np.bincount(words, minlength=v)
        start = np.cumsum(n_row) - n_row
        if once:
            left = open_[query]
            query, term, weight = query[left], term[left], weight[left]
        asked = np.unique(query)
        for first in range(0, len(asked), _SIDE):
            ids = asked[first:first + _SIDE]
            c, d = np.searchsorted(query, (ids[0], ids[-1] + 1))
            some = n_row[term[c:d]] > 0
            q, t, w = np.searchsorted(ids, query[c:d])[some], term[c:d][some], weight[c:d][some]
            total = _counts(q, t, w, rows, words, n_row, start, len(ids), kind)
            x, y = np.nonzero(total >= np.maximum(needed[ids], 1)[:, None])
            if once:
                x, one = np.unique(x, return_index=True)
                y = y[one]
                open_[ids[x]] = False
            if len(x):
                yield start_row, next_row, ids[x], wide[low + y], total[x, y].astype(np.int64)


def _counts(q, t, w, rows, words, n_row, start, n, kind) -> np.ndarray:
    """Counts of n queries in _SIDE rows: frequent words by a matrix product, the others by adding up their rows."""
    both = np.bincount(t, minlength=len(n_row)) * n_row
    frequent = np.flatnonzero(both > n * _SIDE / 512)
    if len(frequent) > _DENSE:
        frequent = frequent[np.argpartition(-both[frequent], _DENSE)[:_DENSE]]
    at = np.full(len(n_row), -1)
    at[frequent] = np.arange(len(frequent))
    total = np.zeros((n, _SIDE), kind)
    if len(frequent):
        asked, has = np.zeros((n, len(frequent)), kind), np.zeros((len(frequent), _SIDE), kind)
        inside, held = at[t] >= 0, at[words] >= 0
        asked[q[inside], at[t[inside]]] = w[inside]
        has[at[words[held]], rows[held]] = 1
        total = asked @ has
        q, t, w = q[~inside], t[~inside], w[~inside]
    many = n_row[t]
    ends = np.cumsum(many)
    flat_total = total.reshape(-1)
    low = 0
    while low < len(t):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + _STEP, side="right")))
        m = many[low:high]
        spot = np.arange(m.sum()) + np.repeat(start[t[low:high]] - (np.cumsum(m) - m), m)
        cell = np.repeat(q[low:high].astype(np.int64) * _SIDE, m) + rows[spot]
        flat_total += np.bincount(cell, weights=np.repeat(w[low:high], m), minlength=len(flat_total)).astype(kind)
        low = high
    return total
