"""License texts and notices in documents, by patience alignment with templates.

Words that occur once in the text's stretch and once in the template's are anchors; the longest
increasing subsequence of their places is kept, and the gaps between anchors are aligned in the same
way, after what both ends have in common. Coverage is the share of the template's words aligned. Words
that tell a template from its siblings may not be missing, and of a short one without such none may.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksignal.llm.license_templates import NAMES, TEMPLATES
from worksignal.llm.words import small_batches

COVERAGE = 0.8
#: A template of so many words at most must be there word by word, if NAMES does not say which words count.
SHORT = 16
MAX_TEMPLATES = 1000
_WORD = re.compile(r"[^\W_]+")
#: Stretch of text looked at on either side of an occurrence, by words of the template on that side.
_STRETCH, _SPARE = 1.5, 4


class Template(NamedTuple):
    name: str
    words: list[str]
    counts: Counter
    names: list[list[str]]  # runs of words that a match holds unbroken
    places: dict[str, list[int]]  # of the words of which an alignment that covers enough holds at least one


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def prepare(templates: Sequence[tuple[str, str]], coverage: float) -> list[Template]:
    """Templates with their telling words: so many that leaving out all of them leaves too little coverage.

    The longest words come first, as they are rare in other texts.
    """
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates")
    out = []
    for name, text in templates:
        words = words_of(text)
        counts, places, held = Counter(words), {}, 0
        for word in sorted(counts, key=lambda w: (-len(w), w)):
            if len(words) - held < coverage * len(words):
                break
            places[word] = [i for i, w in enumerate(words) if w == word]
            held += counts[word]
        if words:
            names = NAMES.get(name, (text,) if len(words) <= SHORT else ())
            out.append(Template(name, words, counts, [words_of(x) for x in names], places))
    return out


def _increasing(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for i, place in enumerate(places):
        k = bisect_left(tops, place)
        before.append(piles[k - 1] if k else -1)
        tops[k : k + 1] = [place]
        piles[k : k + 1] = [i]
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(text: Sequence[str], template: Sequence[str]) -> list[tuple[int, int]]:
    """Places (in text, in template) of the words aligned, rising in both."""
    pairs, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a >= b or c >= d:
            continue
        once = {w: i for i, w in enumerate(text[a:b], a)}
        left, right = Counter(text[a:b]), Counter(template[c:d])
        anchors = [(once[w], j) for j, w in enumerate(template[c:d], c) if right[w] == 1 and left[w] == 1]
        anchors = [anchors[k] for k in _increasing([i for i, _ in anchors])]
        for i, j in anchors:
            pairs.append((i, j))
            todo.append((a, i, c, j))
            a, c = i + 1, j + 1
        if anchors:
            todo.append((a, b, c, d))
    return sorted(pairs)


def _holds(text: list[str], run: list[str]) -> bool:
    return any(text[i : i + len(run)] == run for i in range(len(text) - len(run) + 1))


def best_match(text: list[str], template: Template, at: dict[str, list[int]], coverage: float) -> tuple[float, int, int] | None:
    """(coverage, first word, words spanned) of the template's best alignment in the text, if it covers enough.

    Every occurrence of a telling word is tried as an anchor, with stretches on both sides in
    proportion to the template. `at` gives the places of telling words in the text.
    """
    size, best = len(template.words), None
    for word, places in template.places.items():
        for p in at.get(word, ()):
            for t in places:
                low = max(0, p - int(_STRETCH * t) - _SPARE)
                high = min(len(text), p + 1 + int(_STRETCH * (size - t - 1)) + _SPARE)
                within = Counter(text[low:high])
                if sum(min(n, within[w]) for w, n in template.counts.items()) < coverage * size:
                    continue
                left = align(text[low:p], template.words[:t])
                right = align(text[p + 1 : high], template.words[t + 1 :])
                found = (len(left) + 1 + len(right)) / size
                first = low + left[0][0] if left else p
                last = p + 1 + right[-1][0] if right else p
                # Of equal coverage, the densest and then the first one.
                rated = (found, -(last - first + 1), -first)
                if found < coverage or not all(_holds(text[first : last + 1], run) for run in template.names):
                    continue
                if best is None or rated > best:
                    best = rated
                if found == 1 and last - first + 1 == size:
                    return 1.0, first, size
    return None if best is None else (best[0], -best[2], -best[1])


def scan(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, coverage: float = COVERAGE
) -> DataFrame:
    """Adds n_words, licenses, license, coverage, first_word and n_spanned to documents (text).

    `licenses` lists (name, coverage, first_word, n_spanned) of every template of which at least
    `coverage` of the words is aligned with a stretch of the text that also holds the template's NAMES
    unbroken (the whole template if it has at most SHORT words and no NAMES), best first: by
    words aligned, then coverage, then name. The other columns are the first one's, NULL where there is none.
    Words are runs of letters and digits, case folded. NULL and empty texts hold none. Extra columns
    stay, those of the added names are replaced; every row stands for itself.
    """
    small_batches(docs.sparkSession)
    added = ["n_words", "licenses", "license", "coverage", "first_word", "n_spanned"]
    kept = docs.drop(*added)
    place = kept.columns.index("text")
    known = prepare(templates, coverage)
    telling = frozenset(w for t in known for w in t.places)
    item = "struct<name:string,coverage:double,first_word:bigint,n_spanned:bigint>"

    def licenses_of(words: list[str]) -> list[dict]:
        held = telling.intersection(words)
        if not held:
            return []
        at: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in held:
                at.setdefault(w, []).append(i)
        found = []
        for template in known:
            match = best_match(words, template, at, coverage) if not held.isdisjoint(template.places) else None
            if match:
                found.append((-round(match[0] * len(template.words)), -match[0], template.name, match))
        return [{"name": n, "coverage": m[0], "first_word": m[1], "n_spanned": m[2]} for _, _, n, m in sorted(found)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("name", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("n_spanned", pa.int64())]))
        for batch in batches:
            counts, found = [], []
            for text in batch.column(place):
                words = words_of(text.as_py() or "")
                counts.append(len(words))
                found.append(licenses_of(words))
            columns = [pa.array(counts, pa.int64()), pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "n_words", "licenses"])

    schema = kept.withColumns({"n_words": F.lit(0).cast("long"), "licenses": F.expr(f"cast(array() as array<{item}>)")}).schema
    out = kept.mapInArrow(run, schema)
    best = F.get("licenses", F.lit(0))
    return out.withColumns(
        {"license": best["name"], "coverage": best["coverage"], "first_word": best["first_word"], "n_spanned": best["n_spanned"]}
    )


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licenses and license notices in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_words", "license", "coverage", "first_word", "n_spanned", "licenses")
