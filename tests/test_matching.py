"""Index joins against brute force on small, awkward fixtures."""

import random
import re

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from worksignal.functions.constants import PROSE_STOP_WORDS, TITLE_STOP_WORDS
from worksignal.operators import blocks, briefs, crossref, matching
from worksignal.operators.ordered import fold_lines, fold_ordered, next_value, ordinal

VOCABULARY = ["budget", "Budget", "pump", "multi-depot", "depot", "multi", "o'brien", "tomás", "Tom", "cap-", "review", "sla", "board", "onboard", "the"]


def text_of(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def title_words(text):
    return [w for w in re.findall(r"[A-Za-z][A-Za-z'-]*", text) if len(w) >= 3 and w.lower() not in TITLE_STOP_WORDS]


def found_in(text, words):
    return [w for w in words if re.search(r"\b" + re.escape(w.lower()) + r"\b", text.lower())]


def brute_matches(claims, sources, threshold):
    out = []
    for tenant in {c[0] for c in claims}:
        own = [s for s in sources if s[0] == tenant]
        counts = {}
        for s in own:
            for w in {w.lower() for w in title_words(s[3])}:
                counts[w] = counts.get(w, 0) + 1
        common = {w for w, c in counts.items() if len(own) >= 4 and c / len(own) > threshold}
        for c in (c for c in claims if c[0] == tenant):
            words = [w for w in title_words(c[2]) if w.lower() not in PROSE_STOP_WORDS and w.lower() not in common]
            for s in own:
                n = len(found_in(s[3], words))
                if words and n >= max(2, round(len(words) * 0.4)):
                    out.append((tenant, c[1], s[1], s[2], n, len(words)))
    return sorted(out, key=repr)


def test_keyword_matches_equal_brute_force(spark):
    for seed in range(3):
        rng = random.Random(seed)
        claims = [(t, f"c{i}", text_of(rng, rng.randint(1, 14))) for t in ("a", "b") for i in range(12)]
        sources = [("a", "email", f"r{i}", text_of(rng, rng.randint(0, 12))) for i in range(25)]
        sources += [("b", "notes", f"r{i}", text_of(rng, rng.randint(0, 12))) for i in range(3)]  # too few to filter
        c = spark.createDataFrame(claims, "tenant_id string, claim_id string, text string")
        s = spark.createDataFrame(sources, "tenant_id string, source string, ref string, text string")
        for threshold in (0.5, 0.2):
            assert rows(matching.keyword_matches(c, s, threshold)) == brute_matches(claims, sources, threshold), (seed, threshold)


def test_one_keyword_claims_never_match(spark):
    c = spark.createDataFrame([("a", "c", "Budget!")], "tenant_id string, claim_id string, text string")
    s = spark.createDataFrame([("a", "email", "r", "budget budget")], "tenant_id string, source string, ref string, text string")
    assert matching.keyword_matches(c, s).count() == 0
    assert rows(matching.citation_stats(c, matching.keyword_matches(c, s))) == [("a", 0, 0, 1)]


def test_a_word_in_most_sources_stays_exact(spark):
    """One word held by every source of the hot tenant, and one claim matching them all."""
    sources = spark.range(3000).select(
        F.lit("hot").alias("tenant_id"), F.lit("email").alias("source"), F.col("id").cast("string").alias("ref"),
        F.concat(F.lit("pump rattle "), F.when(F.col("id") % 3 == 0, F.lit("alpha beta")).otherwise(F.lit("gamma"))).alias("text"))
    claims = spark.createDataFrame([("hot", "c", "alpha beta report"), ("hot", "d", "pump rattle leak")], "tenant_id string, claim_id string, text string")
    got = matching.keyword_matches(claims, sources).groupBy("claim_id").count()
    assert rows(got) == [("c", 1000)]  # the words of claim d are common and so filtered
    got = matching.keyword_matches(claims, sources, None).groupBy("claim_id").count()
    assert rows(got) == [("c", 1000), ("d", 3000)]


def test_task_mentions_equal_brute_force(spark):
    for seed in range(3):
        rng = random.Random(seed + 10)
        tasks = [("a", f"T-{i}", text_of(rng, rng.randint(1, 5)), "P1", "2024-05-04") for i in range(14)]
        items = [("a", rng.choice(["email", "notes"]), f"2024-05-0{rng.randint(1, 6)}", i, text_of(rng, rng.randint(1, 8))) for i in range(60)]
        expected = []
        for _, tid, title, _, _ in tasks:
            words = title_words(title)
            if not words:
                continue
            best = {}
            for _, source, day, o, text in items:
                hit = set(found_in(text, words))
                key = (source, day)
                if len(hit) > len(best.get(key, (set(),))[0]):
                    best[key] = (hit, o)
            for (source, day), (hit, o) in best.items():
                if len(hit) >= min(2, len(words)):
                    expected.append((tid, source, day, sorted(hit), int(day[-2:]) - 4))
        t = spark.createDataFrame(tasks, "tenant_id string, id string, title string, priority string, due_date string")
        i = spark.createDataFrame(items, "tenant_id string, source string, day string, ordinal bigint, text string").select(
            "tenant_id", "source", F.col("day").alias("entry_key"), F.lit("delta").alias("section"), F.lit("decisions").alias("category"),
            "ordinal", "day", "text")
        got = crossref.task_mentions(t, i).select("task_id", "source", "day", "matched_keywords", "days_from_due")
        assert rows(got) == sorted(expected, key=repr), seed


def test_keywords_split_over_items_do_not_match(spark):
    t = spark.createDataFrame([("a", "T", "Kestrel renewal", "P1", None), ("a", "U", "Review Review", None, None)],
                              "tenant_id string, id string, title string, priority string, due_date string")
    i = spark.createDataFrame([("email", 0, "kestrel receipt"), ("email", 1, "other renewal"), ("notes", 0, "Kestrel renewal, review it")],
                              "source string, ordinal bigint, text string").select(
        F.lit("a").alias("tenant_id"), "source", F.lit("k").alias("entry_key"), F.lit("delta").alias("section"), F.lit("x").alias("category"),
        "ordinal", F.lit("2024-W01").alias("day"), "text")
    got = crossref.task_mentions(t, i)
    assert rows(got, "task_id", "source", "days_from_due") == [("T", "notes", None)]
    assert crossref.multi_source_tasks(got).count() == 0


def test_rolled_up_entries_are_not_searched(spark):
    entries = spark.createDataFrame([("a", "email", "2024-W01", "2024-W01", None, True), ("a", "notes", "n.md", "unknown", "n.md", False)],
                                    "tenant_id string, source string, entry_key string, day string, note_id string, compacted boolean")
    items = spark.createDataFrame([("a", "email", "2024-W01", "x y"), ("a", "notes", "n.md", "x y"), ("a", "notes", "n.md", "")],
                                  "tenant_id string, source string, entry_key string, text string")
    assert rows(crossref.ledger_texts(entries, items), "source", "day", "text") == [("notes", "n.md", "x y")]


def test_bucketed_order_equals_a_plain_window(spark):
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate((k, v) for k in ("a", "b", None) for v in (5, 3, None, 3, 17, 21, 5))],
                               "k string, v int, i int")
    order = [F.col("v").asc_nulls_first(), F.col("i")]
    got = ordinal(df, ["k"], F.floor(F.col("v") / 4), order)
    from pyspark.sql import Window
    want = df.withColumn("ordinal", F.row_number().over(Window.partitionBy("k").orderBy(*order)).cast("bigint"))
    assert rows(got, "k", "v", "i", "ordinal") == rows(want, "k", "v", "i", "ordinal")
    full = df.filter("v IS NOT NULL")
    got = next_value(full, ["k"], F.floor(F.col("v") / 4), [F.col("v"), F.col("i")], "v", "nxt")
    want = full.withColumn("nxt", F.lead("v").over(Window.partitionBy("k").orderBy("v", "i")))
    assert rows(got, "k", "v", "i", "nxt") == rows(want, "k", "v", "i", "nxt")


def test_long_groups_are_one_text_whatever_the_run(spark):
    lines = spark.range(1, 26).select(F.lit("g").alias("g"), F.col("id").alias("ordinal"), F.col("id").cast("string").alias("line"))
    for run in (1, 3, 10, 5000):
        (row,) = fold_lines(lines, ["g"], run=run).collect()
        assert row.text.split("\n") == [str(i) for i in range(1, 26)]


def test_found_claims_are_those_with_matches_whatever_the_blocks(spark):
    rng = random.Random(5)
    claims = [(t, f"c{i}", text_of(rng, rng.randint(1, 14))) for t in ("a", "b") for i in range(12)]
    sources = [(t, "email", f"r{i}", text_of(rng, rng.randint(0, 6))) for t in ("a", "b") for i in range(20)]
    c = spark.createDataFrame(claims, "tenant_id string, claim_id string, text string")
    s = spark.createDataFrame(sources, "tenant_id string, source string, ref string, text string")
    expected = brute_matches(claims, sources, 0.5)
    assert rows(matching.keyword_matches(c, s, block_terms=20)) == expected
    assert rows(matching.matched_claims(c, s, block_terms=20)) == sorted({m[:2] for m in expected}, key=repr)


def test_counts_of_many_words_in_many_rows():
    """Row numbers times words pass 32 bits."""
    n = 60_000
    term = np.arange(n, dtype=np.int64) * 7919
    query, row = np.repeat(np.arange(n // 2), 2), np.repeat(np.arange(n, dtype=np.int32), 2)
    word = np.stack([term, np.roll(term, -1)], axis=1).reshape(-1)
    got = [np.concatenate(x) for x in zip(*blocks.hits(query, term, np.full(n // 2, 2, np.int32), row, word))]
    assert sorted(zip(*map(list, got))) == [(i, 2 * i, 2) for i in range(n // 2)]


def test_best_items_are_the_same_whatever_the_blocks(spark):
    rng = random.Random(8)
    t = spark.createDataFrame([("a", f"T-{i}", text_of(rng, 4), "P1", "2024-05-04") for i in range(12)],
                              "tenant_id string, id string, title string, priority string, due_date string")
    i = spark.createDataFrame([("email", f"k{i % 7}", i, text_of(rng, 6)) for i in range(40)], "source string, entry_key string, ordinal bigint, text string").select(
        F.lit("a").alias("tenant_id"), "source", "entry_key", F.lit("delta").alias("section"), F.lit("x").alias("category"), "ordinal",
        F.lit("2024-05-01").alias("day"), "text")
    whole, cut = (rows(crossref.best_items(t, i, n), "task_id", "entry_key", "ordinal", "matched") for n in (1 << 20, 15))
    assert whole and whole == cut


def test_pairs_leave_a_block_a_few_at_a_time(spark, monkeypatch):
    """Whatever the number of pairs and however an entry's items lie over the ranges that are counted at once."""
    rng = random.Random(9)
    t = spark.createDataFrame([("a", f"T-{i}", text_of(rng, 4), "P1", "2024-05-04") for i in range(30)],
                              "tenant_id string, id string, title string, priority string, due_date string")
    i = spark.createDataFrame([("email", f"k{rng.randint(0, 4) * rng.randint(0, 4)}", i, text_of(rng, 6)) for i in range(150)],
                              "source string, entry_key string, ordinal bigint, text string").select(
        F.lit("a").alias("tenant_id"), "source", "entry_key", F.lit("delta").alias("section"), F.lit("x").alias("category"), "ordinal",
        F.lit("2024-05-01").alias("day"), "text")
    columns = ["task_id", "entry_key", "ordinal", "matched"]
    want, tables = rows(crossref.best_items(t, i), *columns), []

    def meet(queries, items, row_key, count, schema, block_terms):
        tables.extend(count(queries.toArrow(), items.toArrow()))

    monkeypatch.setattr(crossref, "meet", meet)
    for side, some in ((8, None), (64, columns)):
        tables.clear()
        monkeypatch.setattr(blocks, "_SIDE", side)
        monkeypatch.setattr(crossref, "_PAIRS", 10)
        crossref.best_items(t, i, columns=some)
        got = sorted((tuple(r[c] for c in columns) for x in tables for r in x.to_pylist()), key=repr)
        assert len(want) > 100 and got == want
        assert max(map(len, tables)) <= 10 and (some is None or tables[0].column_names == columns)


def test_sources_of_tasks_are_told_without_their_mentions(spark):
    rng = random.Random(10)
    title = lambda k: text_of(rng, rng.randint(1, 5)) if k else None
    t = spark.createDataFrame([(x, f"T-{k}", title(k), "P1", "2024-05-04") for x in "ab" for k in range(14)],
                              "tenant_id string, id string, title string, priority string, due_date string")
    i = spark.createDataFrame([(rng.choice("ab"), rng.choice(["email", "notes", "calendar", None]), f"k{k % 9}", k, text_of(rng, 5)) for k in range(50)],
                              "tenant_id string, source string, entry_key string, ordinal bigint, text string").select(
        "tenant_id", "source", "entry_key", F.lit("delta").alias("section"), F.lit("x").alias("category"), "ordinal",
        F.lit("2024-05-01").alias("day"), "text")
    best = crossref.best_items(t, i)
    want = rows(best, "tenant_id", "task_id", "title", "source")
    for n in (1 << 20, 15):
        assert rows(crossref.task_sources(t, i, n)) == sorted(set(want), key=repr) and len(want) > len(set(want))
    assert rows(crossref.multi_source_tasks(crossref.task_sources(t, i))) == rows(crossref.multi_source_tasks(best))


def test_lines_in_order_are_joined_and_computed_once(spark):
    lines = spark.createDataFrame([("g", v // 4, v, f"line {v}") for v in range(23)] + [("h", None, 1, "b"), ("h", None, 0, "a"), ("h", 5, 0, "c"), (None, 1, 1, "x")],
                                  "g string, b int, v int, line string")
    want = sorted([("g", "\n".join(f"line {v}" for v in range(23))), ("h", "a\nb\nc"), (None, "x")], key=repr)
    for run in (1, 3, 5000):
        folded = fold_ordered(lines, ["g"], F.col("b"), [F.col("v")], run=run)
        assert rows(folded, "g", "text") == want
    assert folded._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_few_asked_keywords_are_found_as_by_the_whole_index(spark):
    """Words beside letters beyond ASCII, marks at both ends, letters that are ASCII only when lower-cased."""
    rng = random.Random(9)
    parts = ["Pump", "pump", "multi-depot", "xmulti-depot", "cap-", "cap-x", "o'Brien", "depot", "tom", "tomás", "Ètom", "\u212aelvin", "kelvin", "depot\u0130",
             "board_", "board", "board7", "--", "'", "the", "é", ",", "-pump-", "Straße"]
    texts = [(rng.choice([" ", "", "-", "\n"])).join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(300)] + [None]
    s = spark.createDataFrame([("a", "email", f"r{i}", t) for i, t in enumerate(texts)], "tenant_id string, source string, ref string, text string")
    c = spark.createDataFrame([("a", f"c{i}", " ".join(rng.choice(parts) for _ in range(rng.randint(2, 6)))) for i in range(40)],
                              "tenant_id string, claim_id string, text string")
    for threshold in (None, 0.2):
        few, whole = (rows(matching.keyword_matches(c, x, threshold)) for x in (s, matching.source_index(s)))
        assert few and few == whole, threshold
    asked = matching._asked(c)
    index = matching.asked_index(s, asked)
    assert index.count() == len(texts) and "kelvin" in asked.column("keyword").to_pylist()
    own = rows(index.select("ref", F.explode("keywords").alias("k")))
    whole = rows(matching.source_index(s).select("ref", F.explode("keywords").alias("k")))
    assert own == [x for x in whole if x[1] in set(asked.column("keyword").to_pylist())]


def test_matches_are_computed_once_to_be_ranked(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    found = [("a", f"c{i % 3}", "email", f"r{i}", i % 5, 5) for i in range(40)]
    schema = "tenant_id string, claim_id string, source string, ref string, n_matched int, n_keywords int"
    ranked = briefs.ranked_refs(spark.createDataFrame(found, schema).mapInPandas(counted, schema))
    assert ranked.filter("match_rank = 1").count() == 3 and seen.value == 40
