from conftest import one, rows
from pyspark.sql import functions as F

from worksignal.operators import grounding


def test_contradictions_need_a_known_entity_and_its_sources(spark):
    multi = spark.createDataFrame([("t", "OPS-225", "Closing call", ["calendar", "email"]), ("t", "OPS-9", "Board prep", ["email", "notes"]),
                                   ("u", "OPS-1", "Other", ["email", "notes"])], "tenant_id string, task_id string, title string, sources array<string>")
    claims = spark.createDataFrame([
        ("t", "1", "OPS-225", ["email"]), ("t", "2", " closing CALL ", ["email", "calendar"]), ("t", "3", "ops-225: Closing call", ["calendar"]),
        ("t", "4", "The board prep slides", ["notes"]), ("t", "5", "OPS-2251", ["email"]), ("t", "6", "OPS-225", ["notes"]),
        ("t", "7", "OPS-225", []), ("t", "8", "Somebody", ["email"]), ("t", "9", "Other", ["email"]), ("t", "10", "OPS-9", None)],
        "tenant_id string, claim_id string, entity string, sources array<string>")
    kept, rejected = grounding.ground_contradictions(claims, multi)
    assert rows(kept, "claim_id", "task_id") == [("1", "OPS-225"), ("2", "OPS-225"), ("3", "OPS-225"), ("4", "OPS-9"), ("5", "OPS-225")]
    assert rows(rejected, "claim_id", "reason") == sorted([
        ("6", "sources not mentioned"), ("7", "sources not mentioned"), ("8", "unknown entity"), ("9", "unknown entity"),
        ("10", "sources not mentioned")], key=repr)


def test_evidence_layers(spark):
    sources = spark.createDataFrame([("t", "email", "r2", "l", "Pump #2 leak cleared by night shift"), ("t", "email", "r3", "l", "Pump #3 rattle analysis")],
                                    "tenant_id string, source string, ref string, label string, text string")
    claims = spark.createDataFrame([("t", "c", "Pump #2 leak cleared"), ("t", "d", "Rattle was analysed: analysis")], "tenant_id string, claim_id string, text string")
    evidence = spark.createDataFrame([
        ("t", "c", "r2", " pump #2 LEAK "), ("t", "c", "r9", "x"), ("t", "c", "r2", "not there"), ("t", "c", "r2", ""), ("t", "c", "r3", "Pump #3 rattle"),
        ("t", "d", "r3", "rattle"), ("t", "d", "r2", "night shift"), ("t", "d", "r3", "Pump")],
        "tenant_id string, claim_id string, source_ref string, quote string")
    found = grounding.ground_evidence(evidence, claims, sources)
    assert rows(found, "claim_id", "quote", "reason") == sorted([
        ("c", "pump #2 LEAK", None), ("c", "x", "unknown ref"), ("c", "not there", "quote not in source"), ("c", "", "quote not in source"),
        ("c", "Pump #3 rattle", "other identifier"), ("d", "rattle", None), ("d", "night shift", "no shared keyword"), ("d", "Pump", "no shared keyword")],
        key=repr)
    common = spark.createDataFrame([("t", "rattle")], "tenant_id string, term string")
    filtered = grounding.ground_evidence(evidence, claims, sources, common)
    assert rows(filtered.filter("reason IS NULL"), "claim_id") == [("c",)]
    assert dict(rows(grounding.evidence_counts(found), "outcome", "n"))["accepted"] == 2


def test_later_kind_wins_a_shared_ref(spark):
    sources = spark.createDataFrame([("t", "email", "r", "l", "a"), ("t", "notes", "r", "l", "b")], "tenant_id string, source string, ref string, label string, text string")
    assert one(grounding.last_per_ref(sources), "source", "text") == ("notes", "b")


def test_priority_coverage(spark):
    flagged = spark.createDataFrame([("t", "1", "Close Kestrel renewal", "P0"), ("t", "2", "Hire engineer", "P1"), ("t", "3", "Budget", "P1"),
                                     ("t", "4", "Kestrel", "P2"), ("t", "5", "now", "P0"), ("u", "6", "Elsewhere entirely", "P0")],
                                    "tenant_id string, id string, title string, priority string")
    text = spark.createDataFrame([("t", "The KESTREL renewals matter; an engineering role. Budgets.")], "tenant_id string, text string")
    assert rows(grounding.uncovered_tasks(text, flagged), "task_id") == [("2",)]


def test_protected_contacts(spark):
    config = spark.createDataFrame([("t", [("Kim O'Neil", "kim@x.org"), ("Al", "")]), ("u", [])],
                                   "tenant_id string, never_draft_contacts array<struct<name:string,email:string>>")
    items = spark.createDataFrame([
        ("t", "1", "Reply to Kim", ""), ("t", "2", "Kimono order", ""), ("t", "3", "x", "from kim@x.org."), ("t", "4", "Al said", None), ("t", "5", "KIM's note", ""),
        ("t", "6", "ask O'Neil!", ""), ("u", "7", "Kim", ""), ("v", "8", "Kim", "")], "tenant_id string, id string, summary string, context string")
    assert rows(grounding.draftable(items, config), "id") == [("2",), ("4",), ("7",), ("8",)]


def test_last_draft_of_an_id_is_attached(spark):
    items = spark.createDataFrame([("t", "1"), ("t", "2")], "tenant_id string, id string")
    drafts = spark.createDataFrame([("t", "1", "old", 0), ("t", "1", "new", 1), ("u", "2", "x", 0)], "tenant_id string, id string, draft_text string, ordinal int")
    assert rows(grounding.attach_drafts(items, drafts), "id", "draft_text") == [("1", "new"), ("2", None)]


def test_titles_are_found_anywhere_in_long_entities(spark):
    titles = {"T-1": "order number 5", "T-2": "Board prep", "T-3": "kick-off", "T-4": "order  twice", "T-5": "order number 51", "T-6": "", "T-7": "é à"}
    tasks = spark.createDataFrame([("t", k, v, ["email", "notes"]) for k, v in titles.items()], "tenant_id string, task_id string, title string, sources array<string>")
    filler = "lorem ipsum " * 8000
    entities = ["reorder number 51 now", "the board prepared", "a kick-offs b", "order  twice", "order twice", filler + "BOARD PREP", "x" * 60_000 + " order number 5",
                "x" * 60_000 + "kick-off", "l'é àb", "", None, "T-", "t-3 and more", " order number ", "clipboard prep"]
    claims = spark.createDataFrame([("t", str(k), e) for k, e in enumerate(entities)], "tenant_id string, claim_id string, entity string")

    def first(entity):
        e = (entity or "").strip().lower()
        found = [k for k, v in titles.items() if e.startswith(k.lower()) or (v and v.lower() in e)]
        return entity if entity in titles else min(found, default=None)

    want = sorted((str(k), first(e)) for k, e in enumerate(entities) if first(e))
    assert rows(grounding.resolve_entities(claims, tasks), "claim_id", "task_id") == want
    anchored, single = grounding.title_anchors(tasks.select("tenant_id", F.lower("title").alias("low_title"), "task_id").filter("low_title <> ''"))
    assert dict(rows(anchored, "task_id", "anchor")) == {"T-1": "5", "T-2": "prep", "T-4": "twice", "T-5": "51", "T-7": "à"}
    assert rows(single, "task_id") == [("T-3",)]


def test_texts_are_not_carried_with_each_quote(spark):
    sources = spark.createDataFrame([("t", "email", "r", "l", "pump leak")], "tenant_id string, source string, ref string, label string, text string")
    claims = sources.select("tenant_id", F.lit("c").alias("claim_id"), "text")
    evidence = claims.select("tenant_id", "claim_id", F.lit("r").alias("source_ref"), F.lit("pump").alias("quote"))
    joins, nodes = [], [grounding.ground_evidence(evidence, claims, sources)._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "Join":
            joins.append(node)
        nodes += [node.children().apply(k) for k in range(node.children().size())]
    assert len(joins) == 2
    # The last join meets no whole text: the source's was tested before, and of the claim only words are left.
    assert "text" not in joins[0].output().mkString(" ")


def test_only_beginnings_that_are_looked_for_are_listed(spark):
    words = spark.createDataFrame([("t", w) for w in ("order", "ord-12", "ord", "number", "15")] + [("u", "ord-1")], "tenant_id string, word string")
    ids = spark.createDataFrame([("t", "ord-1"), ("t", "ord-123"), ("t", "")], "tenant_id string, low_id string")
    # A beginning that many words share and no id has would come to one task with all its words.
    assert rows(grounding._begins(words, "word", ids, "low_id", "low_id"), "word", "low_id") == [("ord-12", "ord-1")]


def test_titles_that_share_frequent_words_find_their_rarest(spark):
    titles = spark.createDataFrame([("t", f"task number {k}", str(k)) for k in range(9)] + [("t", "a number", "n"), ("t", "one", "o")],
                                   "tenant_id string, low_title string, task_id string")
    for often in (1, 100):
        anchored, single = grounding.title_anchors(titles, often)
        assert rows(anchored, "task_id", "anchor") == [(str(k), str(k)) for k in range(9)] + [("n", "number")]
        assert rows(single, "task_id") == [("o",)]
