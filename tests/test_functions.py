import pytest
from conftest import one
from pyspark.sql import functions as F

from worksignal.functions import checks, dates, headers, keywords, payload, text


def value(spark, build, *args):
    names = [f"c{i}" for i in range(len(args))]
    df = spark.createDataFrame([args], ", ".join(f"{n} string" for n in names))
    return df.select(build(*[F.col(n) for n in names]).alias("v")).first()["v"]


@pytest.mark.parametrize("title, expected", [
    ("Fix the multi-depot plan with Kim", ["multi-depot", "plan", "Kim"]),
    ("Review review it now", ["Review", "review"]),
    ("Ask Tomás about O'Brien's Q3", ["Ask", "Tom", "about", "O'Brien's"]),
    ("a b 12", []),
])
def test_title_keywords(spark, title, expected):
    assert value(spark, keywords.title_keywords, title) == expected


def test_prose_keywords_drop_more_words(spark):
    assert value(spark, keywords.prose_keywords, "You should have the Budget before tomorrow") == ["budget"]


@pytest.mark.parametrize("body, keyword, expected", [
    ("the board met", "board", True),
    ("onboarding day", "board", False),
    ("a pre-multi-depot test", "multi-depot", True),
    ("multi-depots", "multi-depot", False),
    ("tomás called", "tom", False),
    ("tom called", "tom", True),
    ("see foo-bar", "foo-", True),
    ("see foo- bar", "foo-", False),
    ("snake_board", "board", False),
])
def test_mentions_keep_word_boundaries(spark, body, keyword, expected):
    hit = value(spark, lambda t, k: keywords.mentioned(keywords.word_set(t), keywords.glued_set(t), k), body, keyword)
    assert hit is expected


def test_excerpt_is_centred_on_the_earliest_keyword(spark):
    long = "x" * 400 + " Vargo said " + "y" * 400
    cut = value(spark, lambda t: keywords.excerpt(t, F.array(F.lit("nobody"), F.lit("vargo"))), long)
    assert len(cut) == 250 and cut[125:130] == "Vargo"
    assert value(spark, lambda t: keywords.excerpt(t, F.array(F.lit("absent"))), long) == "x" * 250


@pytest.mark.parametrize("subject, expected", [
    ("Re: Re: Fwd: Launch   Plan", "launch plan"), ("FW : re:x", "x"), ("Regarding: x", "regarding: x"),
])
def test_thread_id(spark, subject, expected):
    assert value(spark, headers.thread_id, subject) == expected


@pytest.mark.parametrize("header, name, email", [
    ('"Ada B" <Ada@X.org>', "Ada B", "ada@x.org"), ("ada@x.org", "ada@x.org", "ada@x.org"), ("<a@b.c>", "a@b.c", "a@b.c"),
    ("", "unknown", "unknown"),
])
def test_from_header(spark, header, name, email):
    assert value(spark, headers.sender_name, header) == name
    assert value(spark, headers.sender_email, header) == email


def test_body_loses_signature_only_near_its_end(spark):
    assert value(spark, headers.clean_body, "Hi\nall\n\nThanks,\nBo") == "Hi\nall"
    kept = "--\n1\n2\n3\n4\n5\n6"
    assert value(spark, headers.clean_body, kept) == kept
    assert value(spark, headers.clean_body, "a" * 1200) == "a" * 1000 + "... [body truncated]"
    assert value(spark, headers.clean_body, "") == ""


@pytest.mark.parametrize("day, label", [
    ("2024-05-10", "TODAY"), ("2024-05-09", "YESTERDAY"), ("2024-05-01", "9 DAYS AGO — NOT today"),
    ("2024-05-11", "2024-05-11"), ("unknown", "unknown"),
])
def test_day_label(spark, day, label):
    assert value(spark, lambda d: dates.day_label(d, "2024-05-10"), day) == label


@pytest.mark.parametrize("due, expected", [
    ("2024-05-09", "overdue"), ("2024-05-10", "due_today"), ("2024-05-17", "due_soon"), ("2024-05-18", "later"),
    ("soon", "no_date"), (None, "no_date"), ("2024-02-31", "no_date"),
])
def test_date_urgency(spark, due, expected):
    assert value(spark, lambda d: dates.date_urgency(d, "2024-05-10"), due) == expected


def test_iso_week_and_its_monday(spark):
    assert value(spark, lambda d: dates.iso_week(dates.strict_day(d)), "2027-01-01") == "2026-W53"
    assert str(value(spark, lambda w: dates.sort_day(w, F.lit(True)), "2026-W53")) == "2026-12-28"


@pytest.mark.parametrize("number, expected", [(0.125, 0.12), (0.375, 0.38), (0.445, 0.45), (2.675, 2.67), (1234.5, 1234.5)])
def test_rounding_follows_the_binary_value(spark, number, expected):
    assert spark.range(1).select(dates.rounded(F.lit(number))).first()[0] == expected == round(number, 2)


@pytest.mark.parametrize("raw, expected", [
    ('Sure:\n```json\n{"a": 1}\n```\nbye', '{"a": 1}'), ('x {"a": {"b": 2}} y', '{"a": {"b": 2}}'), ("none", "none"),
])
def test_extract_json(spark, raw, expected):
    assert value(spark, payload.extract_json, raw) == expected


@pytest.mark.parametrize("raw, errors", [
    ('{"a": [{"x": null}], "b": []}', []),
    ('{"a": [{"y": 1}, 3]}', ["'a[0]' missing keys: ['x']", "'a[1]' expected an object, got int", "Missing top-level key: 'b'"]),
    ('{"a": "t", "b": {}}', ["Expected 'a' to be a list, got str", "Expected 'b' to be a list, got dict"]),
    ("[]", ["Expected a JSON object at top level, got list"]),
    ('{"a": []} trailing', ["Not a JSON text"]),
    ('{"a": []}, {}', ["Not a JSON text"]),
])
def test_schema_errors(spark, raw, errors):
    assert value(spark, lambda t: payload.schema_errors(t, {"a": ("x",), "b": ()}), raw) == errors


def test_leaf_strings_leave_out_keys_and_numbers(spark):
    raw = '{"description": "say \\"hi\\": now", "n": 3, "more": {"tags": ["a:", "b"]}, "none": null}'
    assert value(spark, payload.leaf_strings, raw) == ['say "hi": now', "a:", "b"]


def test_checks(spark):
    assert value(spark, checks.narrates_schema, "Here's a breakdown of it") is True
    assert value(spark, checks.narrates_schema, "Budget is due") is False
    missing = value(spark, lambda t: checks.missing_keywords(
        t, F.array(F.array(F.lit("bay 7"), F.lit("Budget")), F.array(F.lit("weld")))), "budget cut")
    assert missing == [["weld"]]
    assert value(spark, lambda t: checks.long_enough(t, 3), " one two three ") is True
    assert value(spark, lambda t: checks.long_enough(t, 1), "  ") is False
    bloat = spark.range(1).select(*[checks.bloat_ceiling(F.lit(n), 8, 4.0) for n in (1, 2, 3)]).first()
    assert tuple(bloat) == (8, 8, 12)


def test_lines(spark):
    assert value(spark, text.lines_of, "a\r\nb\n\n") == ["a", "b", ""]
    assert value(spark, text.lines_of, "") == []
