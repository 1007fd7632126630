import re

import numpy as np
from pyspark.sql import functions as F

from worksignal.llm.url_filter import RULES, judge_urls, op1_url_filter, train

from .conftest import SF, given_tables

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parted(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (found[1].translate(UPPER), found[2]) if found else ("", "")


def ruled(host, path):
    fits = []
    for verdict, rule in RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((-len(rule), rule, verdict))
    return min(fits)[1:] if fits else (None, None)


def test_rules_and_parts(frame):
    urls = [
        "http://A.Example.COM/en/7?x=1", "https://example.com/en/8", "http://example.net/de/8", "http://x.net/de/9#a", "http://org/es/",
        "http://notorg/es/", "ftp://a.org/es/x", "http://com/en", "http://com?/en/", "://", "no scheme", "", None, "a://b://c/d", "http://É.com/en/",
        "http://example.com\n/en/1", "http://x.com/en/" + "y" * 50000,
    ]
    rows = [(i, u, "mine") for i, u in enumerate(urls)] + [(0, urls[0], "mine"), (None, urls[1], None)]
    got = judge_urls(frame(rows, "page_id long, url string, verdict string"), np.zeros((1 << 16) + 1)).collect()
    assert len(got) == len(rows)
    for row in got:
        assert (row["host"], row["path"]) == parted(row["url"])
        rule, verdict = ruled(row["host"], row["path"])
        assert row["rule"] == rule and row["verdict"] == (verdict or "allow") and row["score"] == 0.5


def test_regression_learns_words_of_urls(frame):
    random = np.random.default_rng(1)
    rows = [(f"http://{'cheap-pills' if bad else 'garden'}{random.integers(99)}.example/{random.integers(9999)}", bool(bad)) for bad in random.integers(0, 2, 300)]
    labelled = frame([*rows, (None, True), ("http://x.example/", None)], "url string, blocked boolean")
    weights = train(labelled)
    assert np.array_equal(weights, train(labelled.repartition(5)))
    asked = frame([("http://cheap-pills123.example/9",), ("http://my.garden5.example/7",)], "url string")
    got = {r["host"]: r["verdict"] for r in judge_urls(asked, weights).collect()}
    assert got == {"cheap-pills123.example": "block", "my.garden5.example": "allow"}
    nothing = train(labelled.limit(0))
    assert {r["verdict"] for r in judge_urls(asked, nothing).collect()} == {"allow"}
    assert judge_urls(asked.limit(0), weights).count() == 0


@given_tables
def test_query(spark):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op1_url_filter(spark, SF).collect()
    assert len(got) == len(urls)
    for row in got:
        host, path = parted(urls[row["page_id"]])
        rule, verdict = ruled(host, path)
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
        assert row["verdict"] == (verdict or ("block" if row["score"] > 0.5 else "allow"))
