import pytest
from pyspark.sql import functions as F

from worksignal.llm.chunking import drop_repeats
from worksignal.llm.interpolation import score_documents
from worksignal.llm.mixing import mix
from worksignal.llm.names import set_aside, unused
from worksignal.llm.rule_ensemble import Ensemble, rate
from worksignal.llm.url_filter import judge_urls

#: Names that the operators use inside.
INNER = ("key", "__key", "__found", "found", "s", "draw", "whole", "extra", "cut", "cut_in", "chunk", "learn", "__deleted", "learned", "at", "digest",
         "first", "statistics", "part", "owner", "place", "n", "bands", "codes")


def test_unused_names():
    assert unused(["a", "B", "b_"], "b", "c", "c") == ["b__", "c", "c_"]


def test_set_aside(frame):
    df = frame([(1, 2, 3)], "Key int, other int, key_ int")
    moved, back = set_aside(df, "key")
    assert moved.columns == ["key__" if c == "x" else c for c in ("Key__", "other", "key_")] and back(moved).columns == df.columns


def operators():
    import numpy as np

    return {
        "drop_repeats": drop_repeats,
        "mix": lambda df: mix(df, [1.0, 2.0]),
        "judge_urls": lambda df: judge_urls(df, np.zeros((1 << 16) + 1)),
        "score_documents": lambda df: score_documents(df, F.col("learn") == "learn", F.col("chunk") == "chunk"),
        "rate": lambda df: rate(df, Ensemble(0.0, [])),
    }


@pytest.mark.parametrize("name", sorted(operators()))
def test_extra_columns_stay_whatever_they_are_called(frame, name):
    rows = [(i, f"word {i} and more", "s", f"http://h/{i}", *INNER) for i in range(6)]
    schema = "doc_id long, text string, source string, url string, " + ", ".join(f"`{c}` string" for c in INNER)
    out = operators()[name](frame(rows, schema))
    assert set(INNER) <= set(out.columns)
    found = out.select("doc_id", *INNER).collect()
    assert sorted(tuple(r) for r in found) == [(i, *INNER) for i in range(6)]


def test_scores_do_not_hang_on_the_number_of_executors(spark, tmp_path):
    """Files split the same in every read, whatever the parallelism is when they are read."""
    path = str(tmp_path / "docs")
    spark.range(4000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.md5((F.col("id") + k).cast("string")) for k in range(9)]).alias("text")).coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    spark.conf.unset("spark.sql.files.minPartitionNum")
    before = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
    try:
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "2")
        scored = score_documents(docs, F.col("doc_id") % 7 != 2, F.col("doc_id") % 7 == 3, stored=True)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "8")
        assert scored.filter("n_tokens = 10").count() == 4000
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism") if before is None else spark.conf.set("spark.sql.leafNodeDefaultParallelism", before)
