"""A corpus made ready for training: language, near copies, repeated passages, mixture, tokens.

Each stage takes any documents: NULLs, empty texts, ties and repeated rows are treated as its operator's
docstring says, columns besides those of documents stay, and an empty table gives an empty one. As it
begins, a stage lets Spark delete what shuffles of the stages before left on disk.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksignal.llm.bagminhash import near_duplicates
from worksignal.llm.chunking import drop_repeats
from worksignal.llm.language_id import UNKNOWN, identify, train
from worksignal.llm.mixing import mix
from worksignal.llm.pieces import encode_and_decode
from worksignal.llm.names import unused
from worksignal.session import fresh_path, release

#: A text is rejected if its language has less than this share of its n-grams: it is in none of them.
LEAST_LANGUAGE_SCORE = 0.15


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learned from the labelled ones; `lang` is the language found."""
    release(spark)
    found = identify(docs, train(docs)).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return found.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least doc_id.

    Rows alike in doc_id and text are one; different texts of one doc_id are kept or dropped together.
    Rows without a doc_id are kept.
    """
    release(spark)
    copies = near_duplicates(docs).filter("NOT kept").select("doc_id").distinct()
    single = docs.join(copies, "doc_id", "left_anti").select(*docs.columns)
    (digest,) = unused(docs.columns, "digest")
    known = single.filter("doc_id IS NOT NULL").withColumn(digest, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    known = known.dropDuplicates(["doc_id", digest]).drop(digest)
    return known.union(single.filter("doc_id IS NULL"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occurred before; a document of nothing else goes."""
    release(spark)
    cut = drop_repeats(docs).filter("n_repeated < n_words OR n_words = 0")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources weigh 5, 2, 1 in turn, 150 % of all words, 2 epochs at most."""
    release(spark)
    mixed = mix(docs, [5.0, 2.0, 1.0]).filter("repeats > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, exact): the ids of every document, and whether they decode to its text."""
    release(spark)
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = encode_and_decode(docs.select("doc_id", "lang", "source", "text"), path)
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    return coded.select("doc_id", "lang", "source", "ids", same.alias("exact"))


STAGES = [
    ("language ID", known_languages),
    ("MinHash near-dedup", one_of_each),
    ("substring dedup", without_repeats),
    ("mixing sources to target weights", mixed_sources),
    ("SentencePiece encoding and decoding", tokens),
]

#: SQL cannot say what the stages do; the run is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        path = fresh_path(spark, f"stage{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
