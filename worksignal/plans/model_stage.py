"""Model calls as a table contract: requests out, responses in, checked before use.

requests: (tenant_id, stage, unit_key, system_text, user_text). `infer` runs any callable
over them, or the responses come from elsewhere. A unit without an accepted response stays
unprocessed and comes up again in the next run. A unit too long for one request is asked in pages
(`page_key`), each a request of its own, and is accepted when all its pages are.

An answer may be `Remembered`: then what was answered before, in this run or another, is looked up by the
request's content and not asked again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worksignal import schemas
from worksignal.functions.payload import extract_json, leaf_text, schema_errors
from worksignal.functions.text import let
from worksignal.session import discard, exists, fresh_path, settle

_KEYS = ["tenant_id", "stage", "unit_key"]
_PAGE = " \\(page (\\d+)\\)$"
_BATCH_BYTES = 16 << 20
PAGE_ITEMS = 1 << 22  # more than a page's answer has in a category
_STORED = "key string, model string, stage string, response string, error string, call string, asked_at timestamp"


class Remembered(NamedTuple):
    """A callable whose answers are kept in the table at `path`, by `model` and the request's content.

    Requests are asked in waves of about `wave`, each stored before the next is asked: a job that dies
    loses one wave's answers at most. After the first two, waves are asked in rounds of as many waves as are stored by then. A
    round is one job, whose tasks together hold one wave at a time and whose answers are stored as each task ends.
    """

    answer: Callable[[str, str], str]
    path: str
    model: str = ""
    wave: int = 10_000


def requests(units: DataFrame, stage: str, system_text: str) -> DataFrame:
    """Requests from (tenant_id, unit_key, user_text) rows."""
    return units.select(
        "tenant_id", F.lit(stage).alias("stage"), "unit_key",
        F.lit(system_text).alias("system_text"), "user_text",
    )


def page_key(unit: Column, page: Column) -> Column:
    """The request key of a unit's page; the first page has the unit's own."""
    return F.when(page == 0, unit).otherwise(F.concat(unit, F.lit(" (page "), (page + 1).cast("string"), F.lit(")")))


def _page(key: Column) -> Column:
    return F.coalesce(F.regexp_extract(key, _PAGE, 1).try_cast("bigint") - 1, F.lit(0))


def whole_units(accepted: DataFrame, rejected: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of units from those of their pages.

    `pages`: (tenant_id, unit_key, n_pages). Accepted are the pages, with `page`, of units that all pages are accepted
    of; a unit with rejected pages has the errors of the first.
    """
    def placed(df):
        return df.withColumn("page", _page(F.col("unit_key"))).withColumn("unit_key", F.regexp_replace("unit_key", _PAGE, ""))

    good, bad = placed(accepted), placed(rejected)
    whole = (
        good.groupBy("tenant_id", "unit_key").agg(F.count_distinct("page").alias("n_good"))
        .join(pages, ["tenant_id", "unit_key"]).filter("n_good = n_pages").select("tenant_id", "unit_key")
    )
    return good.join(whole, ["tenant_id", "unit_key"], "left_semi"), bad.groupBy(*_KEYS).agg(F.min_by("errors", "page").alias("errors"))


def infer(reqs: DataFrame, answer: Callable[[str, str], str]) -> DataFrame:
    """Responses of `answer(system_text, user_text)`; a failing call yields its error, not a failed job.

    Batches are cut by bytes, since texts may be long.
    """
    reqs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", _BATCH_BYTES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            outcomes = []
            for system_text, user_text in zip(batch.system_text, batch.user_text):
                try:
                    outcomes.append((answer(system_text, user_text), None))
                except Exception as error:
                    outcomes.append((None, f"{type(error).__name__}: {error}"))
            out = batch[_KEYS].copy()
            out["response"] = [o[0] for o in outcomes]
            out["error"] = [o[1] for o in outcomes]
            yield out

    return reqs.mapInPandas(run, schemas.RESPONSES)


def ask(
    reqs: DataFrame, answer: Callable[[str, str], str] | Remembered, tasks: int | None = None,
    fits: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Responses written to the shared folder, so that no request is ever asked twice.

    Requests are few bytes and much waiting: they are dealt out over `tasks` tasks by number (as many
    as the cluster runs at once), not by size.

    Everything later reads the stored answers: recomputing a lost partition downstream, or using
    the responses in several places, does not call the model again. With a `Remembered` answer, that holds
    across jobs for stored responses that `fits` holds of; others are asked for anew.
    """
    n = tasks or reqs.sparkSession.sparkContext.defaultParallelism
    if isinstance(answer, Remembered):
        return _ask_once(reqs, answer, n, fits)
    return settle(infer(reqs.repartition(n), answer))


def request_key(model: str) -> Column:
    """Digest of all that the answer depends on."""
    return F.sha2(F.to_json(F.array(F.lit(model), *[F.coalesce(c, F.lit("")) for c in ("stage", "system_text", "user_text")])), 256)


def stored_answers(spark: SparkSession, path: str) -> DataFrame:
    """(key, model, stage, response, error, call, asked_at) of a store of answers; none where there is no store yet."""
    return spark.read.schema(_STORED).parquet(path) if exists(spark, path) else spark.createDataFrame([], _STORED)


def _ask_once(reqs: DataFrame, memory: Remembered, tasks: int, fits: Callable[[Column], Column] | None) -> DataFrame:
    spark, call = reqs.sparkSession, uuid.uuid4().hex
    fine = F.col("response").isNotNull() if fits is None else F.coalesce(fits(F.col("response")), F.lit(False))
    keyed = settle(reqs.withColumn("key", request_key(memory.model)))
    known = settle(
        stored_answers(spark, memory.path).filter(fine).groupBy("key").agg(F.min_by("response", F.struct("asked_at", "call")).alias("response"))
        .join(keyed.select("key").distinct(), "key", "left_semi")
    )
    open_ones = keyed.dropDuplicates(["key"]).join(known, "key", "left_anti").select(
        F.lit("").alias("tenant_id"), "stage", F.col("key").alias("unit_key"), "system_text", "user_text"
    )
    open_ones = settle(open_ones)
    waves = -(-open_ones.count() // memory.wave)
    # A folder for each round of waves, so that a round reads its own requests only: waves 0, 1, 2 to 3, 4 to 7 and so on. Fewer
    # tasks than the cluster runs at once say how many requests may be asked at once; then each wave is a round.
    joined = tasks >= spark.sparkContext.defaultParallelism
    path = fresh_path(spark, "waves")
    if waves:
        number = F.pmod(F.xxhash64("unit_key"), F.lit(waves)).cast("int")
        at = F.when(F.col("wave") > 0, F.length(F.bin("wave"))).otherwise(0) if joined else F.col("wave")
        open_ones.withColumn("wave", number).repartition("wave").withColumn("round", at).drop("wave").write.partitionBy("round").parquet(path)
    for k in range((waves - 1).bit_length() + 1 if joined else waves):
        if not exists(spark, f"{path}/round={k}"):  # few requests may leave a wave without any
            continue
        some = spark.read.schema(open_ones.schema).parquet(f"{path}/round={k}")
        together = min(1 << (k - 1), waves - (1 << (k - 1))) if joined and k > 1 else 1
        dealt = some.repartition(tasks) if together == 1 else some.repartition(together * tasks, "unit_key")
        told = infer(dealt, memory.answer).select(
            F.col("unit_key").alias("key"), F.lit(memory.model).alias("model"), "stage", "response", "error", F.lit(call).alias("call"),
            F.current_timestamp().alias("asked_at"),
        )
        if together == 1:
            told.repartition(1).write.mode("append").parquet(memory.path)
        else:  # by version 2 a task's answers are in their place once it ends, and stay there if the job fails
            told.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(memory.path)
    if waves:
        discard(spark, path)
    told = stored_answers(spark, memory.path).filter(F.col("call") == call).select("key", "response", "error")
    told = told.unionByName(known.withColumn("error", F.lit(None).cast("string")))
    return settle(keyed.select(*_KEYS, "key").join(told, "key").select(*_KEYS, "response", "error"))


def satisfies(required: dict) -> Callable[[Column], Column]:
    """Whether a response holds JSON that meets the schema; for `ask`."""
    return lambda response: F.size(schema_errors(extract_json(response), required)) == 0


def ask_and_check(reqs: DataFrame, answer, required: dict) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) responses; a remembered one that would be rejected is asked for anew."""
    return check(ask(reqs, answer, fits=satisfies(required)), required)


def check(responses: DataFrame, required: dict) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected). Accepted rows carry the JSON as `payload`; rejected ones their `errors`.

    The outcome is settled: each response is unwrapped and checked once, however often its outcome is read.
    """
    def outcome(payload):
        errors = (
            F.when(F.col("error").isNotNull(), F.array("error"))
            .when(F.col("response").isNull(), F.array(F.lit("No response")))
            .otherwise(schema_errors(payload, required))
        )
        return F.struct(payload.alias("payload"), errors.alias("errors"))

    rated = settle(responses.select(*_KEYS, let(extract_json(F.col("response")), outcome).alias("o")).select(*_KEYS, "o.*"))
    accepted = rated.filter(F.size("errors") == 0).select(*_KEYS, "payload")
    return accepted, rated.filter(F.size("errors") > 0).select(*_KEYS, "errors")


def payload_items(accepted: DataFrame) -> DataFrame:
    """One row per item: (keys, category, ordinal, payload, text).

    Any top-level key is a category; a value that is no list is its single item. Text holds the
    item's string leaves only, never its keys; a string is its own text, whatever it looks like.
    Items of a later `page` of the unit, where there is one, come after those of the earlier ones.
    """
    at = _KEYS if "page" not in accepted.columns else [*_KEYS, "page"]
    parsed = F.try_variant_get(F.try_parse_json("payload"), "$", "map<string,variant>")
    categories = accepted.withColumn("parsed", parsed).select(
        *at, "parsed", F.explode_outer(F.from_json("payload", "map<string,string>")).alias("category", "value")
    )
    typed = categories.withColumn("typed", F.element_at("parsed", F.col("category")))
    is_list = F.schema_of_variant(F.col("typed")).startswith("ARRAY")
    inner = F.try_variant_get(F.col("typed"), "$", "array<variant>")
    kinds = F.when(is_list, F.transform(inner, F.schema_of_variant)).otherwise(F.array(F.schema_of_variant(F.col("typed"))))
    listed = F.when(is_list, F.from_json("value", "array<string>")).otherwise(F.array("value"))
    rows = typed.select(*at, "category", F.posexplode_outer(F.arrays_zip(listed.alias("payload"), kinds.alias("kind"))).alias("pos", "i"))
    nested = F.col("i.kind").startswith("OBJECT") | F.col("i.kind").startswith("ARRAY")
    return rows.filter("i.payload IS NOT NULL").select(
        *_KEYS,
        "category",
        (F.col("pos").cast("bigint") + (F.col("page") * PAGE_ITEMS if "page" in at else F.lit(0))).alias("ordinal"),
        F.col("i.payload").alias("payload"),
        F.when(nested, leaf_text(F.col("i.payload"))).otherwise(F.col("i.payload")).alias("text"),
    )
