"""Session factory and the shared scratch folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app_name: str = "worksignal", **conf) -> SparkSession:
    """A session with the settings the operators rely on; a cluster's own settings win where given.

    UTC pins day keys, dynamic partition overwrite makes a ledger write replace only the
    partitions it touches, and adaptive execution coalesces partitions and splits skewed joins.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app_name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: `spark.checkpoint.dir`, or a scratch folder in local tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(scratch)
    spark.conf.set("spark.checkpoint.dir", scratch)
    return scratch


def settle(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read from there.

    For results that are small beside their input and used in several places: their plan is not
    repeated in every later one, and an executor lost afterwards costs no recomputation.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """The rows over as many tasks at least as the cluster runs at once.

    For costly work on each row of an input that comes in fewer splits, such as one small file; an
    input of enough splits stays as it is.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    last = df.select(F.spark_partition_id().alias("part")).agg(F.max("part")).first()[0]
    return df if last is not None and last + 1 >= wanted else df.repartition(wanted)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder below the shared folder whose rows no later step reads."""
    if not path.startswith(shared_dir(spark) + "/"):
        raise ValueError("only folders below the shared folder are deleted")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nobody holds any more.

    It does so once the driver's collectors have seen that they are unreachable, which on a driver of little
    load may be long after a step of a job of many steps is over and settled.
    """
    gc.collect()  # Python's frames hold those of the JVM
    spark._jvm.System.gc()
