"""What streaming queries tell of each batch, as a table: rows in, rows kept in state, rows dropped as late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.readwriter import DataStreamWriter

from worksignal.session import exists

PROGRESS = (
    "query_id string, run_id string, name string, batch_id bigint, at string, input_rows bigint, watermark string, "
    "operator int, state_rows bigint, late_rows bigint"
)


def rows_of(progress) -> list[tuple]:
    """Rows of one batch's progress, one for each stateful operator or, without any, one with NULLs."""
    base = (
        str(progress.id), str(progress.runId), progress.name, progress.batchId, progress.timestamp, progress.numInputRows,
        dict(progress.eventTime or {}).get("watermark"),
    )
    found = [(*base, k, op.numRowsTotal, op.numRowsDroppedByWatermark) for k, op in enumerate(progress.stateOperators)]
    return found or [(*base, None, None, None)]


class ProgressLog(StreamingQueryListener):
    """Appends every batch's progress to the table at `path`; for `spark.streams.addListener`."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self._path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        append(self._spark, rows_of(event.progress), self._path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def append(spark: SparkSession, rows: list[tuple], path: str) -> None:
    """A batch's few rows, as one small file."""
    spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(path)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """The table that `ProgressLog` or `run_logged` wrote, each batch once; empty where there is none."""
    rows = spark.read.schema(PROGRESS).parquet(path) if exists(spark, path) else spark.createDataFrame([], PROGRESS)
    return rows.dropDuplicates(["run_id", "batch_id", "operator"])


def run_logged(writer: DataStreamWriter, path: str | None = None) -> None:
    """Run a query to its end and append the progress of its batches to the table at `path`."""
    query = writer.start()
    query.awaitTermination()
    if path is not None:
        rows = [row for progress in query.recentProgress for row in rows_of(progress)]
        if rows:
            append(writer._spark, rows, path)
