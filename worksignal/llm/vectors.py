"""Vectors as packed bytes: which take part, equal ones as one node, blocks as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def takes_part(vector: Column) -> Column:
    """Neither NULL nor empty nor zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def element_type(df: DataFrame, column: str) -> str:
    """numpy's name of the components: f4 as it is, all others as f8."""
    return "f4" if dict(df.dtypes)[column] == "array<float>" else "f8"


def packed(df: DataFrame, column: str, kind: str) -> DataFrame:
    """The column's arrays as bytes in the column `vec`; the rows must all take part. Equal arrays give equal bytes."""
    wide = df.withColumn(column, F.col(column).cast("array<float>" if kind == "f4" else "array<double>"))
    place = wide.columns.index(column)
    rest = [c for c in wide.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = batch.column(place)
            values = np.ascontiguousarray(arrays.flatten().to_numpy(zero_copy_only=False).astype(kind) + 0)  # no -0
            lengths = arrays.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) * values.itemsize
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            vec = pa.BinaryArray.from_buffers(pa.binary(), len(arrays), [None, pa.py_buffer(offsets), pa.py_buffer(values)])
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != place], vec], [*rest, "vec"])

    return wide.mapInArrow(run, wide.select(*rest, F.lit(b"").alias("vec")).schema)


def matrix(column: pd.Series, kind: str) -> np.ndarray:
    """Rows of packed vectors of one length, in double precision."""
    return np.frombuffer(b"".join(column), dtype=kind).reshape(len(column), -1).astype(np.float64)
