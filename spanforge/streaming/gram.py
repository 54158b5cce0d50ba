"""S^T S of a tensor whose rows arrive as a stream.

Each micro-batch adds its partial sums, at most columns x columns rows, to a table keyed by the batch's number, so a
batch that is run again replaces its own sums and nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanforge.operators.linalg import matrix_of


def partial_gram(rows: DataFrame) -> DataFrame:
    """i, j, g of rows with a column v; each task sends one partial sum for each pair of columns."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                m = matrix_of(batch.column(0), len(batch.column(0)[0]))
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            i, j = np.indices(total.shape, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "g"])

    return rows.select("v").mapInArrow(partial, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))


def stream_gram(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    def add(batch: DataFrame, number: int) -> None:
        partial_gram(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_gram(rows_read: DataFrame) -> DataFrame:
    """The sums so far; ``rows_read``: the table below ``folder``."""
    return rows_read.groupBy("i", "j").agg(F.sum("g").alias("g"))
