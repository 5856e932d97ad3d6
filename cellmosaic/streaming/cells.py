"""Cells from a stream of pixels: micro-batches leave partial states, which merge into finished statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from cellmosaic.operators import continuous


def append_states(pixels: DataFrame, by: list[str], path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame]) -> None:
    """Run a streaming query over all data there is: each micro-batch's states go to a folder of its own.

    The folder is named by the batch, so a batch that is run again after a failure replaces its states and nothing counts twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        continuous.partial_states(prepare(batch), by).write.mode("overwrite").parquet(f"{path}/batch={number}")

    pixels.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merged_cells(spark, path: str, by: list[str]) -> DataFrame:
    """Statistics of all batches so far."""
    return continuous.finished(continuous.merge_states(spark.read.parquet(path).drop("batch"), by, salts=16))
