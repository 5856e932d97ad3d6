"""Cells of a stream that goes from north to south, each given out once: when the stream has passed the cell's southernmost point.

Latitude takes the place of time. A pixel's time is how far south it lies, the watermark is the horizon (the southernmost latitude
so far, less what disorder is allowed), and a cell's state is kept until the horizon has passed its south bound. So the state holds
the cells that the horizon crosses and no others, however long the stream.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cellmosaic.functions import grids

#: Seconds of stream time for a degree, so that the state's milliseconds are 1e-8 degrees.
SECONDS = 100_000
_STATE = "count double, sum double, min double, max double, m2 double"
_OUT = "cell long, count double, sum double, mean double, stddev double, min double, max double, late long"


def horizon_time(lat: Column) -> Column:
    """A latitude as stream time: later is further south."""
    return F.timestamp_millis(F.floor((F.lit(90.0) - lat) * (SECONDS * 1000)))


def south_bound(grid: str, cell: int) -> float:
    """A latitude that no point of a cell is south of; sides may bulge beyond their ends."""
    y = grids.grid(grid).planar(np.array([cell], dtype=np.int64))[1][0]
    return max(-90.0, float(y.min() - 0.2 * (y.max() - y.min()) - 1e-9))


def _merged(state: tuple[float, ...], value: np.ndarray) -> tuple[float, ...]:
    n, s, low, high, m2 = state
    k, t = float(len(value)), float(value.sum())
    own = float(((value - t / k) ** 2).sum())
    apart = (t / k - s / n) ** 2 * n * k / (n + k) if n else 0.0
    return n + k, s + t, min(low, float(value.min())), max(high, float(value.max())), m2 + own + apart


def horizon_cells(pixels: DataFrame, grid: str, resolution: int, disorder: float = 0.0) -> DataFrame:
    """Finished statistics of cells from streaming pixels (lon, lat, value), for append mode: each cell once.

    Pixels may come north of the horizon by up to `disorder` degrees. Pixels of a cell that has been given out are too late: they make a
    row of their own with nulls and their number in `late`, which is 0 for cells; those that lie further behind Spark drops and counts
    (numRowsDroppedByWatermark). A pixel south of the globe, as end_of_raster() makes, ends the stream: what is left is given
    out. Null and not finite values are no samples; a cell of such alone is not given out.
    """
    own = grids.grid(grid)
    at = pixels.select(own.lonlat_to_cell(F.col("lon"), F.col("lat"), resolution).alias("cell"), F.col("lat"), F.col("value").cast("double").alias("value"), horizon_time(F.col("lat")).alias("at"))
    timed = at.withWatermark("at", f"{math.ceil(disorder * SECONDS)} seconds")

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, s, low, high, m2 = state.get
            state.remove()
            deviation = math.sqrt(max(m2, 0.0) / (n - 1)) if n > 1 else 0.0
            yield pd.DataFrame([(int(key[0]), n, s, s / n, deviation, low, high, 0)], columns=columns)
            return
        if pd.isna(key[0]):
            return
        until = int((90.0 - south_bound(grid, int(key[0]))) * SECONDS * 1000)
        passed, late = not state.exists and until < state.getCurrentWatermarkMs(), 0
        now = state.get if state.exists else (0.0, 0.0, math.inf, -math.inf, 0.0)
        for pdf in batches:
            value = pdf["value"].to_numpy(dtype=np.float64)
            value = value[np.isfinite(value)]
            late += len(value) if passed else 0
            if len(value) and not passed:
                now = _merged(now, value)
        if late:
            yield pd.DataFrame([(int(key[0]), *[None] * 6, late)], columns=columns).astype({c: "float64" for c in columns[1:7]})
        if now[0]:
            state.update(now)
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))

    columns = [c.split()[0] for c in _OUT.split(", ")]
    # the row that ends the stream has no cell, but its time counts
    return timed.groupBy("cell").applyInPandasWithState(advance, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout).filter("cell IS NOT NULL")


def end_of_raster(spark, disorder: float = 0.0) -> DataFrame:
    """A pixel south of all cells, which brings the horizon to the end."""
    return spark.createDataFrame([(0.0, -91.0 - disorder, None)], "lon double, lat double, value double")


def run(pixels: DataFrame, grid: str, resolution: int, path: str, checkpoint: str, disorder: float = 0.0) -> list[dict]:
    """All there is of a stream into files; the progress of its batches."""
    query = horizon_cells(pixels, grid, resolution, disorder).writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return [p if isinstance(p, dict) else dict(p) for p in query.recentProgress]
