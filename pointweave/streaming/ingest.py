"""Streams: stateless filters as they are, thinning with state, ingest by batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import ascii


def text_stream(spark: SparkSession, folder: str, layout) -> DataFrame:
    """Points of text files as they arrive in a folder."""
    layout = ascii.LAYOUTS[layout] if isinstance(layout, str) else layout
    return ascii.parse_lines(spark.readStream.text(folder), layout)


def thin_stream(points: DataFrame, side: float, time: str, lateness: str) -> DataFrame:
    """One point for each cell within the watermark's reach."""
    keyed = points.withColumns({f"c{a}": F.floor(F.col(a) / side) for a in "xyz"})
    return keyed.withWatermark(time, lateness).dropDuplicatesWithinWatermark(["cx", "cy", "cz"]).drop("cx", "cy", "cz")


def thin_sequentially(points: DataFrame, d: float, key: str) -> DataFrame:
    """Drops points within ``d`` on every axis of the last kept one of their
    ``key``; the state is that point. Points come in order of point_id within a batch."""
    names = points.columns

    def scan(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = np.array(state.get) if state.exists else None
        pdf = pd.concat(list(frames)).sort_values("point_id", kind="stable")
        keep = []
        for p in pdf[["x", "y", "z"]].to_numpy(float):
            fresh = last is None or bool((np.abs(p - last) >= d).any())
            keep.append(fresh)
            last = p if fresh else last
        if last is not None:
            state.update(tuple(map(float, last)))
        yield pdf[np.array(keep, bool)][names]

    return points.groupBy(key).applyInPandasWithState(scan, points.schema, "x double, y double, z double", "append", GroupStateTimeout.NoTimeout)


def cell_counts(points: DataFrame, side: float, time: str, window: str, lateness: str) -> DataFrame:
    """Points per cell and tumbling window of event time."""
    cell = [F.floor(F.col(a) / side).alias(f"c{a}") for a in "xyz"]
    return points.withWatermark(time, lateness).groupBy(F.window(time, window), *cell).agg(F.count(F.lit(1)).alias("n"))


def append_to(points: DataFrame, path: str, checkpoint: str, batch_column: str = "batch"):
    """Writes each batch as its own partition, so a repeated batch replaces itself."""

    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{batch_column}={number}")

    return points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
