"""Incremental planning and measurement: what a batch re-run with skip-existing does, as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.planning import with_kind


def new_files(listing: DataFrame) -> DataFrame:
    """Files of known kinds out of a streamed listing; the stream's checkpoint remembers what was seen."""
    return with_kind(listing)


def windowed_stats(measurements: DataFrame, time: str, key: str, value: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Per image and time window: n, mean and deviation, for measurements up to ``late`` late."""
    return (
        measurements.withWatermark(time, late)
        .groupBy(F.window(time, window), key)
        .agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("std"))
        .select(F.col("window.start").alias("start"), key, "n", "mean", "std")
    )


def write_increments(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Work off what is there and stop, as a scheduled batch would; Parquet with exactly-once commits."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
