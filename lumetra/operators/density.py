"""Integrated optical density: background, per-object sums, quality control, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.optics import coefficient_of_variation, optical_density
from .ranking import global_rank, percentiles

DIGITS = 6


def background(pixels: DataFrame, value: str, keys: list[str] = (), percentile: float = 95.0) -> DataFrame:
    """Linearly interpolated high percentile, per image where keys are given.

    Values are counted first, and the counts partially aggregated. Whole numbers
    have few levels (at most 256 an image at 8 bits), so an image's histogram
    is sorted where it lies; images of fractions may have as many levels as
    pixels, and go through ranks over range partitions.
    """
    if keys and isinstance(pixels.schema[value].dataType, (T.FractionalType, T.DecimalType)):
        return percentiles(pixels, value, list(keys), {"background": percentile})
    counts = pixels.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.percentile(F.col(value), percentile / 100.0, F.col("_n")).alias("background"))


def ranked_percentile(pixels: DataFrame, value: str, percentile: float = 95.0) -> DataFrame:
    """The same over the whole table for values of any number of levels, from ranks by range partitions."""
    ranked = global_rank(pixels.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"), F.monotonically_increasing_id().alias("_id")), ["_v", "_id"])
    at = (F.col("total") - 1) * (percentile / 100.0) + 1
    near = ranked.filter((F.col("rank") >= F.floor(at)) & (F.col("rank") <= F.ceil(at)))
    # one or two rows are left
    low, high, part = F.min("_v"), F.max("_v"), F.max(at - F.floor(at))
    return near.agg((low + (high - low) * part).alias("background"))


#: Rows that a task joins, sums up and ranks at once.
DEALT_ROWS = 1 << 20


def dealt(pixels: DataFrame, levels: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables by ``keys`` over tasks of a bounded number of pixels (all of one key in one task); counts these, so give it a table that is cheap to read.

    Partitions are otherwise put together by their compressed bytes, and small numbers take twenty times those in memory.
    The tables are dealt alike, as a join takes the number of either.
    """
    n = -(-pixels.count() // DEALT_ROWS)
    if n <= 4:
        return pixels, levels
    n = max(n, int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return pixels.repartition(n, *keys), levels.repartition(n, *keys)


def with_background(pixels: DataFrame, levels: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Every pixel with its image's background; without keys there is one level for all."""
    if not keys:
        return pixels.crossJoin(F.broadcast(levels))  # one row
    return pixels.join(levels, list(keys))


def densities(pixels: DataFrame, value: str, floor: float = 1.0) -> DataFrame:
    return pixels.withColumn("od", optical_density(F.col(value), F.col("background"), floor))


def object_density(pixels: DataFrame, keys: list[str], digits: int = DIGITS) -> DataFrame:
    """Density totals of every object from its pixels (columns ``od`` and ``background``)."""
    return pixels.groupBy(*keys).agg(
        F.round(F.sum("od"), digits).alias("True_IOD"),
        F.round(F.avg("od"), digits).alias("Mean_OD"),
        F.round(F.max("od"), digits).alias("Max_OD"),
        F.round(F.min("od"), digits).alias("Min_OD"),
        F.count(F.lit(1)).alias("PixelCount"),
        F.first("background").alias("Background_I0"),
    )


def kept_rank(rank: Column, total: Column, percent: float, least: int = 10) -> Column:
    """Whether a rank (from 1) survives trimming both ends; up to ``least`` objects nothing is trimmed."""
    cut = F.floor(total * F.lit(float(percent)) / 100)
    return ((total <= least) | F.lit(percent <= 0)) | ((rank > cut) & (rank <= total - cut)) | (cut == 0)


def trimmed(objects: DataFrame, order: list[str], keys: list[str] = (), percent: float = 5.0) -> DataFrame:
    """Add ``rank``, ``total`` and ``QC_Passed`` ('Yes' or 'No').

    Ranks within images use a window. Over the whole table they come from
    range partitions and their counts: no task gets all rows.
    """
    if keys:
        by = W.partitionBy(*keys)
        ranked = objects.withColumn("rank", F.row_number().over(by.orderBy(*order)).cast("long")).withColumn("total", F.count(F.lit(1)).over(by))
    else:
        ranked = global_rank(objects, order)
    return ranked.withColumn("QC_Passed", F.when(kept_rank(F.col("rank"), F.col("total"), percent), "Yes").otherwise("No"))


def flag_by_number(objects: DataFrame, number: str, *, compat: bool = True) -> DataFrame:
    """Spread ``QC_Passed`` over equal object numbers, as a set of numbers alone would have it (``compat``)."""
    if not compat:
        return objects
    passed = objects.filter("QC_Passed = 'Yes'").select(F.col(number).alias("_number")).distinct().withColumn("_hit", F.lit(True))
    joined = objects.join(passed, F.col(number) == F.col("_number"), "left")
    return joined.withColumn("QC_Passed", F.when(F.col("_hit"), "Yes").otherwise("No")).drop("_number", "_hit")


def summary(objects: DataFrame, value: str = "True_IOD", keys: list[str] = (), digits: int = DIGITS) -> DataFrame:
    """n, mean, population deviation, variation and range of what passed quality control."""
    mean, deviation = F.avg(value), F.stddev_pop(value)
    return objects.filter("QC_Passed = 'Yes'").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(mean, digits).alias("mean"),
        F.round(deviation, digits).alias("std"),
        F.round(coefficient_of_variation(mean, deviation), digits).alias("cv"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def accepted_samples(stats: DataFrame, least_n: int = 20, most_cv: float = 20.0) -> DataFrame:
    """Samples with objects enough and little variation."""
    return stats.filter((F.col("n") >= least_n) & (F.col("cv") < most_cv))
