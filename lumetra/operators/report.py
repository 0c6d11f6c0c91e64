"""Corpus reports: categories, directories, alternatives, what is lost, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.optics import coefficient_of_variation
from .ranking import global_rank, percentiles


def category_counts(files: DataFrame, category: str) -> DataFrame:
    """Files of each category, and of all as category 'TOTAL'."""
    return files.rollup(category).agg(F.count(F.lit(1)).alias("n"), F.grouping(category).alias("_all")).select(F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col(category)).alias(category), "n")


def numbered_by_directory(files: DataFrame, directory: str, name: str) -> DataFrame:
    """Each file with its place (from 1) among the names of its directory, however many these are."""
    ranked = global_rank(files.select(directory, name), [directory, name])
    first = ranked.groupBy(directory).agg(F.min("rank").alias("_first"))
    return ranked.join(first, directory).select(directory, name, (F.col("rank") - F.col("_first") + 1).alias("place"))


def by_directory(files: DataFrame, directory: str, name: str) -> DataFrame:
    """Each directory with its file names in order, in one row: for directories of few files."""
    return files.groupBy(directory).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list(name)), ",").alias("names"))


def manifest(*parts: DataFrame) -> DataFrame:
    """All parts one under another; columns a part lacks are null."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def alternatives(broken: DataFrame, others: DataFrame, sample: str) -> DataFrame:
    """Broken files that another source of the same sample can replace."""
    return broken.join(others, sample)


def unrecoverable(samples: DataFrame, outputs: DataFrame, sample: str) -> DataFrame:
    return samples.join(outputs.select(sample).distinct(), sample, "left_anti")


def measurement_stats(objects: DataFrame, key: str, value: str, digits: int = 6) -> DataFrame:
    """Per image: n, mean, median, population deviation and variation of a measurement; an image of any size."""
    mean, deviation = F.avg(value), F.stddev_pop(value)
    sums = objects.groupBy(key).agg(F.count(value).alias("n"), F.round(mean, digits).alias("mean"), F.round(deviation, digits).alias("std"), F.round(coefficient_of_variation(mean, deviation), digits).alias("cv"))
    middle = percentiles(objects, value, [key], {"median": 50.0}).withColumnRenamed(key, "_key")
    return sums.join(middle, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, "n", "mean", F.round("median", digits).alias("median"), "std", "cv")


def surviving_parents(parents: DataFrame, children: DataFrame, keys: list[str]) -> DataFrame:
    """Primary objects whose secondary object is there, by image and object."""
    return parents.join(children.select(*keys).distinct(), keys, "left_semi")


def nuclear_ratio(nuclei: DataFrame, cells: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """Nucleus area over cell area, joined by image and object."""
    return nuclei.join(cells, keys).select(*keys, F.round(F.try_divide("nucleus_area", "cell_area"), digits).alias("nc_ratio"))
