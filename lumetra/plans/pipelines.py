"""Segmentation pipelines as data: module settings parsed from their text form, and chains of transforms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered_settings(spark: SparkSession, path: str) -> DataFrame:
    """(at, module_num, module, key, value) of a pipeline file: module heads stand at the margin, settings are indented.

    One file is one small configuration; its lines are numbered by their place in it.
    """
    lines = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    head = F.col("line").rlike(r"^[A-Za-z]+:\[")
    w = W.orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = lines.withColumn("module_num", F.sum(F.when(head, 1).otherwise(0)).over(w)).withColumn("module", F.last(F.when(head, F.regexp_extract("line", r"^([A-Za-z]+):", 1)), ignorenulls=True).over(w))
    inner = marked.filter(~head & F.col("line").rlike(r"^\s+\S") & (F.col("module_num") > 0))
    text = F.trim("line")
    return inner.select("at", "module_num", "module", F.regexp_extract(text, r"^([^:]*):", 1).alias("key"), F.regexp_replace(text, r"^[^:]*:", "").alias("value"))


def settings(spark: SparkSession, path: str) -> DataFrame:
    """(module_num, module, key, value) of a pipeline file."""
    return numbered_settings(spark, path).drop("at")


def chain(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Transforms in the order of their modules."""
    for step in steps:
        df = df.transform(step)
    return df
