"""Batch planning: what there is, what is done, what is left, how it went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import base_name, output_sample_key, raw_sample_key, stem
from .ranking import global_rank

#: Patterns of the listings (fixed values; matching is case-sensitive).
RAW_STACKS = r"\.(btf|BTF)$"
TIFFS = r"\.(tiff|tif)$"
SLIDES = r"\.(vsi|VSI)$"


def of_kind(files: DataFrame, pattern: str, path: str = "path") -> DataFrame:
    """Distinct paths of a kind."""
    return files.filter(F.col(path).rlike(pattern)).dropDuplicates([path])


def with_kind(files: DataFrame, path: str = "path") -> DataFrame:
    p = F.col(path)
    return files.withColumn("kind", F.when(p.rlike(RAW_STACKS), "btf").when(p.rlike(SLIDES), "vsi").when(p.rlike(TIFFS), "tiff")).filter("kind is not null")


def visible_images(files: DataFrame, path: str = "path") -> DataFrame:
    """Images outside hidden directories."""
    return files.filter(~F.col(path).rlike(r"[\\/]\.") & F.lower(F.col(path)).rlike(r"\.(btf|tiff?|png|jpe?g|bmp|gif)$"))


def named_like(files: DataFrame, part: str, path: str = "path") -> DataFrame:
    """Images whose file name holds a text, in the order of their paths: one set of images."""
    return files.filter(F.contains(base_name(F.col(path)), F.lit(part))).orderBy(path)


def only_kinds(files: DataFrame, raw_only: bool = False, slides_only: bool = False) -> DataFrame:
    """The two switches; both together leave nothing."""
    if raw_only:
        files = files.filter("kind = 'btf'")
    if slides_only:
        files = files.filter("kind = 'vsi'")
    return files


def missing_outputs(candidates: DataFrame, output: Column, existing: DataFrame, path: str = "path", least_bytes: int | None = None, length: str = "length") -> DataFrame:
    """Candidates whose output is not there, or with ``least_bytes`` not larger than that."""
    done = existing if least_bytes is None else existing.filter(F.col(length) > least_bytes)
    done = done.select(F.col(path).alias("_done")).distinct()
    return candidates.withColumn("_output", output).join(done, F.col("_output") == F.col("_done"), "left_anti").drop("_output")


def missing_samples(candidates: DataFrame, existing: DataFrame, path: str = "path", *, compat: bool = False) -> DataFrame:
    """Candidates (with ``kind``) whose sample has no output, across formats.

    ``compat``: outputs keep '_raw' in their key, so a raw stack's own output
    never counts. Otherwise both sides drop it.
    """
    own = F.when(F.col("kind") == "btf", raw_sample_key(F.col(path))).otherwise(stem(F.col(path)))
    key = output_sample_key(F.col(path))
    done = existing.select((key if compat else F.replace(key, F.lit("_raw"), F.lit(""))).alias("_done")).distinct()
    return candidates.withColumn("sample", own).join(done, F.col("sample") == F.col("_done"), "left_anti")


def in_order(files: DataFrame, path: str = "path") -> DataFrame:
    """Raw stacks before slides, each by path, with ``position`` from 1."""
    return global_rank(files, ["kind", path]).withColumnRenamed("rank", "position")


def succeeded(return_code: Column, output_bytes: Column, *, by_output: bool = True) -> Column:
    """An output of more than 1000 bytes wins over the return code (``by_output``); else the code decides."""
    done = F.coalesce(return_code == 0, F.lit(False))
    return done | F.coalesce(output_bytes > 1000, F.lit(False)) if by_output else done


def tally(results: DataFrame, status: str) -> DataFrame:
    return results.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def per_minute(completed: Column, seconds: Column) -> Column:
    return F.coalesce(F.try_divide(completed * 60.0, seconds), F.lit(0.0))


def compression_ratio(input_gb: Column, output_mb: Column) -> Column:
    return F.try_divide(input_gb * 1024.0, output_mb)


def listed_in(files: DataFrame, names: DataFrame, path: str = "path", name: str = "value") -> DataFrame:
    """Files named in a list, by whole path."""
    return files.join(names.select(F.trim(name).alias("_listed")).filter("_listed <> ''").distinct(), F.col(path) == F.col("_listed"), "left_semi")


def series_of(lines: DataFrame, order: str, text: str, keys: list[str] = ()) -> DataFrame:
    """Series with width and height out of a text report: a running count of 'Series #' lines names the series."""
    from pyspark.sql import Window as W

    t = F.trim(F.col(text))
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = lines.withColumn("series", F.sum(F.when(t.startswith("Series #"), 1).otherwise(0)).over(w) - 1).filter("series >= 0")
    value = lambda name: F.max(F.when(t.startswith(f"{name} ="), F.trim(F.substring_index(t, "=", -1)).try_cast("int")))
    return marked.groupBy(*keys, "series").agg(value("Width").alias("width"), value("Height").alias("height"))


def is_slide(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1)) == ".vsi"
