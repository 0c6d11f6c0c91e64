"""Units, sizes and numbers that arrive as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of the micrometre (fixed values; the first has U+00B5).
MICROMETRE = ["µm", "um", "micron"]


def number(text: Column) -> Column:
    """A double, or null where the text is none."""
    return F.trim(text).try_cast("double")


def normalised_unit(unit: Column) -> Column:
    return F.when(unit.isin(MICROMETRE), F.lit("um")).otherwise(unit)


def pixels_per_cm(size: Column, unit: Column) -> Column:
    """Resolution from a pixel size in micrometres; null for other units and for 0."""
    return F.when(unit.isin(MICROMETRE), F.try_divide(F.lit(1.0), size * 0.0001))


def rational(numerator: Column, denominator: Column) -> Column:
    """A tag's ratio; 0 where the denominator is 0."""
    return F.when(denominator != 0, numerator / denominator).otherwise(F.lit(0.0))


def megabytes(size: Column) -> Column:
    return size / (1024.0 * 1024.0)


def gigabytes(size: Column) -> Column:
    return size / (1024.0 * 1024.0 * 1024.0)


def size_text_mb(text: Column) -> Column:
    """Megabytes of a text such as 8.8GB, 622MB or 0MB."""
    value = number(F.regexp_extract(text, r"^([0-9.]+)", 1))
    unit = F.upper(F.regexp_extract(text, r"([A-Za-z]+)$", 1))
    return F.when(unit == "GB", value * 1024).when(unit == "MB", value).when(unit == "KB", value / 1024)


def dimensions(text: Column) -> tuple[Column, Column]:
    """Width and height of a text such as 47555x22628."""
    parts = F.split(text, "x")
    return F.get(parts, F.lit(0)).try_cast("bigint"), F.get(parts, F.lit(1)).try_cast("bigint")


def usable_size(text: Column) -> Column:
    """Whether a pixel size is there, parses and is positive (infinity is, NaN is not)."""
    value = number(text)
    return F.coalesce((value > 0) & ~F.isnan(value), F.lit(False))
