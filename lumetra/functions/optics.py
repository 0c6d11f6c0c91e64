"""Densitometry and geometry on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Genome sizes of reference cells in picograms (fixed values).
STANDARDS = {"chicken": 1.25, "trout": 2.60}


def optical_density(pixel: Column, background: Column, floor: float = 1.0) -> Column:
    """log10(background / pixel); pixels are raised to ``floor``, and as bright as the background give 0."""
    raised = F.greatest(pixel, F.lit(floor))
    return F.when(raised >= background, F.lit(0.0)).otherwise(F.log10(background / raised))


def circle_radius(area: Column) -> Column:
    """Whole radius of the circle of an area, cut towards zero; null for a negative or missing area."""
    return F.when((area >= 0) & ~F.isnan(area), F.sqrt(area / F.pi())).try_cast("int")


def whole(value: Column) -> Column:
    """A double cut towards zero; null where it is no number."""
    return F.when(~F.isnan(value), value).try_cast("int")


def coefficient_of_variation(mean: Column, deviation: Column) -> Column:
    """In percent; 0 unless the mean is positive."""
    return F.when((mean > 0) & ~F.isnan(mean), deviation / mean * 100).otherwise(F.lit(0.0))


def genome_size(unknown: Column, standard: Column, standard_size: Column) -> Column:
    """Picograms of an unknown from its density, a standard's density and the standard's size."""
    return F.try_divide(unknown, standard) * standard_size


def area_um2(pixels: Column, pixel_size: Column) -> Column:
    return pixels * pixel_size * pixel_size


def inverted(value: Column, top: float = 255.0) -> Column:
    """1 - value on the unit scale, held to it; what is no number is 0."""
    unit = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - value / F.lit(top)))
    return F.coalesce(F.when(F.isnan(unit), F.lit(0.0)).otherwise(unit), F.lit(0.0))
