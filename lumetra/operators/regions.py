"""Circles over pixels as an equality join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.optics import circle_radius, whole


def circle_cells(circles: DataFrame, key: str, x: str, y: str, area: str, image: str | None = None) -> DataFrame:
    """(object_id, y, x), with ``image`` where it is named, of every cell of each circle; centres and radii are cut to whole numbers.

    Offsets are made inside the row from the radius, a row of cells at a time:
    for each dy the half width is the whole square root of r^2 - dy^2.
    """
    names = [image] if image else []
    placed = circles.select(*names, F.col(key).alias("object_id"), whole(F.col(x)).alias("_cx"), whole(F.col(y)).alias("_cy"), circle_radius(F.col(area)).alias("_r")).filter("_r is not null and _cx is not null and _cy is not null")
    rows = placed.withColumn("_dy", F.explode(F.sequence(-F.col("_r"), F.col("_r"))))
    half = F.floor(F.sqrt((F.col("_r") * F.col("_r") - F.col("_dy") * F.col("_dy")).cast("double"))).cast("int")
    cells = rows.withColumn("_w", half).withColumn("_dx", F.explode(F.sequence(-F.col("_w"), F.col("_w"))))
    return cells.select(*names, "object_id", (F.col("_cy") + F.col("_dy")).alias("y"), (F.col("_cx") + F.col("_dx")).alias("x"))


def region_pixels(circles: DataFrame, pixels: DataFrame, key: str, x: str, y: str, area: str, image: str | None = None) -> DataFrame:
    """Pixels inside each circle, of its own ``image`` where that column is named (in both tables): (object_id, y, x, v).

    What lies outside the image finds no pixel. Both sides are made by explosions, which
    estimates of size do not count: neither is broadcast for being thought small.
    """
    return circle_cells(circles, key, x, y, area, image).hint("merge").join(pixels.hint("merge"), [*([image] if image else []), "y", "x"])


def with_empty_regions(sums: DataFrame, circles: DataFrame, key: str, zeros: list[str], image: str | None = None) -> DataFrame:
    """Every circle, with zeros where it holds no pixel."""
    names = [image] if image else []
    every = circles.select(*names, F.col(key).alias("object_id"))
    filled = every.join(sums, [*names, "object_id"], "left")
    return filled.fillna(0, zeros)
