"""From images to measured nuclei to their density, many images at once.

``image_pixels`` gives a pipeline file's modules the pixels of tiled images;
``measured`` names what they measure as measurement files do; ``placed`` and
``image_density`` take such a file back to the images it was measured on.

Defined cases: images are numbered in the order of their keys, those without an
object not at all, and the objects of an image in the order of their first
pixels; an object's image may be told by its path or, where no two images share
it, by its file name alone; one whose image is not there has a null image_id
and null densities; one whose circle has no pixel on its image has zeros; each
image has its own background and its own quality control; empty tables give no
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import base_name
from ..operators import density, tiled
from ..operators.ranking import global_rank
from ..operators.segments import packed_key

#: Names of measurements in exported files (fixed values).
SHAPES = {
    "area": "AreaShape_Area", "center_x": "AreaShape_Center_X", "center_y": "AreaShape_Center_Y", "major_axis": "AreaShape_MajorAxisLength", "minor_axis": "AreaShape_MinorAxisLength",
    "eccentricity": "AreaShape_Eccentricity", "equivalent_diameter": "AreaShape_EquivalentDiameter",
}
INTENSITIES = {"integrated": "IntegratedIntensity", "mean": "MeanIntensity", "std": "StdIntensity", "min": "MinIntensity", "max": "MaxIntensity"}
#: Greatest values of the kinds of pixels.
FULL = {"uint8": 255.0, "uint16": 65535.0}

X, Y, AREA = "AreaShape_Center_X", "AreaShape_Center_Y", "AreaShape_Area"
DENSITIES = ["True_IOD", "Mean_OD", "Max_OD", "Min_OD", "PixelCount"]


def image_pixels(tiles: DataFrame) -> DataFrame:
    """image_id, y, x and v, from 0 to 1, of the tiles (``tiff_tiles``) of one channel."""
    full = F.coalesce(*[F.when(F.col("dtype") == kind, F.lit(most)) for kind, most in FULL.items()], F.raise_error(F.concat(F.lit("no scale for pixels of "), F.col("dtype"))).cast("double"))
    cells = tiles.select("image_id", "y0", "x0", "w", full.alias("_full"), F.posexplode("data").alias("_at", "_v"))
    row = F.floor(F.col("_at") / F.col("w"))
    return cells.select("image_id", (F.col("y0") + row).alias("y"), (F.col("x0") + F.col("_at") - row * F.col("w")).alias("x"), (F.col("_v") / F.col("_full")).alias("v"))


def file_name(column: str) -> str:
    """A measurement's name in a file; other columns keep theirs."""
    kind, _, image = column.partition("_")
    return SHAPES.get(column) or (f"Intensity_{INTENSITIES[kind]}_{image}" if image and kind in INTENSITIES else column)


def measured(table: DataFrame, keys: list[str] = ()) -> DataFrame:
    """keys, ImageNumber, ObjectNumber and what was measured of every object (keys, object_id, ...), under the names of measurement files."""
    keys = list(keys)
    named = table.select(*keys, "object_id", *[F.col(c).alias(file_name(c)) for c in table.columns if c not in (*keys, "object_id")])
    rest = [c for c in named.columns if c not in (*keys, "object_id")]
    if not keys:
        return global_rank(named, ["object_id"]).select(F.lit(1).alias("ImageNumber"), F.col("rank").alias("ObjectNumber"), *rest)
    # a row an image
    numbers = global_rank(named.select(*keys).distinct(), keys).select(packed_key(named, keys).alias("_key"), F.col("rank").alias("ImageNumber"))
    number = F.row_number().over(W.partitionBy("_key").orderBy("object_id")).cast("long")
    return named.withColumn("_key", packed_key(named, keys)).withColumn("ObjectNumber", number).hint("merge").join(numbers, "_key").select(*keys, "ImageNumber", "ObjectNumber", *rest)


def placed(nuclei: DataFrame, column: str, images: DataFrame) -> DataFrame:
    """``nuclei`` with, as image_id, the path of the image (``images``: path) that their ``column`` tells."""
    told = images.select(F.col("path").alias("image_id"), F.explode(F.array_distinct(F.array("path", base_name(F.col("path"))))).alias("_told"))
    told = told.groupBy("_told").agg(F.min("image_id").alias("image_id"), F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")
    # the column may itself be named image_id
    return nuclei.withColumn("_told", F.col(f"`{column}`")).drop("image_id").join(told, "_told", "left").drop("_told")


def image_density(tiles: DataFrame, nuclei: DataFrame, tile: int, percentile: float = 95.0, trim_percent: float = 5.0) -> DataFrame:
    """``nuclei`` (object_id, image_id, centres and areas) with densities, their image's background and QC_Passed, ranked inside each image."""
    level = tiled.tile_background(tiles, percentile)
    sums = tiled.tile_sums(tiles, nuclei, level, "object_id", X, Y, AREA, tile).select("image_id", "object_id", *DENSITIES)
    every = nuclei.join(level.withColumnRenamed("background", "Background_I0"), "image_id", "left").join(sums, ["image_id", "object_id"], "left")
    there = F.col("Background_I0").isNotNull()
    every = every.withColumns({c: F.when(there, F.coalesce(c, F.lit(0))) for c in DENSITIES})
    return density.trimmed(every, ["True_IOD", "object_id"], ["image_id"], trim_percent)
