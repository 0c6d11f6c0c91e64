"""Images from rows of lines: one tiled TIFF for each image, a band of tiles a group, put together by ``bands``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bands import BANDS, LAYOUTS, write_bands
from .scratch import stored
from .tiff import Layout, packed_band


def write_images(lines: DataFrame, folder: str, tile: int = 512, level: int = 6, resolution: tuple[float, float] | None = None, description: str | None = None, compression: str = "deflate", predictor: int = 1) -> DataFrame:
    """Write rows (image, y, data: bytes of a line as [width, samples], samples) as ``folder/<image>.tiff``, a file appearing whole or not at all.

    Where the rows have a column ``page``, an image is a stack of pages from 0, of one width; heights may differ. Lines of a page must be laid in the order of y from 0,
    none missing; they are 8-bit. What comes back is image, path, bytes; a
    line that is missing or of another width is an error.
    """
    page = (F.col("page") if "page" in lines.columns else F.lit(0)).cast("long").alias("page")
    held = stored(lines.select(F.col("image").cast("long").alias("image"), page, F.col("y").cast("long").alias("y"), F.col("data").cast("binary").alias("data"), F.col("samples").cast("int").alias("samples")))
    size = F.length("data") / F.col("samples")
    # a row a page
    leaves = held.groupBy("image", "page").agg(F.count_distinct("y").alias("lines"), (F.max("y") + 1).alias("height"), F.min("y").alias("_y"), F.min(size).alias("width"), F.max(size).alias("_most"), F.min("samples").alias("samples"), F.max("samples").alias("_samples"), F.count(F.lit(1)).alias("n"))
    leaves = leaves.withColumn("even", (F.col("_y") == 0) & (F.col("lines") == F.col("height")) & (F.col("n") == F.col("height")))
    shapes = leaves.groupBy("image").agg(
        F.array_sort(F.collect_list(F.struct("page", "height"))).alias("leaves"), F.count(F.lit(1)).alias("n"), F.min("page").alias("_page"), (F.max("page") + 1).alias("pages"), F.min("width").alias("width"), F.max("_most").alias("_most"),
        F.min("samples").alias("samples"), F.max("_samples").alias("_samples"), F.bool_and("even").alias("even"),
    ).withColumn("heights", F.transform("leaves", lambda p: p["height"].cast("int"))).withColumn("height", F.get("heights", F.lit(0)).cast("long"))
    even = F.col("even") & (F.col("_page") == 0) & (F.col("n") == F.col("pages")) & (F.col("width") == F.col("_most")) & (F.col("samples") == F.col("_samples"))
    checked = F.when(even, F.col("height")).otherwise(F.raise_error(F.concat(F.lit("lines are missing or uneven in image "), F.col("image").cast("string"))).cast("long"))
    told = {"dtype": F.lit("uint8"), "tile": F.lit(tile), "compression": F.lit(compression), "level": F.lit(level), "predictor": F.lit(predictor), "description": F.lit(description).cast("string")}
    told |= {f"{a}_resolution": F.lit(None if resolution is None else float(resolution[i])).cast("double") for i, a in enumerate("xy")}
    layouts = shapes.select(
        F.col("image").cast("string").alias("key"), F.concat(F.lit(folder.rstrip("/") + "/"), F.col("image").cast("string"), F.lit(".tiff")).alias("output"),
        checked.cast("int").alias("height"), F.col("width").cast("int").alias("width"), "samples", F.col("pages").cast("int").alias("pages"), F.when(F.size(F.array_distinct("heights")) > 1, F.col("heights")).alias("heights"),
    ).withColumns(told)

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("y")
        samples = group["samples"][0].as_py()
        lines = np.stack([np.frombuffer(line, np.uint8).reshape(-1, samples) for line in group["data"].to_pylist()])
        tiles = packed_band(Layout(len(lines), lines.shape[1], "uint8", tile, samples, compression, level, predictor=predictor), lines)
        row = {"key": str(group["image"][0].as_py()), "band": group["band"][0].as_py(), "data": b"".join(tiles), "counts": [len(t) for t in tiles], "message": None, "seconds": 0.0}
        return pa.Table.from_pylist([row], pa.schema([("key", pa.string()), ("band", pa.int32()), ("data", pa.binary()), ("counts", pa.list_(pa.int64())), ("message", pa.string()), ("seconds", pa.float64())]))

    # a group is a band of ``tile`` lines
    before = W.partitionBy("image").orderBy("page").rowsBetween(W.unboundedPreceding, -1)
    firsts = leaves.select("image", "page", F.coalesce(F.sum(F.ceil(F.col("height") / tile)).over(before), F.lit(0)).alias("_first"))
    bands = held.join(firsts, ["image", "page"]).withColumn("band", (F.col("_first") + F.floor(F.col("y") / tile)).cast("int")).groupBy("image", "band").applyInArrow(pack, BANDS)
    done = write_bands(layouts.select(*[c.split()[0] for c in LAYOUTS.split(", ")]), bands)
    return done.select(F.col("key").cast("long").alias("image"), F.col("output").alias("path"), "bytes")
