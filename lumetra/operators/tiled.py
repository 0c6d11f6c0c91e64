"""Density of circles over images that stay in tiles: no pixel becomes a row.

Backgrounds come from histograms that each tile counts for itself. Circles go
to the tiles that they touch, a row a tile with its list of circles, and each
tile sums up its part of every circle; the parts are then added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.optics import circle_radius, whole
from .density import DIGITS

LEVELS = "image_id string, level double, n long"
PARTS = "image_id string, object_id long, od double, most double, least double, n long, background double"


#: Pixels of circles that a task gathers at once.
GATHERED = 1 << 20


def disc(r: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (y, x) of the pixels within ``r``."""
    side = np.arange(-r, r + 1)
    y, x = np.nonzero(side[:, None] ** 2 + side[None, :] ** 2 <= r * r)
    return y - r, x - r


def tile_levels(tiles: DataFrame) -> DataFrame:
    """(image_id, level, n): the values of each tile and how often they occur."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                level, n = np.unique(data.values.to_numpy(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([image] * len(level), pa.string()), pa.array(level.astype(np.float64)), pa.array(n.astype(np.int64))], ["image_id", "level", "n"])

    return tiles.select("image_id", "data").mapInArrow(count, LEVELS)


def tile_background(tiles: DataFrame, percentile: float = 95.0) -> DataFrame:
    """(image_id, background): the linearly interpolated percentile of each image's values."""
    counts = tile_levels(tiles).groupBy("image_id", "level").agg(F.sum("n").alias("n"))
    return counts.groupBy("image_id").agg(F.percentile("level", percentile / 100.0, F.col("n")).alias("background"))


def circles_by_tile(circles: DataFrame, key: str, x: str, y: str, area: str, tile: int) -> DataFrame:
    """(image_id, y0, x0, circles): for each tile the circles whose box touches it.

    A tile holds as many circles as objects fit on its pixels.
    """
    placed = circles.select("image_id", F.col(key).cast("long").alias("object_id"), whole(F.col(x)).alias("cx"), whole(F.col(y)).alias("cy"), circle_radius(F.col(area)).alias("r")).filter("r is not null and cx is not null and cy is not null")
    span = lambda c: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - F.col("r")) / tile)), F.greatest(F.lit(0), F.floor((F.col(c) + F.col("r")) / tile))))
    spread = placed.withColumn("_ty", span("cy")).withColumn("_tx", span("cx"))
    one = F.struct("object_id", "cx", "cy", "r")
    return spread.groupBy("image_id", (F.col("_ty") * tile).cast("int").alias("y0"), (F.col("_tx") * tile).cast("int").alias("x0")).agg(F.collect_list(one).alias("circles"))


def tile_sums(tiles: DataFrame, circles: DataFrame, backgrounds: DataFrame, key: str, x: str, y: str, area: str, tile: int, floor: float = 1.0) -> DataFrame:
    """(image_id, object_id, True_IOD, Mean_OD, Max_OD, Min_OD, PixelCount, Background_I0) of circles with a pixel on their image."""
    wanted = circles_by_tile(circles, key, x, y, area, tile)
    # circles were exploded and gathered again: what they are thought to take says nothing
    met = tiles.select("image_id", "y0", "x0", "h", "w", "data").join(wanted.hint("merge"), ["image_id", "y0", "x0"]).join(backgrounds, "image_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [batch.column(c).to_pylist() for c in (0, 1, 2, 3, 4, 7)]
            ends = np.append(0, np.cumsum(batch.column(6).value_lengths().to_numpy()))
            flat = batch.column(6).flatten()
            circle = {c: flat.field(c).to_numpy() for c in ("object_id", "cy", "cx", "r")}
            for i, (image, y0, x0, h, w, background) in enumerate(zip(*places, strict=True)):
                values = batch.column(5)[i].values.to_numpy().reshape(h, w)
                own = slice(ends[i], ends[i + 1])
                top, left, radius, ids = circle["cy"][own] - y0, circle["cx"][own] - x0, circle["r"][own], circle["object_id"][own]
                for r in np.unique(radius).tolist():
                    # what lies within r, once for all circles of this radius
                    dy, dx = (d.astype(np.int64) for d in disc(r))
                    same = np.flatnonzero(radius == r)
                    for begin in range(0, len(same), max(1, GATHERED // len(dy))):
                        some = same[begin : begin + max(1, GATHERED // len(dy))]
                        y, x = top[some, None] + dy, left[some, None] + dx
                        inside = (y >= 0) & (y < h) & (x >= 0) & (x < w)
                        n = inside.sum(axis=1)
                        hit = n > 0
                        raised = np.maximum(values[y[inside], x[inside]].astype(np.float64), floor)
                        od = np.where(raised >= background, 0.0, np.log10(background / raised))
                        at = np.append(0, np.cumsum(n[hit]))[:-1]
                        if len(od):
                            sums = [f.reduceat(od, at) for f in (np.add, np.maximum, np.minimum)]
                            m = int(hit.sum())
                            arrays = [pa.array([image] * m, pa.string()), pa.array(ids[some[hit]]), *map(pa.array, sums), pa.array(n[hit]), pa.array([background] * m, pa.float64())]
                            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in PARTS.split(", ")])

    parts = met.select("image_id", "y0", "x0", "h", "w", "data", "circles", "background").mapInArrow(measure, PARTS)
    return parts.groupBy("image_id", "object_id").agg(
        F.round(F.sum("od"), DIGITS).alias("True_IOD"), F.round(F.sum("od") / F.sum("n"), DIGITS).alias("Mean_OD"), F.round(F.max("most"), DIGITS).alias("Max_OD"),
        F.round(F.min("least"), DIGITS).alias("Min_OD"), F.sum("n").alias("PixelCount"), F.first("background").alias("Background_I0"),
    )
