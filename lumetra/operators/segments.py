"""Objects of an image: connected components of thresholded pixels.

Pixels are labelled inside tiles, a task a tile; pixels that meet over a tile's
border make links between the labels of two tiles; the labels are united by
rounds of stars, over many tasks whatever the size of an object; and labels are
replaced. An object is named by its first pixel (least y, then least x), as
``y * 2^32 + x``, whatever the tiles.

Defined cases: pixels are named by whole y and x from 0 and are there once (a
repeated one counts once); a pixel without neighbours is an object; images
named by ``keys`` do not touch, null keys equal themselves; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored

TILE = 256
#: Neighbours that come before a pixel, by connectivity.
BEFORE = {4: [(0, -1), (-1, 0)], 8: [(0, -1), (-1, 0), (-1, -1), (-1, 1)]}


def packed_key(df: DataFrame, keys: list[str]) -> Column:
    """The columns that name an image as one string."""
    return F.to_json(F.struct(*[F.col(k) for k in keys])) if keys else F.lit("{}")


def unpacked_key(df: DataFrame, keys: list[str], key: str = "key") -> list[Column]:
    """The columns that ``packed_key`` took, out of its string."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return [F.from_json(key, kinds)[k].alias(k) for k in keys]


def united(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of each of 0 to n - 1's component under links (a, b)."""
    parent = np.arange(n)
    while True:
        pa_, pb = parent[a], parent[b]
        low, high = np.minimum(pa_, pb), np.maximum(pa_, pb)
        if (low == high).all():
            return parent
        np.minimum.at(parent, high, low)
        while True:
            after = parent[parent]
            if (after == parent).all():
                break
            parent = after


def labelled(y: np.ndarray, x: np.ndarray, connectivity: int) -> np.ndarray:
    """Of pixels sorted by (y, x): the place of the first pixel of each one's component."""
    h, w = (int(c.max() - c.min()) + 3 for c in (y, x))
    grid = np.full((h, w), -1, np.int64)
    gy, gx = y - y.min() + 1, x - x.min() + 1
    grid[gy, gx] = np.arange(len(y))
    ends = [(np.flatnonzero((other := grid[gy + dy, gx + dx]) >= 0), other) for dy, dx in BEFORE[connectivity]]
    a = np.concatenate([own for own, _ in ends])
    b = np.concatenate([other[own] for own, other in ends])
    return united(a, b, len(y))


def star_roots(links: DataFrame) -> DataFrame:
    """(key, node, root): the least node of each one's component under links (key, a, b), by alternating stars.

    A node's neighbours meet in sums and joins only, so a node may have any number of them.
    """
    state = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("key", "u", "v").cast("decimal(38,0)"))).first()
    edges = stored(links.filter("a <> b").select("key", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = state(edges)
    while True:
        # large stars: greater neighbours go to the least neighbour
        both = edges.unionByName(edges.select("key", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("key", "u").agg(F.min("v").alias("m")).select("key", "u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").hint("merge").join(least, ["key", "u"]).select("key", F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stored(large)
        # small stars: a node and its lesser neighbours go to the least of these
        least = large.groupBy("key", "u").agg(F.min("v").alias("m"))
        moved = large.hint("merge").join(least, ["key", "u"]).filter("v <> m").select("key", F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(moved.unionByName(least.select("key", "u", F.col("m").alias("v"))).distinct())
        after = state(edges)
        if after == before:
            return edges.select("key", F.col("u").alias("node"), F.col("v").alias("root"))
        before = after


def components(pixels: DataFrame, keys: list[str] = (), connectivity: int = 4, tile: int = TILE) -> DataFrame:
    """keys, y, x and object_id of every pixel of ``pixels`` (y, x), the pixels that a threshold has left."""
    keys = list(keys)
    held = pixels.select(packed_key(pixels, keys).alias("key"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))

    def label(group: pa.Table) -> pa.Table:
        y, x = group["y"].to_numpy(), group["x"].to_numpy()
        code = np.unique(y << 32 | x)
        y, x = code >> 32, code & 0xFFFFFFFF
        first = labelled(y, x, connectivity)
        return pa.Table.from_arrays([pa.array([group["key"][0].as_py()] * len(code), pa.string()), pa.array(y), pa.array(x), pa.array(code[first])], ["key", "y", "x", "label"])

    tiles = held.withColumn("_ty", F.floor(F.col("y") / tile)).withColumn("_tx", F.floor(F.col("x") / tile))
    # a group is at most tile * tile pixels
    local = stored(tiles.groupBy("key", "_ty", "_tx").applyInArrow(label, "key string, y long, x long, label long"))
    inside = {c: F.col(c) % tile for c in "yx"}
    edge = local.filter((inside["y"] == 0) | (inside["y"] == tile - 1) | (inside["x"] == 0) | (inside["x"] == tile - 1))
    to = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in BEFORE[connectivity]]))
    offers = edge.select("key", "y", "x", F.col("label").alias("a"), to.alias("d")).select("key", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"), "a", F.floor(F.col("y") / tile).alias("ty"), F.floor(F.col("x") / tile).alias("tx"))
    offers = offers.filter((F.floor(F.col("y") / tile) != F.col("ty")) | (F.floor(F.col("x") / tile) != F.col("tx"))).drop("ty", "tx")
    links = offers.hint("merge").join(edge.select("key", "y", "x", F.col("label").alias("b")), ["key", "y", "x"]).select("key", "a", "b").distinct()
    roots = star_roots(links).withColumnRenamed("node", "label")
    found = local.hint("merge").join(roots, ["key", "label"], "left")
    return found.select(*unpacked_key(pixels, keys), "y", "x", F.coalesce("root", "label").alias("object_id"))
