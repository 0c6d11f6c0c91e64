"""Images in long form or as rows of arrays: channels, moments, statistics, thresholds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def array_pixels(images: DataFrame, y: str, values: str, value: Column | None = None) -> DataFrame:
    """(y, x, v) from one row of values a line."""
    line = images.select(F.col(y).cast("long").alias("y"), F.posexplode(values).alias("x", "_v"))
    return line.select("y", F.col("x").cast("long").alias("x"), (F.col("_v") if value is None else value).alias("v"))


def extract_channel(values: str, channel: int) -> Column:
    """One channel out of a pixel's values, counted from 0."""
    return F.get(F.col(values), F.lit(channel))


def is_colour(shape: Column) -> Column:
    """At least three axes, the last of 3 or 4 channels."""
    return (F.size(shape) >= 3) & F.element_at(shape, -1).isin(3, 4)


def chunk_plan(height: Column, rows: int = 2048, tile: int = 512) -> tuple[Column, Column]:
    """Rows of a band, rounded up to whole tiles, and how many bands cover the height."""
    band = F.lit(-(-rows // tile) * tile)
    return band, F.ceil(height / band).cast("long")


def shape_moments(objects: DataFrame, key: str, digits: int = 6) -> DataFrame:
    """Area, centroid and second moments of labelled pixels (y, x), with what follows from them."""
    m = objects.groupBy(key).agg(
        F.count(F.lit(1)).alias("area"), F.avg("x").alias("_cx"), F.avg("y").alias("_cy"), F.var_pop("x").alias("_xx"), F.var_pop("y").alias("_yy"), F.covar_pop("x", "y").alias("_xy")
    )
    # a pixel is a unit square: its own second moment is 1/12
    xx, yy, xy = F.col("_xx") + F.lit(1.0) / 12, F.col("_yy") + F.lit(1.0) / 12, F.col("_xy")
    spread = F.sqrt((xx - yy) * (xx - yy) + 4 * xy * xy)
    major, minor = (xx + yy + spread) / 2, (xx + yy - spread) / 2
    return m.select(
        key, "area", F.round("_cx", digits).alias("center_x"), F.round("_cy", digits).alias("center_y"),
        F.round(4 * F.sqrt(major), digits).alias("major_axis"), F.round(4 * F.sqrt(F.greatest(minor, F.lit(0.0))), digits).alias("minor_axis"),
        F.round(F.sqrt(F.greatest(1 - minor / major, F.lit(0.0))), digits).alias("eccentricity"),
        F.round(F.sqrt(4 * F.col("area") / F.pi()), digits).alias("equivalent_diameter"),
    )


def intensity_stats(objects: DataFrame, key: str, value: str = "v", digits: int = 6) -> DataFrame:
    v = F.col(value)
    return objects.groupBy(key).agg(F.sum(v).alias("integrated"), F.round(F.avg(v), digits).alias("mean"), F.round(F.stddev_pop(v), digits).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


def well_sized(objects: DataFrame, diameter: str = "equivalent_diameter", least: float = 30.0, most: float = 200.0) -> DataFrame:
    return objects.filter(F.col(diameter).between(least, most))


def clear_of_border(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Objects whose box (min_x, min_y, max_x, max_y) touches no edge of the image."""
    return boxes.filter((F.col("min_x") > 0) & (F.col("min_y") > 0) & (F.col("max_x") < width - 1) & (F.col("max_y") < height - 1))


#: Levels of a histogram that one task takes: 16 bits have 65,536, a million are some megabytes.
MOST_LEVELS = 1 << 20


def histogram(pixels: DataFrame, value: str, keys: list[str] = (), bins: int | None = None, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(level, n) of the values, for each image named by ``keys``; with ``bins``, levels are the lower ends of equal parts of low to high."""
    v = F.col(value).cast("double")
    if bins is not None:
        v = F.lit(low) + F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((v - low) * (bins / (high - low))))) * F.lit((high - low) / bins)
    return pixels.groupBy(*keys, v.alias("level")).agg(F.count(F.lit(1)).alias("n"))


def corrected(thresholds: DataFrame, columns: list[str], factor: float = 1.0, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Thresholds times a factor, held to their bounds."""
    return thresholds.withColumns({c: F.greatest(F.lit(low), F.least(F.lit(high), F.col(c) * factor)) for c in columns})


def window_thresholds(pixels: DataFrame, value: str = "v", window: int = 100, bins: int = 64, low: float = 0.0, high: float = 1.0, factor: float = 1.0, keys: list[str] = ()) -> DataFrame:
    """Three-class thresholds (low, high) of each window of an image, (row, column) of ``window`` pixels squared.

    Every window has at most ``bins`` levels, so all its pairs of levels fit a row's arrays.
    """
    by = [*keys, "row", "column"]
    placed = pixels.withColumn("row", F.floor(F.col("y") / window).cast("long")).withColumn("column", F.floor(F.col("x") / window).cast("long"))
    counts = histogram(placed, value, by, bins, low, high)
    mass = F.col("n") * F.col("level")
    upto = W.partitionBy(*by).orderBy("level").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(*by)
    c = counts.select(*by, "level", F.sum("n").over(upto).alias("w"), F.sum(mass).over(upto).alias("m"), F.sum("n").over(whole).alias("tw"), F.sum(mass).over(whole).alias("tm"))
    held = c.groupBy(*by, "tw", "tm").agg(F.sort_array(F.collect_list(F.struct("level", "w", "m"))).alias("c"))
    return corrected(held.select(*by, best_pair("c", F.col("tw"), F.col("tm")).alias("_b")).select(*by, "_b.low", "_b.high"), ["low", "high"], factor, low, high)


def best_pair(levels: str, total, mass):
    """(low, high) of the greatest between-class variance, the lowest of equal ones, out of sorted (level, w, m); one level stands for both."""
    term = lambda w, m: F.try_divide(m * m, w)
    def against(a):
        return F.transform(F.filter(levels, lambda b: (b["level"] > a["level"]) & (b["w"] < total)), lambda b: F.struct(F.round(term(a["w"], a["m"]) + term(b["w"] - a["w"], b["m"] - a["m"]) + term(total - b["w"], mass - b["m"]), 6).alias("score"), (-a["level"]).alias("low"), (-b["level"]).alias("high")))

    best = F.array_max(F.flatten(F.transform(levels, against)))
    first = F.get(F.col(levels), F.lit(0))["level"]
    return F.struct(F.coalesce(-best["low"], first).alias("low"), F.coalesce(-best["high"], first).alias("high"))


def threshold_surface(pixels: DataFrame, thresholds: DataFrame, window: int = 100, keys: list[str] = (), columns: list[str] = ("low", "high"), digits: int = 6) -> DataFrame:
    """keys, y, x and each pixel's thresholds, bilinear between the middles of windows.

    ``thresholds``: keys, row, column and the values of each window
    (``window_thresholds``). A window at the far edge is as large as what is
    left of the image, and has its middle there; outside the outermost middles
    the surface is level. Every window is joined with those beside it first, a
    small table, and pixels meet it once.
    """
    keys, columns = list(keys), list(columns)
    # how far an image goes, one row an image
    ends = pixels.groupBy(*keys).agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    value = F.struct(*columns)
    near = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
    offers = thresholds.select(*keys, "row", "column", value.alias("t"), near.alias("d")).select(*keys, (F.col("row") + F.col("d.dy")).alias("row"), (F.col("column") + F.col("d.dx")).alias("column"), F.concat_ws(",", -F.col("d.dy"), -F.col("d.dx")).alias("side"), "t")
    around = offers.groupBy(*keys, "row", "column").agg(F.map_from_entries(F.collect_list(F.struct("side", "t"))).alias("t"))  # nine at most
    around = around.filter(F.map_contains_key("t", F.lit("0,0")))
    around = around.join(ends, keys) if keys else around.crossJoin(F.broadcast(ends))  # one row without keys
    placed = pixels.select(*keys, "y", "x", F.floor(F.col("y") / window).cast("long").alias("row"), F.floor(F.col("x") / window).cast("long").alias("column"))
    met = placed.hint("merge").join(around, [*keys, "row", "column"])

    def side(at: str, place: str, end: str) -> tuple[Column, Column]:
        """The neighbour's side along one axis, and its weight."""
        middle = lambda r: r * window + (F.least(F.lit(window), F.col(end) - r * window) - 1) / 2.0
        own, last = middle(F.col(place)), F.floor((F.col(end) - 1) / window)
        to = F.when(F.col(at) < own, F.when(F.col(place) > 0, -1).otherwise(0)).when(F.col(at) > own, F.when(F.col(place) < last, 1).otherwise(0)).otherwise(0)
        return to, F.when(to == 0, 0.0).otherwise(F.abs((F.col(at) - own) / F.nullif(middle(F.col(place) + to) - own, F.lit(0.0))))

    (dy, wy), (dx, wx) = side("y", "row", "_h"), side("x", "column", "_w")
    met = met.select(*keys, "y", "x", "t", dy.cast("int").alias("_dy"), wy.alias("_wy"), dx.cast("int").alias("_dx"), wx.alias("_wx"))
    # a window without pixels has no thresholds: the own window's stand for it
    at = lambda a, b: F.coalesce(F.try_element_at("t", F.concat_ws(",", a, b)), F.try_element_at("t", F.lit("0,0")))
    zero = F.lit(0)
    corners = met.select(*keys, "y", "x", "_wy", "_wx", at(zero, zero).alias("a"), at(zero, F.col("_dx")).alias("b"), at(F.col("_dy"), zero).alias("c"), at(F.col("_dy"), F.col("_dx")).alias("d"))
    wy, wx = F.col("_wy"), F.col("_wx")
    mixed = lambda n: (1 - wy) * ((1 - wx) * F.col(f"a.{n}") + wx * F.col(f"b.{n}")) + wy * ((1 - wx) * F.col(f"c.{n}") + wx * F.col(f"d.{n}"))
    return corners.select(*keys, "y", "x", *[F.round(mixed(n), digits).alias(n) for n in columns])


def best_cuts(level: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Thresholds of three classes of greatest between-class variance over sorted levels.

    The best lower cut moves up with the upper one, so upper cuts are halved
    again and again, and each looks only between the lower cuts of its
    neighbours: some L log L pairs of L levels instead of all. Of scores equal
    to six digits the lowest cuts win.
    """
    w, m = np.cumsum(n.astype(np.float64)), np.cumsum(n * level)
    if len(level) < 3:
        return float(level[0]), float(level[0])
    best, todo = (-np.inf, 0, 0), [(1, len(level) - 2, 0, len(level) - 3)]
    while todo:
        first, last, low, high = todo.pop()
        j = (first + last) // 2
        i = np.arange(low, min(high, j - 1) + 1)
        score = np.round(m[i] * m[i] / w[i] + (m[j] - m[i]) * (m[j] - m[i]) / (w[j] - w[i]) + (m[-1] - m[j]) * (m[-1] - m[j]) / (w[-1] - w[j]), 6)
        at = int(i[np.argmax(score)])
        best = max(best, (float(score[at - low]), -at, -j))
        if first < j:
            todo.append((first, j - 1, low, at))
        if j < last:
            todo.append((j + 1, last, at, high))
    return float(level[-best[1]]), float(level[-best[2]])


def otsu(levels: DataFrame, classes: int = 2, keys: list[str] = (), most_levels: int = MOST_LEVELS) -> DataFrame:
    """Thresholds of greatest between-class variance over a histogram (level, n), for each image named by ``keys``: two or three classes.

    Works on the histogram; of equal variances the lowest thresholds win; two
    levels have no three classes, and the first stands for both. A task holds
    one histogram: one of more than ``most_levels`` is refused, for which
    ``histogram`` takes a number of bins.
    """
    if classes == 3:
        keys = list(keys)
        key = F.to_json(F.struct(*[F.col(k) for k in keys])) if keys else F.lit("{}")
        kinds = ", ".join(f"`{k}` {levels.schema[k].dataType.simpleString()}" for k in keys)

        def cut(group: pa.Table) -> pa.Table:
            if group.num_rows > most_levels:
                raise ValueError(f"more than {most_levels} levels; bin the histogram")
            group = group.sort_by("level")
            low, high = best_cuts(group["level"].to_numpy(), group["n"].to_numpy())
            return pa.table({"key": group["key"].slice(0, 1), "low": [low], "high": [high]})

        held = levels.select(key.alias("key"), F.col("level").cast("double").alias("level"), F.col("n").cast("long").alias("n"))
        found = held.groupBy("key").applyInArrow(cut, "key string, low double, high double")
        return found.select(*[F.from_json("key", kinds)[k].alias(k) for k in keys], "low", "high")
    upto = W.partitionBy(*keys).orderBy("level").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(*keys)
    mass = F.col("n") * F.col("level")
    c = levels.select(*keys, "level", F.sum("n").over(upto).alias("w"), F.sum(mass).over(upto).alias("m"), F.sum("n").over(whole).alias("tw"), F.sum(mass).over(whole).alias("tm"))
    term = lambda w, m: m * m / w
    split = c.filter("w < tw").withColumn("score", F.round(term(F.col("w"), F.col("m")) + term(F.col("tw") - F.col("w"), F.col("tm") - F.col("m")), 6))
    return split.groupBy(*keys).agg(F.max_by(F.col("level"), F.struct("score", (-F.col("level")).alias("back"))).alias("threshold")).filter("threshold is not null")


def local_maxima(pixels: DataFrame, radius: int = 3, keys: list[str] = ()) -> DataFrame:
    """Pixels (y, x, v), of each image named by ``keys``, that are greatest in the square of ``radius`` around them (ties all stand).

    The greatest of a square is the greatest along columns of what is the
    greatest along rows: each pixel is offered to 2 * radius + 1 cells, twice.
    """
    along = lambda held, axis, other: held.withColumn("_d", F.explode(F.sequence(F.lit(-radius), F.lit(radius)))).groupBy(*keys, other, (F.col(axis) + F.col("_d")).alias(axis)).agg(F.max("_top").alias("_top"))
    offers = along(along(pixels.select(*keys, "y", "x", F.col("v").alias("_top")), "x", "y"), "y", "x")
    return pixels.hint("merge").join(offers, [*keys, "y", "x"]).filter("v = _top").drop("_top")


def smoothed(pixels: DataFrame, scale: float = 1.0, radius: int | None = None, keys: list[str] = (), digits: int = 6) -> DataFrame:
    """Pixels under a Gaussian of a standard deviation ``scale``, cut at ``radius`` (three of them); weights of what lies outside the image are left out."""
    radius = max(1, round(3 * scale)) if radius is None else radius
    weight = F.exp(-(F.col("_d") * F.col("_d")) / F.lit(2.0 * scale * scale))

    def along(held, axis, other):
        spread = held.withColumn("_d", F.explode(F.sequence(F.lit(-radius), F.lit(radius)))).withColumn("_g", weight)
        return spread.groupBy(*keys, other, (F.col(axis) + F.col("_d")).alias(axis)).agg(F.sum(F.col("_g") * F.col("_v")).alias("_v"), F.sum(F.col("_g") * F.col("_n")).alias("_n"))

    held = along(along(pixels.select(*keys, "y", "x", F.col("v").cast("double").alias("_v"), F.lit(1.0).alias("_n")), "x", "y"), "y", "x")
    return pixels.select(*keys, "y", "x").hint("merge").join(held, [*keys, "y", "x"]).select(*keys, "y", "x", F.round(F.col("_v") / F.col("_n"), digits).alias("v"))


def perimeters(objects: DataFrame, key: str, digits: int = 6) -> DataFrame:
    """Perimeter of labelled pixels (y, x), the number of their edges on which no pixel of the object lies, with area and form factor 4 pi area / perimeter^2."""
    side = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))]))
    # a cell is offered by itself and by its neighbours: it has as many inner edges as offers of theirs
    offers = objects.select(key, "y", "x").withColumn("_s", side).groupBy(key, (F.col("y") + F.col("_s.dy")).alias("y"), (F.col("x") + F.col("_s.dx")).alias("x"))
    cells = offers.agg(F.max((F.col("_s.dy") == 0) & (F.col("_s.dx") == 0)).alias("_own"), F.count(F.lit(1)).alias("_n")).filter("_own")
    sums = cells.groupBy(key).agg(F.count(F.lit(1)).alias("area"), F.sum(5 - F.col("_n")).alias("perimeter"))
    return sums.withColumn("form_factor", F.round(4 * F.pi() * F.col("area") / (F.col("perimeter") * F.col("perimeter")), digits))
