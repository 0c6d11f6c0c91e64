"""Tiled TIFFs written by many tasks.

An image is a row of a table of layouts; its pixels come in bands of tiles, a
row a band, from any number of tasks. Three passes:

1. *Bands.* Whoever makes the bands compresses them; a row holds a band's tiles
   end to end and their sizes. The table is written, so no band is made twice.
2. *Places.* A band begins where the bands before it end: a running sum over
   the bands of its image. Tasks write bands to these places of a file that
   nobody knows yet; writing one twice changes nothing.
3. *Closing.* One task an image writes the directory behind the tiles and gives
   the file its name. The bytes are those of the one-task writer.

An image with a band that failed is not written. A task that is killed leaves
at most a file of the run's own name behind, never half an output.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import stored
from .tiff import HEAD_BYTES, Layout, closed

#: Of an image: its key, where it goes, and its layout.
LAYOUTS = "key string, output string, height int, width int, dtype string, samples int, tile int, compression string, level int, description string, x_resolution double, y_resolution double, predictor int, pages int, heights array<int>"
BANDS = "key string, band int, data binary, counts array<long>, message string, seconds double"
WRITTEN = "key string, output string, success boolean, message string, bytes long, seconds double"
#: Tasks of a pass at most, and up to how many a row has one of its own.
MOST_TASKS, OWN_TASKS = 10_000, 64
#: Bytes, and rows, of a task where there are more rows than that.
TASK_BYTES, TASK_ROWS = 16 << 20, 256
#: What a tile counts for where its image is closed.
TILE_BYTES = 100


def layout_of(row: dict) -> Layout:
    resolution = None if None in (row["x_resolution"], row["y_resolution"]) else (row["x_resolution"], row["y_resolution"])
    return Layout(row["height"], row["width"], row["dtype"], row["tile"], row["samples"], row["compression"], row["level"], row["description"], resolution, row["predictor"], 1, row["pages"], tuple(row["heights"]) if row["heights"] else None)


def task_count(n: int, size: int = 0, task_rows: int = TASK_ROWS) -> int:
    """Tasks for ``n`` rows of ``size`` bytes of work together: one a row while they are few or large, else as many as the work asks for."""
    return max(1, min(n, MOST_TASKS, max(OWN_TASKS, -(-size // TASK_BYTES), -(-n // task_rows))))


def spread(rows: DataFrame, n: int, *by: str | Column, size: int = 0, task_rows: int = TASK_ROWS) -> DataFrame:
    """Rows dealt to tasks (``task_count``). The number is given, so that small rows are not put together again."""
    return rows.repartition(task_count(n, size, task_rows), *by)


def band_rows(layouts: DataFrame) -> DataFrame:
    """The layouts, a row a band of every page."""
    even = F.ceil(F.col("height") / F.col("tile")) * F.col("pages")
    n = F.coalesce(F.aggregate("heights", F.lit(0).cast("long"), lambda n, h: n + F.ceil(h / F.col("tile"))), even)
    return layouts.withColumn("band", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)))


def write_bands(layouts: DataFrame, bands: DataFrame) -> DataFrame:
    """(key, output, success, message, bytes, seconds) of every image of ``layouts`` from its rows of ``bands``; done when it returns."""
    run = uuid.uuid4().hex
    layouts, bands = stored(layouts), stored(bands)
    bad = bands.filter("message is not null").groupBy("key").agg(F.min("message").alias("message"))
    along = W.partitionBy("key").orderBy("band").rowsBetween(W.unboundedPreceding, -1)
    sizes = bands.filter("message is null").select("key", "band", F.length("data").cast("long").alias("size"))
    # a small row a band
    places = stored(sizes.join(bad, "key", "left_anti").withColumn("at", F.coalesce(F.sum("size").over(along), F.lit(0)) + HEAD_BYTES).join(layouts.select("key", "output"), "key").select("key", "band", "size", "at", "output"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            began = time.monotonic()
            for output, at, data in zip(*(batch.column(i) for i in range(2, 5)), strict=True):
                output, view = output.as_py(), memoryview(data.as_buffer())
                os.makedirs(os.path.dirname(output) or ".", exist_ok=True)
                f = os.open(f"{output}.{run}.part", os.O_WRONLY | os.O_CREAT, 0o666)
                try:
                    at, done = at.as_py(), 0
                    while done < len(view):
                        done += os.pwrite(f, view[done : done + (1 << 26)], at + done)
                finally:
                    os.close(f)
            took = (time.monotonic() - began) / max(1, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([took] * batch.num_rows)], ["key", "band", "took"])

    n, size = places.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    met = places.drop("size").join(bands.select("key", "band", "data"), ["key", "band"]).select("key", "band", "output", "at", "data")
    put = stored(spread(met, n, "key", "band", size=size).mapInArrow(place, "key string, band int, took double"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                part, message, size = f"{row['output']}.{run}.part", row["message"], 0
                try:
                    if message is None:
                        layout, counts = layout_of(row), [n for band in sorted(row["bands"] or [], key=lambda b: b["band"]) for n in band["counts"]]
                        if os.path.exists(row["output"]) and not os.path.exists(part):
                            size = os.path.getsize(row["output"])  # this task has been here before
                        elif len(row["bands"] or []) != layout.bands:
                            message = f"{len(row['bands'] or [])} of {layout.bands} bands"
                        else:
                            with open(part, "r+b") as f:
                                size = closed(f, layout, counts)
                                f.flush()
                                os.fsync(f.fileno())
                            os.replace(part, row["output"])
                except OSError as error:
                    message, size = str(error), 0
                if message is not None:
                    with suppress(OSError):
                        os.remove(part)
                out.append({"key": row["key"], "output": row["output"], "success": message is None, "message": message, "bytes": size, "seconds": row["seconds"]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.string()), ("output", pa.string()), ("success", pa.bool_()), ("message", pa.string()), ("bytes", pa.int64()), ("seconds", pa.float64())]))

    # an image's tile sizes, some bytes a tile
    sums = bands.groupBy("key").agg(F.collect_list(F.when(F.col("message").isNull(), F.struct("band", "counts"))).alias("bands"), F.sum("seconds").alias("_made"))
    took = put.groupBy("key").agg(F.sum("took").alias("_put"))
    whole = layouts.join(sums, "key", "left").join(bad, "key", "left").join(took, "key", "left")
    whole = whole.withColumn("seconds", F.coalesce("_made", F.lit(0.0)) + F.coalesce("_put", F.lit(0.0))).drop("_made", "_put")
    tiles = bands.agg(F.coalesce(F.sum(F.size("counts")), F.lit(0))).first()[0]
    return stored(spread(whole, layouts.count(), "key", size=TILE_BYTES * tiles).mapInArrow(close, WRITTEN))
