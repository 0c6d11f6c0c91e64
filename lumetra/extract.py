"""Channel extraction: one channel of large colour images to tiled TIFFs with rewritten metadata.

A file is cut into bands of output tiles, which tasks read and compress on their
own; the bands are then put together (see ``sources.bands``). So one file of
tens of gigabytes is the work of many tasks, as are many small files.
"""

from __future__ import annotations

import signal
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.names import extracted_name
from .functions.units import number, pixels_per_cm
from .operators.ome import parse, rendered
from .sources.bands import BANDS, LAYOUTS, band_rows, layout_of, spread, write_bands
from .sources.scratch import stored
from .sources.tiff import TiffError, packed_band, read_pages, read_region

RESULT = "path string, output string, success boolean, message string, input_bytes long, output_bytes long, duration double"


@dataclass
class Options:
    """Channel (0 red, 1 green, 2 blue), compression (none, deflate, zstd, lzw) and its level, tile edge, and seconds that a file may take;
    ``predictor`` 2 stores differences along rows, ``pages`` extracts every page of a stack instead of the first."""

    channel: int = 1
    level: int = 6
    compression: str = "deflate"
    tile: int = 512
    dry_run: bool = False
    seconds: float | None = None
    predictor: int = 1
    pages: bool = False


@contextmanager
def limited(seconds: float | None):
    """Raise TimeoutError inside whatever runs after so many seconds, in the middle of a decode as well."""
    if seconds is None or threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_):
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, max(seconds, 1e-6))
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def stopped(seconds: float) -> str:
    return f"stopped after {seconds:g} s"


def described(headers: DataFrame, options: Options, channel: str) -> DataFrame:
    """Headers (``tiff_headers``) with the single-channel document each output will carry."""
    parsed = parse(headers.withColumn("xml", F.coalesce("description", F.lit(""))), "xml")
    height, width = F.get(F.col("shape"), F.lit(0)), F.get(F.col("shape"), F.lit(1))
    document = rendered(width, height, F.col("dtype"), F.col("physical_size_x"), F.col("physical_size_y"), F.col("unit_x"), F.col("unit_y"), F.lit(channel), F.lit(f"{channel}_channel"), F.col("objective"), F.col("magnification"))
    # pixels a centimetre, from the document's sizes or else from the header's own tags
    sized = [pixels_per_cm(number(F.col(f"physical_size_{a}")), F.col(f"unit_{a}")) for a in "xy"]
    per_cm = F.when(F.col("resolution_unit") == 3, F.lit(1.0)).when(F.col("resolution_unit") == 2, F.lit(1 / 2.54))
    told = [F.coalesce(s, F.nullif(F.col(f"{a}_resolution"), F.lit(0.0)) * per_cm) for s, a in zip(sized, "xy", strict=True)]
    return parsed.select("path", "length", document.alias("document"), told[0].alias("per_cm_x"), told[1].alias("per_cm_y"))


def extract_channel(headers: DataFrame, folder: str, options: Options | None = None) -> DataFrame:
    """Extract from every file of ``headers`` (``tiff_headers``); one bad file does not stop the others.

    The outcomes are written before they are returned: reading them again does
    nothing again. A file whose bands take longer than ``seconds`` together, or
    one band of which does, has no output.
    """
    options = options or Options()
    channel = {0: "red", 1: "green", 2: "blue"}.get(options.channel, f"ch{options.channel}")
    names = F.concat(F.lit(folder.rstrip("/") + "/"), extracted_name(F.col("path"), F.lit(options.channel)))
    documents = described(headers.filter("error is null"), options, channel)
    # a small row a file
    files = stored(headers.select("path", "length", "shape", "dtype", "error", "n_pages", "heights").withColumn("output", names).join(documents.drop("length"), "path", "left"))
    axis = lambda i: F.get(F.col("shape"), F.lit(i))
    samples = F.coalesce(axis(2), F.lit(1))
    shape = F.concat(F.lit("("), F.array_join("shape", ", "), F.lit(")"))
    refused = F.when(F.col("error").isNotNull(), F.col("error")).when((F.size("shape") != 3) | ~samples.isin(3, 4), F.concat(F.lit("Not an RGB image: shape "), shape)).when(samples <= options.channel, F.lit(f"No channel {options.channel}"))
    files = files.withColumn("refused", refused)
    told = lambda held, ok, message, size, took: held.select("path", "output", ok.alias("success"), message.alias("message"), F.col("length").alias("input_bytes"), size.alias("output_bytes"), took.alias("duration"))
    nothing, no_time = F.lit(0).cast("long"), F.lit(0.0)
    left = told(files.filter("refused is not null"), F.lit(False), F.col("refused"), nothing, no_time)
    fit = files.filter("refused is null")
    if options.dry_run:
        return left.unionByName(told(fit, F.lit(True), F.lit("planned"), nothing, no_time))

    # all pages of a stack are a stack in z
    document = F.regexp_replace("document", r'SizeZ="\d+"', F.concat(F.lit('SizeZ="'), F.col("n_pages").cast("string"), F.lit('"'))) if options.pages else F.col("document")
    layouts = fit.select(
        F.col("path").alias("key"), "output", axis(0).alias("height"), axis(1).alias("width"), "dtype", F.lit(1).alias("samples"), F.lit(options.tile).alias("tile"), F.lit(options.compression).alias("compression"),
        F.lit(options.level).alias("level"), document.alias("description"), F.col("per_cm_x").alias("x_resolution"), F.col("per_cm_y").alias("y_resolution"),
        F.lit(options.predictor).alias("predictor"), (F.col("n_pages") if options.pages else F.lit(1)).cast("int").alias("pages"),
        (F.col("heights") if options.pages else F.lit(None).cast("array<int>")).alias("heights"),
    ).select(*[c.split()[0] for c in LAYOUTS.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                layout, began, data, counts, message = layout_of(row), time.monotonic(), None, None, None
                try:
                    with limited(options.seconds), open(row["key"], "rb") as f:
                        nth = layout.page_of(row["band"])
                        page = read_pages(f, nth + 1)[nth]
                        if page.shape[:2] != (layout.height_of(nth), layout.width) or page.samples <= options.channel or page.dtype.name != layout.dtype:
                            raise TiffError(f"page {nth} is of another kind than the first")
                        tiles = packed_band(layout, read_region(f, page, *layout.rows(row["band"]), channel=options.channel))
                    data, counts = b"".join(tiles), [len(t) for t in tiles]
                except TimeoutError:
                    message = stopped(options.seconds)
                except (OSError, TiffError, KeyError, IndexError, ValueError, MemoryError) as error:
                    message = str(error) or type(error).__name__
                out = {"key": row["key"], "band": row["band"], "data": data, "counts": counts, "message": message, "seconds": time.monotonic() - began}
                yield pa.RecordBatch.from_pylist([out], pa.schema([("key", pa.string()), ("band", pa.int32()), ("data", pa.binary()), ("counts", pa.list_(pa.int64())), ("message", pa.string()), ("seconds", pa.float64())]))

    # a band is as much work as the bytes that are decoded for it, of three samples or four
    n, pixels = band_rows(layouts).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("width").cast("long") * F.least("height", "tile")), F.lit(0))).first()
    bands = stored(spread(band_rows(layouts), n, "key", "band", size=4 * pixels).mapInArrow(read, BANDS))
    if options.seconds is not None:
        slow = bands.groupBy("key").agg(F.sum("seconds").alias("_all")).filter(F.col("_all") > options.seconds).withColumn("_slow", F.lit(stopped(options.seconds)))
        bands = bands.join(slow, "key", "left").withColumn("message", F.coalesce("message", "_slow")).drop("_all", "_slow")
    done = write_bands(layouts, bands)
    made = fit.drop("output").join(done.withColumnRenamed("key", "path"), "path")
    return stored(left.unionByName(told(made, F.col("success"), F.coalesce("message", F.lit("extracted")), F.col("bytes"), F.col("seconds"))))
