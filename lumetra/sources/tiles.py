"""Tiled images as a Spark data source: tasks take bands of rows in turn, filters on channel pushed down.

``tiff_tiles`` gives tiles of single channels, of the first page or (``pages``:
all) of every page of a stack; ``tiff_headers`` one row a file. ``take`` names
the channel of colour images that is wanted where grey images are wanted as they
are; an image of several channels without that one is an error.
Paths are opened by the tasks, so images must be on storage that executors mount.
"""

from __future__ import annotations

import glob
import os
import re
import struct
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from ..schemas import TILES
from .bands import spread
from .tiff import RESOLUTION_UNIT, X_RESOLUTION, Y_RESOLUTION, Page, TiffError, read_pages, read_region

HEADERS = "path string, length long, n_pages int, shape array<int>, dtype string, description string, x_resolution double, y_resolution double, resolution_unit int, error string, heights array<int>"


#: Names of images, in lower case.
IMAGES = r"\.(tif|tiff|btf)$"


def paths_of(options: dict) -> list[str]:
    """A file, the matches of a pattern, or the images of a directory (``recursive``: true or false)."""
    path = options["path"]
    if os.path.isdir(path):
        deep = options.get("recursive", "true").lower() == "true"
        found = glob.glob(os.path.join(path, "**", "*") if deep else os.path.join(path, "*"), recursive=deep)
        return sorted(p for p in found if p.lower().endswith((".tif", ".tiff", ".btf")))
    return sorted(glob.glob(path)) or [path]


INTS = ("page", "z", "t", "channel", "y0", "x0", "h", "w")
ARROW_TILES = pa.schema([("image_id", pa.string()), *[(c, pa.int32()) for c in INTS], ("dtype", pa.string()), ("data", pa.list_(pa.int32()))])
#: Tiles of a batch of rows.
BATCH_TILES = 8


#: Bytes of a file that a task is planned for; its header is first read by the task.
PART_BYTES = 32 << 20
#: Small files are put together to tasks of so many at most, to fewer while that makes less than so many tasks.
PART_FILES, LEAST_PARTS = 64, 32


class Piece(NamedTuple):
    """Every ``of``-th band of a file, from band ``nth`` on."""

    path: str
    nth: int = 0
    of: int = 1


class Part(InputPartition):
    """The work of a task."""

    def __init__(self, pieces: list[Piece]):
        super().__init__(pieces)
        self.pieces = pieces


def parts_of(sized: list[tuple[Piece, int]]) -> list[Part]:
    """Pieces and their bytes put together in order, up to bounds of both."""
    most = max(1, min(PART_FILES, len(sized) // LEAST_PARTS))
    parts, held, total = [], [], 0
    for piece, size in sized:
        if held and (len(held) >= most or total + size > PART_BYTES):
            parts.append(Part(held))
            held, total = [], 0
        held.append(piece)
        total += size
    return [*parts, Part(held)] if held else parts


class TileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.channel = options, None
        self.pages = options.get("pages", "first").lower() == "all"
        self.take = int(options["take"]) if "take" in options else None
        self.tile = int(options.get("tile", 512))
        rows = int(options.get("chunk_rows", 2048))
        self.band = -(-rows // self.tile) * self.tile

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("channel",):
                self.channel = f.value
            yield f  # Spark checks again what was pushed

    def partitions(self):
        sized = []
        for path in paths_of(self.options):
            size = os.path.getsize(path)
            n = max(1, -(-size // PART_BYTES))
            sized += [(Piece(path, i, n), size // n) for i in range(n)]
        return parts_of(sized)

    def read(self, part):
        for piece in part.pieces:
            yield from self.tiles_of(piece)

    def tiles_of(self, part: Piece):
        with open(part.path, "rb") as f:
            pages = read_pages(f, None if self.pages or self.take is not None else 1)
            planes = list(zip(pages, plane_axes(pages), strict=True))
            if self.take is not None:
                planes = taken(planes, self.take, part.path)
            planes = planes if self.pages else planes[:1]
            per_page = -(-max(p.height for p, _ in planes) // self.band)
            # bands of all pages, numbered through
            for nth in range(part.nth, per_page * len(planes), part.of):
                page, (z, t, c) = planes[nth // per_page]
                for y in range(nth % per_page * self.band, min((nth % per_page + 1) * self.band, page.height), self.tile):
                    # a row of tiles at a time: strips, which span the width, are decoded once
                    channels = range(page.samples) if page.samples > 1 else [c]
                    if self.take is not None and page.samples > 1:
                        channels = [self.take]
                    channels = [k for k in channels if self.channel is None or k == self.channel]
                    if not channels:
                        continue
                    one = (self.channel if self.take is None else self.take) if page.samples > 1 else None
                    whole = read_region(f, page, y, min(y + self.tile, page.height), channel=one)
                    places = [(k, x) for x in range(0, page.width, self.tile) for k in channels]
                    for begin in range(0, len(places), BATCH_TILES):
                        yield self.batch(part.path, (nth // per_page, z, t), page, y, whole, places[begin : begin + BATCH_TILES])

    def batch(self, path: str, plane: tuple[int, int, int], page, y: int, whole, places: list[tuple[int, int]]) -> pa.RecordBatch:
        blocks = [whole[:, x : x + self.tile, c if whole.shape[2] > 1 else 0] for c, x in places]
        ints = lambda values: pa.array(values, pa.int32())
        cells = np.concatenate([b.ravel() for b in blocks])
        data = pa.ListArray.from_arrays(ints(np.append(0, np.cumsum([b.size for b in blocks]))), ints(cells.astype(np.int32)))
        n = len(places)
        arrays = [pa.array([path] * n), *[ints([v] * n) for v in plane], ints([c for c, _ in places]), ints([y] * n), ints([x for _, x in places]), ints([b.shape[0] for b in blocks]), ints([b.shape[1] for b in blocks]), pa.array([page.dtype.name] * n), data]
        return pa.RecordBatch.from_arrays(arrays, schema=ARROW_TILES)


def plane_axes(pages: list[Page]) -> list[tuple[int, int, int]]:
    """(z, t, channel) of every page: by the order and sizes that the first page's document tells, else pages are a stack in z.

    Pages of several samples hold their channels themselves.
    """
    about = pages[0].description or ""
    pixels = re.search(r"<(?:\w+:)?Pixels\b[^>]*>", about)
    told = dict(re.findall(r"\b(DimensionOrder|Size[ZTC])\s*=\s*[\"']([^\"']*)[\"']", pixels[0])) if pixels else {}
    order = told.get("DimensionOrder", "")
    if len(pages) == 1 or not re.fullmatch(r"XY(?:CZT|CTZ|ZCT|ZTC|TCZ|TZC)", order):
        return [(i, 0, 0) for i in range(len(pages))]
    sizes = {a: max(1, int(n)) if (n := told.get(f"Size{a}", "1")).isdigit() else 1 for a in "ZTC"}
    if pages[0].samples > 1:
        sizes["C"] = 1
    if sizes["Z"] * sizes["T"] * sizes["C"] != len(pages):
        return [(i, 0, 0) for i in range(len(pages))]
    out = []
    for i in range(len(pages)):
        at = {}
        for axis in order[2:]:
            i, at[axis] = divmod(i, sizes[axis])
        out.append((at["Z"], at["T"], at["C"]))
    return out


def taken(planes: list[tuple[Page, tuple[int, int, int]]], channel: int, path: str) -> list[tuple[Page, tuple[int, int, int]]]:
    """The planes that hold a channel: all of a grey image; pages that are channels by their axes."""
    apart = any(c for _, (_, _, c) in planes)
    held = [(p, at) for p, at in planes if channel < p.samples or (p.samples == 1 and (at[2] == channel if apart else True))]
    if not held:
        raise TiffError(f"{path}: no channel {channel}")
    return held


class TiffTiles(DataSource):
    @classmethod
    def name(cls):
        return "tiff_tiles"

    def schema(self):
        return TILES

    def reader(self, schema):
        return TileReader(dict(self.options))


def header_row(path: str) -> tuple:
    """The row of one file; one that cannot be followed says why."""
    try:
        with open(path, "rb") as f:
            pages = read_pages(f)
        if not pages:
            raise TiffError("no pages")
        p = pages[0]
        return (path, os.path.getsize(path), len(pages), list(p.shape), p.dtype.name, p.description, p.ratio(X_RESOLUTION), p.ratio(Y_RESOLUTION), p.one(RESOLUTION_UNIT), None, [page.height for page in pages])
    except (OSError, TiffError, KeyError, IndexError, struct.error) as error:
        return (path, os.path.getsize(path) if os.path.exists(path) else None, 0, None, None, None, None, None, None, str(error), None)


def headers_of(files: DataFrame, path: str = "path") -> DataFrame:
    """The rows of ``tiff_headers`` for files listed in a table, which stays distributed: a task a file, up to a bound."""
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.list_(pa.int32())]

    def read(batches):
        for batch in batches:
            rows = [header_row(p) for p in batch.column(0).to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in HEADERS.split(", ")])

    named = files.select(F.col(path).alias("path"))
    return spread(named, named.count(), "path").mapInArrow(read, HEADERS)


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return parts_of([(Piece(p), 0) for p in paths_of(self.options)])

    def read(self, part):
        for piece in part.pieces:
            yield header_row(piece.path)


class TiffHeaders(DataSource):
    @classmethod
    def name(cls):
        return "tiff_headers"

    def schema(self):
        return HEADERS

    def reader(self, schema):
        return HeaderReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make both sources known to a session, and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffTiles)
    spark.dataSource.register(TiffHeaders)
