"""Windows of chunked arrays (the Zarr layout, version 2) as a Spark data source, and a sink.

``zarr_tiles`` gives rows of ``tiff_tiles``' form. Which chunks a window and a
channel meet follows from the array's metadata by arithmetic; only these are
opened, each by the task that got its number. A group stands for its array
``0``, else for its first one by name. ``windows`` reads one window of many
arrays. Options: ``path``; ``rows``, ``columns``
and ``planes`` as ``from:to``; ``axes`` where the dimensions are not yx, yxc,
zyxc or tczyx. A filter on ``channel`` is pushed down.

Chunks that are not there hold the fill value. Arrays are plain, zlib, gzip or
zstd, without filters; anything else is refused by name. Paths are on storage
that executors mount.
"""

from __future__ import annotations

import gzip
import itertools
import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from ..schemas import TILES
from .bands import spread
from .scratch import stored
from .tiles import ARROW_TILES

AXES = {2: "yx", 3: "yxc", 4: "zyxc", 5: "tczyx"}
#: Bytes of chunks, before compression, that a task is planned for, and tasks at most.
PART_BYTES, MOST_PARTS = 64 << 20, 10_000


class ZarrError(ValueError):
    """Not an array that this reader can follow."""


def array_path(path: str) -> str:
    """The array that a store stands for."""
    if os.path.exists(os.path.join(path, ".zarray")):
        return path
    if os.path.exists(os.path.join(path, "0", ".zarray")):
        return os.path.join(path, "0")
    if os.path.exists(os.path.join(path, ".zgroup")):
        for name in sorted(os.listdir(path)):
            if os.path.exists(os.path.join(path, name, ".zarray")):
                return os.path.join(path, name)
    raise ZarrError(f"no array in {path}")


class Array:
    """An array's metadata, and its chunks by their place in the grid."""

    def __init__(self, path: str, axes: str | None = None):
        self.path = array_path(path)
        with open(os.path.join(self.path, ".zarray"), encoding="utf-8") as f:
            told = json.load(f)
        self.shape, self.chunks = tuple(told["shape"]), tuple(told["chunks"])
        self.dtype, self.order, self.fill = np.dtype(told["dtype"]), told.get("order", "C"), told.get("fill_value") or 0
        self.separator, self.codec = told.get("dimension_separator", "."), (told.get("compressor") or {}).get("id")
        if told.get("filters") or self.codec not in (None, "zlib", "gzip", "zstd"):
            raise ZarrError(f"{self.path}: {'filters' if told.get('filters') else self.codec} are not supported")
        self.axes = axes or AXES.get(len(self.shape), "")
        if len(self.axes) != len(self.shape) or not {"y", "x"} <= set(self.axes):
            raise ZarrError(f"{self.path}: axes {self.axes!r} of an array of {len(self.shape)} dimensions")

    def grid(self, window: dict[str, tuple[int, int]]) -> list[range]:
        """Along each axis the places of the chunks that a window meets."""
        out = []
        for axis, n, c in zip(self.axes, self.shape, self.chunks, strict=True):
            a, b = window.get(axis, (0, n))
            a, b = max(0, a), min(n, b)
            out.append(range(a // c, -(-b // c)) if a < b else range(0))
        return out

    def read(self, place: tuple[int, ...]) -> np.ndarray:
        try:
            with open(os.path.join(self.path, self.separator.join(map(str, place))), "rb") as f:
                data = f.read()
        except FileNotFoundError:
            return np.full(self.chunks, self.fill, self.dtype)
        if self.codec == "zlib":
            data = zlib.decompress(data)
        elif self.codec == "gzip":
            data = gzip.decompress(data)
        elif self.codec == "zstd":
            import zstandard

            data = zstandard.ZstdDecompressor().decompress(data, max_output_size=int(np.prod(self.chunks)) * self.dtype.itemsize)
        return np.frombuffer(data, self.dtype).reshape(self.chunks, order=self.order)


def span(text: str | None) -> tuple[int, int] | None:
    """``from:to`` as two numbers."""
    if text is None:
        return None
    a, _, b = text.partition(":")
    return int(a or 0), int(b) if b else 1 << 62


def parts_of(array: Array, window: dict) -> list[tuple[int, int]]:
    """Runs of the numbers of the chunks that a window meets."""
    n = int(np.prod([len(r) for r in array.grid(window)], dtype=np.int64))
    size = int(np.prod(array.chunks, dtype=np.int64)) * array.dtype.itemsize
    parts = max(1, min(n, MOST_PARTS, -(-n * size // PART_BYTES)))
    return [(n * i // parts, n * (i + 1) // parts) for i in range(parts)]


def tiles_of(array: Array, window: dict, first: int, last: int, image: str):
    """Tiles of the chunks numbered ``first`` up to ``last`` of those that a window meets, cut to it."""
    grid, at = array.grid(window), {a: i for i, a in enumerate(array.axes)}
    lengths = [len(r) for r in grid]
    for number in range(first, last):
        place = tuple(r[i] for r, i in zip(grid, np.unravel_index(number, lengths), strict=True))
        low = [p * c for p, c in zip(place, array.chunks, strict=True)]
        ends = [(max(a, w[0]), min(a + c, n, w[1])) for a, c, n, w in zip(low, array.chunks, array.shape, (window.get(x, (0, 1 << 62)) for x in array.axes), strict=True)]
        held = array.read(place)[tuple(slice(a - o, b - o) for (a, b), o in zip(ends, low, strict=True))]
        others = [a for a in array.axes if a not in "yx"]
        rows: dict[str, list] = {c: [] for c in ("z", "t", "channel", "data")}
        for spot in itertools.product(*(range(*ends[at[a]]) for a in others)):
            where = dict(zip(others, spot, strict=True))
            plane = held[tuple(where[a] - ends[at[a]][0] if a in where else slice(None) for a in array.axes)]
            rows["data"].append((plane if at["y"] < at["x"] else plane.T).ravel())
            for name, axis in (("z", "z"), ("t", "t"), ("channel", "c")):
                rows[name].append(where.get(axis, 0))
        n, (y0, y1), (x0, x1) = len(rows["data"]), ends[at["y"]], ends[at["x"]]
        ints = lambda values: pa.array(values, pa.int32())
        data = pa.ListArray.from_arrays(ints(np.arange(n + 1) * (y1 - y0) * (x1 - x0)), ints(np.concatenate(rows["data"]).astype(np.int32)))
        each = [[0] * n, rows["z"], rows["t"], rows["channel"], [y0] * n, [x0] * n, [y1 - y0] * n, [x1 - x0] * n]
        yield pa.RecordBatch.from_arrays([pa.array([image] * n), *map(ints, each), pa.array([array.dtype.name] * n), data], schema=ARROW_TILES)


def windows(stores: DataFrame, path: str = "path", channel: int | None = None, rows: str | None = None, columns: str | None = None, planes: str | None = None, axes: str | None = None) -> DataFrame:
    """The same window of many arrays, listed in a table: tasks read their metadata, then the chunks are dealt out."""
    window = {a: s for a, s in (("y", span(rows)), ("x", span(columns)), ("z", span(planes)), ("c", None if channel is None else (channel, channel + 1))) if s}

    def plan(batches):
        for batch in batches:
            arrays = [(p, Array(p, axes)) for p in batch.column(0).to_pylist()]
            found = [(p, a, b, (b - a) * int(np.prod(array.chunks, dtype=np.int64)) * array.dtype.itemsize) for p, array in arrays for a, b in parts_of(array, window)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["path", "first", "last", "size"])

    def read(batches):
        for batch in batches:
            for p, first, last in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                yield from tiles_of(Array(p, axes), window, first, last, p)

    named = stores.select(F.col(path).alias("path"))
    parts = stored(spread(named, named.count(), "path").mapInArrow(plan, "path string, first long, last long, size long"))
    n, size = parts.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    return spread(parts, n, "path", "first", size=size).mapInArrow(read, TILES)


class Chunks(InputPartition):
    """The chunks of a window from number ``first`` up to ``last``, as the grid counts them."""

    def __init__(self, path: str, window: dict, first: int, last: int):
        super().__init__((path, first, last))
        self.path, self.window, self.first, self.last = path, window, first, last


class ZarrReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        given = {"y": span(options.get("rows")), "x": span(options.get("columns")), "z": span(options.get("planes"))}
        self.window = {a: s for a, s in given.items() if s}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("channel",):
                self.window = self.window | {"c": (f.value, f.value + 1)}
            yield f  # Spark checks again what was pushed

    def partitions(self):
        array = Array(self.options["path"], self.options.get("axes"))
        return [Chunks(self.options["path"], self.window, *part) for part in parts_of(array, self.window)]

    def read(self, part):
        yield from tiles_of(Array(part.path, self.options.get("axes")), part.window, part.first, part.last, part.path)


class ZarrTiles(DataSource):
    @classmethod
    def name(cls):
        return "zarr_tiles"

    def schema(self):
        return TILES

    def reader(self, schema):
        return ZarrReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZarrTiles)


def write_zarr(lines: DataFrame, folder: str, chunk: int = 256, compressor: str | None = "zlib") -> DataFrame:
    """Write rows (image, y, data: bytes of a line as [width, samples], samples) as arrays (y, x, sample) ``folder/<image>.zarr/0``; gives image and chunks.

    A group is a band of ``chunk`` lines; a chunk is written whole under its own name, so writing it again changes nothing.
    """
    held = stored(lines.select(F.col("image").cast("long").alias("image"), F.col("y").cast("long").alias("y"), F.col("data").cast("binary").alias("data"), F.col("samples").cast("int").alias("samples")))
    pack = {None: bytes, "zlib": zlib.compress, "gzip": gzip.compress}[compressor]

    def array(image: int) -> str:
        return os.path.join(folder, f"{image}.zarr", "0")

    def whole(path: str, data: bytes) -> None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(part := f"{path}.{os.getpid()}.part", "wb") as f:
            f.write(data)
        os.replace(part, path)

    def band(group: pa.Table) -> pa.Table:
        group = group.sort_by("y")
        image, nth, samples = (group[c][0].as_py() for c in ("image", "band", "samples"))
        rows = np.stack([np.frombuffer(d, np.uint8).reshape(-1, samples) for d in group["data"].to_pylist()])
        n = 0
        for x in range(0, rows.shape[1], chunk):
            for c in range(samples):
                block = np.zeros((chunk, chunk, 1), np.uint8)
                part = rows[:, x : x + chunk, c]
                block[: part.shape[0], : part.shape[1], 0] = part
                whole(os.path.join(array(image), f"{nth}.{x // chunk}.{c}"), pack(block.tobytes()))
                n += 1
        return pa.table({"image": pa.array([image], pa.int64()), "chunks": pa.array([n], pa.int64())})

    def about(batches):
        for batch in batches:
            for image, height, width, samples in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                told = {"zarr_format": 2, "shape": [height, width, samples], "chunks": [chunk, chunk, 1], "dtype": "|u1", "order": "C", "fill_value": 0, "filters": None, "compressor": {"id": compressor} if compressor else None}
                whole(os.path.join(array(image), ".zarray"), json.dumps(told).encode())
                whole(os.path.join(folder, f"{image}.zarr", ".zgroup"), b'{"zarr_format": 2}')
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["image"])

    done = stored(held.withColumn("band", F.floor(F.col("y") / chunk).cast("int")).groupBy("image", "band").applyInArrow(band, "image long, chunks long"))
    shapes = held.groupBy("image").agg((F.max("y") + 1).cast("int").alias("height"), F.max(F.length("data") / F.col("samples")).cast("int").alias("width"), F.max("samples").alias("samples"))
    # metadata last: an array is there when its chunks are
    named = stored(spread(shapes, 200, "image").mapInArrow(about, "image long"))
    return stored(done.groupBy("image").agg(F.sum("chunks").alias("chunks")).join(named, "image"))
