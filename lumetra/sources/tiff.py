"""Baseline TIFF and BigTIFF in pure Python: headers, regions of tiles or strips, tiled writing.

Reads and writes uncompressed, deflate, zstd and LZW data with or without
horizontal differencing, samples of 8, 16 or 32 bits together or in planes, and
files of several pages; regions only touch the tiles or strips they meet.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import cached_property
from itertools import accumulate

import numpy as np

# Tags and field types of the TIFF 6.0 and BigTIFF specifications (fixed values).
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION = 256, 257, 258, 259, 262, 270
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, X_RESOLUTION, Y_RESOLUTION, PLANAR, RESOLUTION_UNIT = 273, 277, 278, 279, 282, 283, 284, 296
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
KINDS = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("B", 1), 8: ("h", 2), 9: ("i", 4), 10: ("ii", 8), 11: ("f", 4), 12: ("d", 8), 13: ("I", 4), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}
NONE, LZW, DEFLATE, ZSTD, OLD_DEFLATE = 1, 5, 8, 50000, 32946
COMPRESSIONS = {"none": NONE, "deflate": DEFLATE, "zstd": ZSTD, "lzw": LZW}


class TiffError(ValueError):
    """Not a TIFF this reader can follow."""


@dataclass
class Page:
    order: str
    tags: dict = field(default_factory=dict)

    def one(self, tag: int, default=None):
        value = self.tags.get(tag)
        return default if value is None else value[0] if isinstance(value, tuple) else value

    @property
    def width(self) -> int:
        return int(self.one(WIDTH))

    @property
    def height(self) -> int:
        return int(self.one(HEIGHT))

    @property
    def samples(self) -> int:
        return int(self.one(SAMPLES, 1))

    @property
    def dtype(self) -> np.dtype:
        kind = {1: "u", 2: "i", 3: "f"}[int(self.one(SAMPLE_FORMAT, 1))]
        return np.dtype(f"{self.order}{kind}{int(self.one(BITS, 8)) // 8}")

    @property
    def shape(self) -> tuple[int, ...]:
        return (self.height, self.width) if self.samples == 1 else (self.height, self.width, self.samples)

    @property
    def description(self) -> str | None:
        return self.tags.get(DESCRIPTION)

    def ratio(self, tag: int) -> float | None:
        """A rational tag as a number, 0 where its denominator is 0."""
        value = self.tags.get(tag)
        return None if value is None else value[0] / value[1] if value[1] else 0.0


def read_pages(f, limit: int | None = None) -> list[Page]:
    """Directories of an open file, the first ``limit`` of them."""
    f.seek(0)
    head = f.read(16)
    if len(head) < 8 or head[:2] not in (b"II", b"MM"):
        raise TiffError("no TIFF header")
    order = "<" if head[:2] == b"II" else ">"
    magic = struct.unpack(order + "H", head[2:4])[0]
    if magic not in (42, 43):
        raise TiffError(f"unknown TIFF version {magic}")
    big = magic == 43
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    count_kind, entry, word = ("Q", 20, "Q") if big else ("H", 12, "I")
    size = struct.calcsize(word)
    pages: list[Page] = []
    seen = set()
    while at and at not in seen and (limit is None or len(pages) < limit):
        seen.add(at)
        f.seek(at)
        n = struct.unpack(order + count_kind, f.read(struct.calcsize(count_kind)))[0]
        body = f.read(n * entry)
        after = f.read(size)
        page = Page(order)
        for i in range(n):
            raw = body[i * entry : (i + 1) * entry]
            tag, kind = struct.unpack(order + "HH", raw[:4])
            count = struct.unpack(order + word, raw[4 : 4 + size])[0]
            if kind not in KINDS:
                continue
            code, width = KINDS[kind]
            total = count * width
            if total <= size:
                data = raw[4 + size : 4 + size + total]
            else:
                f.seek(struct.unpack(order + word, raw[4 + size : 4 + 2 * size])[0])
                data = f.read(total)
            if code == "s":
                page.tags[tag] = data.split(b"\0")[0].decode("utf-8", "replace")
            else:
                page.tags[tag] = struct.unpack(order + code[0] * (count * len(code)), data)
        pages.append(page)
        at = struct.unpack(order + word, after)[0] if len(after) == size else 0
    return pages


def expand_lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant bit first."""
    out, table, bits, held, width, previous = bytearray(), [], 0, 0, 9, None
    fresh = [bytes([i]) for i in range(256)] + [b"", b""]
    table = list(fresh)
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 256:
            table, width, previous = list(fresh), 9, None
            continue
        if code == 257:
            break
        if previous is None:
            text = table[code]
        else:
            text = table[code] if code < len(table) else previous + previous[:1]
            table.append(previous + text[:1])
        out += text
        previous = text
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def compress_lzw(data: bytes) -> bytes:
    """TIFF's LZW, as ``expand_lzw`` reads it: codes widen one entry early, and a full table is cleared."""
    out, held, bits, width = bytearray(), 256, 9, 9
    table: dict[int, int] = {}
    size, prefix = 258, -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        code = table.get(key)
        if code is not None:
            prefix = code
            continue
        held, bits = held << width | prefix, bits + width
        table[key] = size
        size += 1
        if size == 1 << width and width < 12:
            width += 1
        if size == 4094:
            held, bits = held << width | 256, bits + width
            table, size, width = {}, 258, 9
        if bits >= 1 << 12:
            rest = bits & 7
            out += (held >> rest).to_bytes((bits - rest) // 8, "big")
            held, bits = held & (1 << rest) - 1, rest
        prefix = byte
    if prefix >= 0:
        held, bits, size = held << width | prefix, bits + width, size + 1
        if size == 1 << width and width < 12:
            width += 1
    held, bits = held << width | 257, bits + width
    pad = -bits % 8
    return bytes(out) + (held << pad).to_bytes((bits + pad) // 8, "big")


def _decoded(page: Page, data: bytes, h: int, w: int, samples: int) -> np.ndarray:
    how = int(page.one(COMPRESSION, NONE))
    if how in (DEFLATE, OLD_DEFLATE):
        try:
            data = zlib.decompress(data)
        except zlib.error as error:
            raise TiffError(f"broken tile: {error}") from None
    elif how == LZW:
        data = expand_lzw(data)
    elif how == ZSTD:
        import zstandard

        try:
            data = zstandard.ZstdDecompressor().decompress(data, max_output_size=h * w * samples * page.dtype.itemsize)
        except zstandard.ZstdError as error:
            raise TiffError(f"broken tile: {error}") from None
    elif how != NONE:
        raise TiffError(f"compression {how} is not supported")
    block = np.frombuffer(data, page.dtype, h * w * samples).reshape(h, w, samples)
    if int(page.one(PREDICTOR, 1)) == 2:
        block = np.cumsum(block, axis=1, dtype=page.dtype)
    return block


def read_region(f, page: Page, y0: int, y1: int, x0: int = 0, x1: int | None = None, channel: int | None = None) -> np.ndarray:
    """Rows y0 to y1 and columns x0 to x1 of all samples, or of one ``channel``, as [h, w, samples]; of separate planes only that one is read."""
    x1 = page.width if x1 is None else min(x1, page.width)
    y1 = min(y1, page.height)
    planes = page.samples if int(page.one(PLANAR, 1)) == 2 else 1
    wanted = range(page.samples) if channel is None else [channel]
    out = np.zeros((max(0, y1 - y0), max(0, x1 - x0), len(wanted)), page.dtype.newbyteorder("="))
    tiled = TILE_OFFSETS in page.tags
    th = int(page.one(TILE_HEIGHT)) if tiled else int(page.one(ROWS_PER_STRIP, page.height))
    tw = int(page.one(TILE_WIDTH)) if tiled else page.width
    offsets, counts = page.tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], page.tags[TILE_COUNTS if tiled else STRIP_COUNTS]
    across, down = -(-page.width // tw), -(-page.height // th)
    for ty in range(y0 // th, -(-y1 // th)):
        for tx in range(x0 // tw, -(-x1 // tw)):
            h = th if tiled else min(th, page.height - ty * th)
            a, b, c, d = max(y0, ty * th), min(y1, ty * th + h), max(x0, tx * tw), min(x1, tx * tw + tw)
            if a >= b or c >= d:
                continue
            for plane in wanted if planes > 1 else [0]:
                i = (plane * down + ty) * across + tx
                f.seek(offsets[i])
                block = _decoded(page, f.read(counts[i]), h, tw, 1 if planes > 1 else page.samples)
                part = block[a - ty * th : b - ty * th, c - tx * tw : d - tx * tw]
                if planes > 1:
                    out[a - y0 : b - y0, c - x0 : d - x0, plane if channel is None else 0] = part[:, :, 0]
                else:
                    out[a - y0 : b - y0, c - x0 : d - x0] = part if channel is None else part[:, :, [channel]]
    return out


def packer(compression: str, level: int):
    if compression == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=level).compress
    return {"none": bytes, "deflate": lambda data: zlib.compress(data, level), "lzw": compress_lzw}[compression]


#: Bytes before the first tile of a written file.
HEAD_BYTES = 16


@dataclass
class Layout:
    """What a written image is but for its pixels; enough to write any band of it, and to close it.

    ``predictor`` 2 stores differences along rows, ``planar`` 2 samples in
    planes; ``pages`` pages of one width follow one another, bands of all of them
    numbered through. ``heights`` tells their heights where they differ.
    """

    height: int
    width: int
    dtype: str
    tile: int = 512
    samples: int = 1
    compression: str = "deflate"
    level: int = 6
    description: str | None = None
    resolution: tuple[float, float] | None = None
    predictor: int = 1
    planar: int = 1
    pages: int = 1
    heights: tuple[int, ...] | None = None

    def height_of(self, page: int) -> int:
        return self.heights[page] if self.heights else self.height

    @cached_property
    def firsts(self) -> list[int]:
        """The number of each page's first band, and of bands in all."""
        return [0, *accumulate(-(-self.height_of(p) // self.tile) for p in range(self.pages))]

    @property
    def bands(self) -> int:
        return self.firsts[-1]

    def page_of(self, band: int) -> int:
        return bisect_right(self.firsts, band) - 1

    def rows(self, band: int) -> tuple[int, int]:
        """Rows of a band in its page."""
        page = self.page_of(band)
        y = (band - self.firsts[page]) * self.tile
        return y, min(self.height_of(page), y + self.tile)


def packed_band(layout: Layout, rows: np.ndarray) -> list[bytes]:
    """The compressed tiles of one band of rows, in order: of every plane in turn where samples lie in planes."""
    dtype, pack = np.dtype(layout.dtype).newbyteorder("<"), packer(layout.compression, layout.level)
    band = np.asarray(rows).astype(dtype, copy=False).reshape(-1, layout.width, layout.samples)
    out = []
    for samples in [slice(i, i + 1) for i in range(layout.samples)] if layout.planar == 2 else [slice(0, layout.samples)]:
        for x in range(0, layout.width, layout.tile):
            part = band[:, x : x + layout.tile, samples]
            block = np.zeros((layout.tile, layout.tile, part.shape[2]), dtype)
            block[: part.shape[0], : part.shape[1]] = part
            if layout.predictor == 2:
                block[:, 1:] -= block[:, :-1].copy()
            out.append(pack(block.tobytes()))
    return out


def _directory(f, layout: Layout, offsets: list[int], counts: list[int], page: int) -> tuple[int, int]:
    """Write one page's directory where the file ends; its place, and the place of its link to the next."""
    kind = {"u": 1, "i": 2, "f": 3}[np.dtype(layout.dtype).kind]
    entries: list[tuple[int, int, int, bytes]] = []

    def add(tag: int, code: int, *values) -> None:
        letter = KINDS[code][0]
        entries.append((tag, code, len(values), struct.pack("<" + letter[0] * len(values), *values)))

    add(WIDTH, 4, layout.width)
    add(HEIGHT, 4, layout.height_of(page))
    add(BITS, 3, *[np.dtype(layout.dtype).itemsize * 8] * layout.samples)
    add(COMPRESSION, 3, COMPRESSIONS[layout.compression])
    add(PHOTOMETRIC, 3, 1 if layout.samples == 1 else 2)
    if layout.description is not None and page == 0:
        text = layout.description.encode() + b"\0"
        entries.append((DESCRIPTION, 2, len(text), text))
    add(SAMPLES, 3, layout.samples)
    if layout.resolution is not None:
        for tag, value in zip((X_RESOLUTION, Y_RESOLUTION), layout.resolution, strict=True):
            entries.append((tag, 5, 1, struct.pack("<II", round(value * 1000), 1000)))
        add(RESOLUTION_UNIT, 3, 3)
    add(PLANAR, 3, layout.planar)
    if layout.predictor != 1:
        add(PREDICTOR, 3, layout.predictor)
    add(TILE_WIDTH, 4, layout.tile)
    add(TILE_HEIGHT, 4, layout.tile)
    add(TILE_OFFSETS, 16, *offsets)
    add(TILE_COUNTS, 16, *counts)
    add(SAMPLE_FORMAT, 3, *[kind] * layout.samples)
    entries.sort(key=lambda e: e[0])
    placed = []
    for tag, code, n, data in entries:
        if len(data) > 8:
            f.write(b"\0" * (-f.tell() % 8))
            where = f.tell()
            f.write(data)
            data = struct.pack("<Q", where)
        placed.append(struct.pack("<HHQ", tag, code, n) + data.ljust(8, b"\0"))
    f.write(b"\0" * (-f.tell() % 8))
    place = f.tell()
    f.write(struct.pack("<Q", len(placed)) + b"".join(placed) + struct.pack("<Q", 0))
    return place, f.tell() - 8


def closed(f, layout: Layout, counts: list[int]) -> int:
    """Write the directories behind the tiles, whose bytes are ``counts`` band by band, and the header in front of them; gives the file's bytes."""
    sizes = np.array(counts, np.int64)
    offsets = HEAD_BYTES + np.append(0, np.cumsum(sizes))
    # planes of a page follow one another in its directory, and lie band by band in the file
    planes = layout.samples if layout.planar == 2 else 1
    firsts = np.array(layout.firsts) * (len(sizes) // layout.bands)
    order = [np.arange(a, b).reshape(n, planes, -1).transpose(1, 0, 2).ravel() for a, b, n in zip(firsts[:-1], firsts[1:], np.diff(layout.firsts), strict=True)]
    link = 8
    f.truncate(int(offsets[-1]))
    f.seek(0)
    f.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0))
    for page, own in enumerate(order):
        f.seek(0, 2) if page else f.seek(int(offsets[-1]))
        place, after = _directory(f, layout, offsets[own].tolist(), sizes[own].tolist(), page)
        f.seek(link)
        f.write(struct.pack("<Q", place))
        link = after
    f.seek(0, 2)
    return f.tell()


def write_tiled(f, rows, height: int, width: int, dtype, description: str | None = None, tile: int = 512, level: int = 6, resolution: tuple[float, float] | None = None, samples: int = 1, compression: str = "deflate", **more) -> int:
    """A tiled BigTIFF, ``none``, ``deflate``, ``zstd`` or ``lzw``, from ``rows(y0, y1)``, a band of tiles in memory at a time; gives the bytes written.

    ``more``: predictor, planar and pages, with which ``rows`` takes the page as well.
    """
    layout = Layout(height, width, np.dtype(dtype).name, tile, samples, compression, level, description, resolution, **more)
    counts: list[int] = []
    f.write(bytes(HEAD_BYTES))
    for band in range(layout.bands):
        page = (layout.page_of(band),) if layout.pages > 1 else ()
        for data in packed_band(layout, rows(*layout.rows(band), *page)):
            counts.append(len(data))
            f.write(data)
    return closed(f, layout, counts)
