"""Media columns: texts stored as Matroska sound, read back through packet tables.

Defined cases: a null or empty text is 64 zero bytes; equal texts give equal
values; repeated rows are all kept; an empty table gives no rows. Every row is
independent of the others, so there is no shuffle and no skew.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import column, map_texts, sha256_hex, text_rows
from .matroska import MatroskaError, demux, mux

UNIT = 64

SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long, duration_ms long"
PACKETS = "doc_id long, packet int, track int, cluster int, timestamp_ns long, offset long, size long, keyframe boolean, lacing int, error string"


def payload_of(text: bytes) -> bytes:
    """The text and zeros up to a positive multiple of 64 bytes."""
    return text + bytes(UNIT - len(text) if not text else -len(text) % UNIT)


def track_bytes(data: bytes, media, track: int = 1) -> bytes:
    """The frames of one track in order of time, put together from their byte ranges."""
    view = memoryview(data)
    rows = sorted((p for p in media.packets if p[0] == track), key=lambda p: (p[1], p[2]))
    return b"".join([view[p[2] : p[2] + p[3]] for p in rows])


def features(samples: bytes, media) -> str:
    """Signal statistics of unsigned 8-bit samples; exact integers where they can be."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    level = np.arange(256, dtype=np.int64)
    total, square = int(counts @ level), int(counts @ (level * level))
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    p = counts[counts > 0] / len(x)
    entropy = float(-(p * np.log2(p)).sum()) + 0.0
    return f"samples={len(x)};packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};mean={total / len(x):.6f};rms={(square / len(x)) ** 0.5:.6f};peak={int(np.flatnonzero(counts)[-1])};crossings={crossings};entropy={entropy:.6f}"


def stored(text: bytes) -> bytes:
    return mux(payload_of(text))


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: what was stored, what was read back, and its features."""

    def work(batch, texts):
        rows = []
        for i, doc in enumerate(column(batch, "doc_id").to_pylist()):
            text = texts.text(i)
            data = stored(text)
            media = demux(data)
            back = track_bytes(data, media)
            rows.append((doc, len(text), len(back), sha256_hex(back), zlib.crc32(back[-UNIT:]), len(data), sha256_hex(data), features(back, media), len(media.packets), len(back) * 1000 // 8000))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return map_texts(text_rows(docs, id_col, text_col), work, SCHEMA)


def media_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored files themselves: doc_id, media."""

    def work(batch, texts):
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([stored(texts.text(i)) for i in range(len(texts))], pa.binary())], ["doc_id", "media"])

    return map_texts(text_rows(docs, id_col, text_col), work, "doc_id long, media binary")


def packet_table(files: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per frame of each Matroska file in ``files``; null files have none, a broken one has a row that says why in ``error``."""

    def run(batches):
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not data.is_valid:
                    continue
                try:
                    rows = [(doc, i, p[0], p[6], p[1], p[2], p[3], p[4], p[5], None) for i, p in enumerate(demux(data.as_py()).packets)]
                except MatroskaError as error:
                    rows = [(doc, *[None] * 8, str(error))]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string()]
                names = [c.split()[0] for c in PACKETS.split(", ")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{media_col}` as binary) as media").mapInArrow(run, PACKETS)
