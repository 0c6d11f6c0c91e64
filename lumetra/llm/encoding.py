"""Byte-level BPE columns by overlapping chunks.

Every text is cut into overlapping chunks of about a kilobyte. The chunks of
many texts are pre-tokenised side by side; the boundaries of neighbouring chunks
are stitched at the first position in their overlap where both have one (from a
common boundary on, the scan of the split pattern is the same), and the pieces
between are encoded. A text in which some overlap has no common boundary (a run
of one kind of characters longer than the overlap) is scanned as one.

A text of more than ``section_bytes`` is first cut, in the same way, into
overlapping sections that are dealt out over tasks and stitched by small rows;
its identifiers and raw bytes are then taken up section after section. Other
texts are encoded where they lie, without a shuffle. With a vocabulary that has
added tokens texts are split at these first, and are not dealt out.

Defined cases: a null text is empty and has no tokens; repeated rows are all
kept; a null doc_id stays null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import SLICE_BYTES, checkpointed, column, map_texts, sha256_hex, shipped, stored, text_rows
from .bpe import encoder
from .pretoken import UNSURE_BYTES, chunked_pieces
from .vectext import Texts

CHUNK_BYTES, OVERLAP_BYTES = 1 << 10, 128
SECTION_BYTES, SECTION_OVERLAP = 1 << 20, 4 << 10

DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
CHUNKS = "row long, n int, doc_id long, at long, text binary"
SCANNED = CHUNKS + ", size long, head binary, tail binary"
ENCODED = "row long, n int, doc_id long, ids binary"


def boundaries(text: bytes, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> np.ndarray:
    """Byte positions at which pieces of a text begin."""
    return chunked_pieces(Texts.of_bytes([text]), chunk, overlap)[0]


def chunk_spans(text: bytes, size: int, overlap: int) -> list[tuple[int, int]]:
    """Overlapping spans that cover the text and begin and end between characters."""
    cut = lambda i: next(j for j in range(min(i, len(text)), -1, -1) if j == len(text) or text[j] & 0xC0 != 0x80)
    spans, at = [], 0
    while True:
        end = cut(at + size + overlap)
        spans.append((at, end))
        if end == len(text):
            return spans
        at = cut(at + size)


def meeting(starts: np.ndarray, end: int, own: np.ndarray, at: int) -> int:
    """First position where a chunk that ends at ``end`` and the next one, from ``at`` on, both have a boundary (-1: none)."""
    common = np.intersect1d(starts[(starts > at) & (starts <= end - UNSURE_BYTES)], own[own > at])
    return int(common[0]) if len(common) else -1


def stitched(chunks: list[tuple[int, bytes, np.ndarray]]) -> tuple[bytes, np.ndarray]:
    """The whole text and its boundaries from (offset, bytes, own boundaries) of overlapping chunks in order."""
    text, starts = bytearray(chunks[0][1]), chunks[0][2]
    for at, part, own in chunks[1:]:
        end = len(text)
        own = own + at
        meet = meeting(starts, end, own, at)
        text += part[end - at :]
        if meet >= 0:
            starts = np.concatenate([starts[starts < meet], own[own >= meet]])
        else:
            sure = starts[starts <= end - UNSURE_BYTES]
            since = int(sure[-1]) if len(sure) else 0
            starts = np.concatenate([starts[starts < since], boundaries(bytes(text[since:])) + since])
    return bytes(text), starts


def digest_batch(ids_of_docs: pa.Array, texts: Texts, ids: np.ndarray, bounds: np.ndarray, enc) -> pa.RecordBatch:
    back = enc.decode(ids, bounds)
    raw, at = memoryview(ids.astype("<u4", copy=False)).cast("B"), (bounds * 4).tolist()
    plain, to = memoryview(np.ascontiguousarray(back.data)), back.bounds.tolist()
    return pa.RecordBatch.from_arrays(
        [
            ids_of_docs,
            pa.array(np.diff(bounds)),
            pa.array([sha256_hex(raw[at[i] : at[i + 1]]) for i in range(len(texts))], pa.string()),
            pa.array([sha256_hex(plain[to[i] : to[i + 1]]) for i in range(len(texts))], pa.string()),
        ],
        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def encode_documents(
    docs: DataFrame, vocabulary: str, pattern: str, chunk_bytes: int = CHUNK_BYTES, overlap_bytes: int = OVERLAP_BYTES,
    section_bytes: int = SECTION_BYTES, section_overlap: int = SECTION_OVERLAP, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Token counts and digests of every document; ``with_ids`` gives doc_id, ids (array) and decoded (binary) instead."""
    rows = text_rows(docs, id_col, text_col)
    shipped(docs.sparkSession, vocabulary)
    long = F.octet_length("text") > section_bytes
    split = lambda texts: chunked_pieces(texts, chunk_bytes, overlap_bytes)
    starts_of = lambda text: boundaries(text, chunk_bytes, overlap_bytes)
    schema = "doc_id long, ids array<long>, decoded binary" if with_ids else DIGESTS

    def outcome(doc_ids, texts: Texts, enc) -> pa.RecordBatch:
        ids, bounds = enc.encode(texts, split)
        if not with_ids:
            return digest_batch(doc_ids, texts, ids, bounds, enc)
        back = enc.decode(ids, bounds)
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int64)))
        return pa.RecordBatch.from_arrays([doc_ids, lists, pa.array([back.text(i) for i in range(len(texts))], pa.binary())], ["doc_id", "ids", "decoded"])

    def whole(batch, texts):
        return outcome(column(batch, "doc_id"), texts, encoder(vocabulary, pattern))

    def cut(batches):
        for batch in batches:
            for row, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = text.encode("utf-8")
                spans = chunk_spans(data, section_bytes, section_overlap)
                for i in range(0, len(spans), 64):
                    some = spans[i : i + 64]
                    arrays = [pa.array([row] * len(some), pa.int64()), pa.array(range(i, i + len(some)), pa.int32()), pa.array([doc] * len(some), pa.int64()), pa.array([a for a, _ in some], pa.int64()), pa.array([data[a:b] for a, b in some], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names_of(CHUNKS))

    def scan(batches):
        for batch in batches:
            sizes, heads, tails = [], [], []
            for text, at in zip(column(batch, "text").to_pylist(), column(batch, "at").to_pylist(), strict=True):
                found = (starts_of(text) + at).astype("<i8")
                sizes.append(len(text))
                heads.append(found[found <= at + section_overlap].tobytes())
                tails.append(found[found >= at + len(text) - section_overlap - 3].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(heads, pa.binary()), pa.array(tails, pa.binary())], names_of(SCANNED))

    def seams(batches):
        for batch in batches:
            pairs = zip(*(column(batch, c).to_pylist() for c in ("tail", "end", "head", "at")), strict=True)
            meets = [meeting(np.frombuffer(tail, "<i8"), end, np.frombuffer(head, "<i8"), at) for tail, end, head, at in pairs]
            yield pa.RecordBatch.from_arrays([column(batch, "row"), column(batch, "n"), pa.array(meets, pa.int64())], ["row", "n", "meet"])

    def encode(batches):
        enc = encoder(vocabulary, pattern)
        for batch in batches:
            out = []
            for at, text, begin, end in zip(*(column(batch, c).to_pylist() for c in ("at", "text", "begin", "end")), strict=True):
                a, b = at if begin is None else begin, at + len(text) if end is None else end
                out.append(encode_pieces(enc, text[a - at : b - at], starts_of(text) + at, a, b).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([column(batch, "row"), column(batch, "n"), column(batch, "doc_id"), pa.array(out, pa.binary())], names_of(ENCODED))

    def taken_up(batches):
        """Chunks in order to rows of documents; a text's last chunk gives its row."""
        enc, held = encoder(vocabulary, pattern), None
        for batch in batches:
            done = []
            for row, doc, ids in zip(*(column(batch, c).to_pylist() for c in ("row", "doc_id", "ids")), strict=True):
                if held is None or held.row != row:
                    done += [held] if held else []
                    held = Running(row, doc, with_ids)
                held.add(np.frombuffer(ids, "<u4"), enc)
            if done:
                yield running_batch(done, with_ids)
        if held:
            yield running_batch([held], with_ids)

    def stitch(group: pa.Table) -> pa.Table:
        group = group.sort_by("n")
        text, starts = stitched([(at, text, starts_of(text)) for at, text in zip(*(group[c].to_pylist() for c in ("at", "text")), strict=True)])
        enc, held = encoder(vocabulary, pattern), Running(0, group["doc_id"][0].as_py(), with_ids)
        # some pieces at a time
        cuts = sorted({0, len(text), *(int(starts[np.searchsorted(starts, p)]) for p in range(SLICE_BYTES, int(starts[-1]), SLICE_BYTES))})
        for a, b in zip(cuts, cuts[1:], strict=False):
            held.add(encode_pieces(enc, text[a:b], starts, a, b), enc)
        return pa.Table.from_batches([running_batch([held], with_ids)])

    # a vocabulary with added tokens splits texts at these first, so its texts stay whole
    apart = F.lit(False) if vocabulary.endswith(".json") else F.coalesce(long, F.lit(False))
    short_rows = map_texts(rows.filter(~apart), whole, schema)
    if vocabulary.endswith(".json"):
        return short_rows
    numbered = rows.filter(apart).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    scanned = stored(numbered.mapInArrow(cut, CHUNKS).repartition("row", "n").mapInArrow(scan, SCANNED))
    # a small row a chunk: where it meets the next one, and whether all chunks of its text meet
    after = scanned.select("row", (F.col("n") - 1).alias("n"), "at", "head")
    ends = scanned.select("row", "n", "tail", (F.col("at") + F.col("size")).alias("end"))
    meets = checkpointed(ends.join(after, ["row", "n"]).select("row", "n", "tail", "end", "head", "at").mapInArrow(seams, "row long, n int, meet long"))
    whole_rows = meets.groupBy("row").agg((F.min("meet") >= 0).alias("_meets"))
    spans = scanned.select("row", "n").join(meets.withColumnRenamed("meet", "end"), ["row", "n"], "left").join(meets.select("row", (F.col("n") + 1).alias("n"), F.col("meet").alias("begin")), ["row", "n"], "left")
    spans = checkpointed(spans.join(whole_rows, "row", "left").withColumn("_meets", F.coalesce("_meets", F.lit(True))))
    met = scanned.select(*names_of(CHUNKS)).join(spans, ["row", "n"])
    encoded = met.filter("_meets").select("row", "n", "doc_id", "at", "text", "begin", "end").mapInArrow(encode, ENCODED)
    long_rows = encoded.repartition("row").sortWithinPartitions("row", "n").mapInArrow(taken_up, schema)
    broken_rows = met.filter("not _meets").groupBy("row").applyInArrow(stitch, schema)
    return short_rows.unionByName(long_rows).unionByName(broken_rows)


def names_of(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class Running:
    """Identifiers of one text, taken up a run at a time: digests, or with ``with_ids`` the values."""

    def __init__(self, row: int, doc_id: int | None, with_ids: bool):
        self.row, self.doc_id, self.count, self.kept = row, doc_id, 0, [] if with_ids else None
        self.ids_hash, self.bytes_hash = hashlib.sha256(), hashlib.sha256()

    def add(self, ids: np.ndarray, enc) -> None:
        back = enc.decode(ids, np.array([0, len(ids)])).text(0)
        self.count += len(ids)
        if self.kept is None:
            self.ids_hash.update(ids.astype("<u4").tobytes())
            self.bytes_hash.update(back)
        else:
            self.kept.append((ids.astype(np.int64), back))


def running_batch(done: list[Running], with_ids: bool) -> pa.RecordBatch:
    docs = pa.array([r.doc_id for r in done], pa.int64())
    if with_ids:
        ids = [np.concatenate([np.zeros(0, np.int64), *(i for i, _ in r.kept)]) for r in done]
        return pa.RecordBatch.from_arrays([docs, pa.array(ids, pa.list_(pa.int64())), pa.array([b"".join(b for _, b in r.kept) for r in done], pa.binary())], ["doc_id", "ids", "decoded"])
    return pa.RecordBatch.from_arrays([docs, pa.array([r.count for r in done], pa.int64()), pa.array([r.ids_hash.hexdigest() for r in done], pa.string()), pa.array([r.bytes_hash.hexdigest() for r in done], pa.string())], names_of(DIGESTS))


def encode_pieces(enc, part: bytes, starts: np.ndarray, a: int, b: int) -> np.ndarray:
    """Identifiers of ``part``, which lies from a to b in a text, each of its pieces encoded on its own."""
    lo, hi = np.searchsorted(starts, [a, b])
    begin = starts[lo:hi] - a
    return enc.encode_spans(Texts.of_bytes([part]), begin, np.append(begin[1:], b - a))[0]
