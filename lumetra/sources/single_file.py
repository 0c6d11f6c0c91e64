"""One text file written by many tasks.

Tasks render their part of the rows to blocks of bytes; a block begins where the
blocks before it end (running sums inside a part, and over the parts, of which
there is one small row each); blocks are written to their places of a file that
gets its name when all are there. Paths are on storage that executors mount.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bands import TASK_BYTES, spread
from .scratch import stored

#: Bytes of a block, about.
BLOCK_BYTES = 4 << 20


def write_lines(lines: DataFrame, path: str, head: str | None = None, block_bytes: int = BLOCK_BYTES) -> int:
    """Write the strings of the only column of ``lines``, a line each in the order of its partitions, behind a line ``head``; gives the bytes."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    first = b"" if head is None else head.encode() + b"\n"

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, nth = [], 0, 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([partition], pa.int32()), pa.array([nth], pa.int32()), pa.array([b"".join(held)], pa.binary())], ["part", "nth", "data"])

        for batch in batches:
            partition = batch.column(0)[0].as_py() if batch.num_rows else None
            for line in batch.column(1).to_pylist():
                held.append((line or "").encode() + b"\n")
                size += len(held[-1])
                if size >= block_bytes:
                    yield block()
                    held, size, nth = [], 0, nth + 1
        if held:
            yield block()

    blocks = stored(lines.select(F.spark_partition_id().alias("part"), F.col(f"`{lines.columns[0]}`").cast("string").alias("line")).mapInArrow(render, "part int, nth int, data binary"))
    sizes = blocks.select("part", "nth", F.length("data").cast("long").alias("size"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # one row a part
    bases = sizes.groupBy("part").agg(F.sum("size").alias("_all")).select("part", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy("part").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)
    places = sizes.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(F.broadcast(bases), "part").select("part", "nth", (F.col("at") + F.col("_base") + len(first)).alias("at"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = os.open(part, os.O_WRONLY | os.O_CREAT, 0o666)
            try:
                for at, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    view, done = memoryview(data.as_buffer()), 0
                    while done < len(view):
                        done += os.pwrite(f, view[done:], at + done)
            finally:
                os.close(f)
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(d.as_buffer()) for d in batch.column(1))], pa.int64())], ["size"])

    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(part, "wb") as f:
        f.write(first)
    met = blocks.join(places, ["part", "nth"]).select("at", "data")
    total = stored(spread(met, blocks.count(), "at", task_rows=max(1, TASK_BYTES // block_bytes)).mapInArrow(put, "size long")).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] + len(first)
    if os.path.getsize(part) != total:
        raise OSError(f"{path}: {os.path.getsize(part)} bytes of {total}")
    os.replace(part, path)
    return total
