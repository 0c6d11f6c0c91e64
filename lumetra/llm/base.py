"""Shared plumbing: table access, Arrow mapping in bounded slices, shared checkpoints."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vectext import Texts

#: Bytes of text that a vectorised pass takes at once; memory of a task follows it, not the partition.
SLICE_BYTES = (1 << 20) - 64
#: Spark's bound on the bytes of an Arrow batch, and what it is set to where the session has left it as it was.
BATCH_BYTES, DEFAULT_BATCH_BYTES, BOUNDED_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "2m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the identifier (long) and the text (string, null kept): other columns cannot clash."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def bound_batches(spark: SparkSession) -> None:
    """Have texts reach Python by bytes a batch and not by rows alone, so that long ones do not pile up."""
    if spark.conf.get(BATCH_BYTES, DEFAULT_BATCH_BYTES) == DEFAULT_BATCH_BYTES:
        spark.conf.set(BATCH_BYTES, BOUNDED_BATCH)


def release() -> None:
    """Give back what a long-lived Python worker has freed; idle workers otherwise keep their peak."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def map_texts(rows: DataFrame, work: Callable[[pa.RecordBatch, Texts], pa.RecordBatch], schema: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Run ``work`` over slices of the rows of about ``slice_bytes`` of text; a narrow, stateless map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = Texts.of_arrow(batch.column(batch.schema.get_field_index("text")))
            for at, part in texts.slices(slice_bytes):
                yield work(batch.slice(at, len(part)), part)
        release()

    return rows.mapInArrow(run, schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


def column(batch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder; a temporary one where none is set and all runs on one machine, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, cutting its lineage.

    The folder is ``spark.checkpoint.dir``, which all executors must share.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below the checkpoint folder, with which it is cleared away, and read again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sha256_hex(data) -> str:
    import hashlib

    return hashlib.sha256(data).hexdigest()


def shipped(spark: SparkSession, path: str) -> str:
    """Have Spark bring a small local file to executors that do not have it where the driver does."""
    spark.sparkContext.addFile(path)
    return path


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file; LUMETRA_TOKENIZERS names another folder."""
    folder = os.environ.get("LUMETRA_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
