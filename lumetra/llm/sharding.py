"""Contiguous, byte-balanced shards from prefix sums of per-partition totals.

The rows are range-partitioned by key, each partition is totalled, the totals
(one row per partition) are summed up in order, and every row's global byte
position follows from its partition's base plus a running sum inside the
partition. A row belongs to the shard in which the middle of its bytes falls,
so the cuts lie at equal targets and each shard is one contiguous key range.

Defined cases: a null text has no bytes (size 1, crc32 0); a null key sorts
first; equal keys are ordered by crc32, then size; repeated rows are all kept;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import checkpointed, fresh, text_rows


def byte_positions(sized: DataFrame, order: list[str], size: str = "size") -> DataFrame:
    """Add ``row_no`` (from 0), ``bytes_before`` and ``bytes_total`` in the order of the given columns."""
    dealt = sized.withColumn("_tie", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in [*order, "_tie"]]
    dealt = checkpointed(dealt.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy("_part").agg(F.sum(size).alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy("_part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # one row per range partition: small whatever the table's size
    bases = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_base_bytes"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base_rows"),
        F.sum("_bytes").over(everything).alias("bytes_total"),
    )
    inside = W.partitionBy("_part").orderBy(*keys).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        dealt.withColumn("_upto", F.sum(size).over(inside))
        .withColumn("_nth", F.count(F.lit(1)).over(inside))
        .join(F.broadcast(bases), "_part")
        .withColumn("bytes_before", F.col("_base_bytes") + F.col("_upto") - F.col(size))
        .withColumn("row_no", F.col("_base_rows") + F.col("_nth") - 1)
        .drop("_part", "_tie", "_upto", "_nth", "_base_bytes", "_base_rows")
    )


def contiguous_shards(sized: DataFrame, n_shards: int, order: list[str], size: str = "size") -> DataFrame:
    """Add ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 within it)."""
    placed = byte_positions(sized, order, size).withColumn(
        "shard",
        F.least(F.lit(n_shards - 1), F.expr(f"((2 * bytes_before + {size}) * {n_shards}) div (2 * bytes_total)").cast("int")),
    )
    starts = placed.groupBy("shard").agg(F.min("row_no").alias("_first"))  # n_shards rows
    return (
        placed.join(F.broadcast(starts), "shard")
        .withColumn("slot", F.col("row_no") - F.col("_first"))
        .drop("_first", "row_no", "bytes_before", "bytes_total")
    )


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shard and slot of every document, under the ``bytes`` law."""
    sized = text_rows(docs, id_col, text_col).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).alias("text_crc32"),
    )
    return contiguous_shards(sized, n_shards, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents themselves, all rows and columns, as one folder per shard; the files of a folder hold its slots in order of their names.

    The folders are named by a column ``shard`` (``_shard`` where the documents have one).
    """
    text, folder = F.col(f"`{text_col}`").cast("string"), fresh(docs, "shard")
    # documents go through the one exchange that orders them; nothing is joined back
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"), F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).alias("text_crc32"),
    )
    placed = contiguous_shards(sized, n_shards, ["doc_id", "text_crc32", "size"])
    ordered = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.select(*[F.col("doc")[c].alias(c) for c in docs.columns], F.col("shard").alias(folder)).write.partitionBy(folder).parquet(path)
