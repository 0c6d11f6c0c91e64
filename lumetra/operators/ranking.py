"""Ranks over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import shared_folder


def global_rank(df: DataFrame, order: list[str]) -> DataFrame:
    """Add ``rank`` (from 1, in the order of the columns, which must tell rows apart) and ``total``.

    Range partitions are counted; a row's rank is the count of the partitions
    before its own and its place inside. Rows and counts must see the same
    partitions, so these are computed once, into the checkpoint folder.
    """
    shared_folder(df.sparkSession)
    dealt = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy("_part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # one row per range partition
    bases = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(whole).alias("total"))
    nth = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_nth", nth).join(F.broadcast(bases), "_part").withColumn("rank", F.col("_base") + F.col("_nth")).drop("_part", "_nth", "_base")


def running_total(df: DataFrame, order: list[str], weight: str) -> DataFrame:
    """Add ``upto``: the sum of ``weight`` over a row and all before it, in the order of the columns, which must tell rows apart.

    As ``global_rank``: sums inside range partitions, and over the partitions, of which there is one small row each.
    """
    shared_folder(df.sparkSession)
    dealt = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    sums = dealt.groupBy("_part").agg(F.sum(weight).alias("_n"))
    bases = sums.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return dealt.withColumn("_inside", F.sum(weight).over(inside)).join(F.broadcast(bases), "_part").withColumn("upto", F.col("_base") + F.col("_inside")).drop("_part", "_inside", "_base")


def percentiles(df: DataFrame, value: str, keys: list[str], wanted: dict[str, float]) -> DataFrame:
    """keys and, by name, linearly interpolated percentiles (0 to 100) of the values that are not null, exact for any number of distinct ones.

    Equal values are counted first; the counts are summed up over range
    partitions of (keys, value), so a key of any size lies over as many tasks as
    it needs and no buffer holds it.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_total(counts, [*keys, "_v"], "_n")
    by = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    spans = placed.groupBy(*by).agg(F.min(F.col("upto") - F.col("_n")).alias("_first"), F.sum("_n").alias("_count"))
    met = placed.join(spans, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]) if keys else placed.crossJoin(F.broadcast(spans))  # one row without keys
    upto, before = F.col("upto") - F.col("_first"), F.col("upto") - F.col("_n") - F.col("_first")
    found = []
    for name, percent in wanted.items():
        at = (F.col("_count") - 1) * (percent / 100.0) + 1
        holds = lambda rank: F.max(F.when((before < rank) & (rank <= upto), F.col("_v")))
        found += [holds(F.floor(at)).alias(f"_low_{name}"), holds(F.ceil(at)).alias(f"_high_{name}"), F.max(at - F.floor(at)).alias(f"_part_{name}")]
    between = lambda n: (F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * F.col(f"_part_{n}")).alias(n)
    return met.groupBy(*keys).agg(*found).select(*keys, *[between(n) for n in wanted])


def first_per_kind(df: DataFrame, kind: str, order: list[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows of each kind and how many more there are: a preview of what a run would do."""
    shown = W.partitionBy(kind).orderBy(*order)
    totals = df.groupBy(kind).agg(F.count(F.lit(1)).alias("_n"))
    return df.withColumn("nth", F.row_number().over(shown).cast("long")).filter(F.col("nth") <= n).join(totals, kind).withColumn("more", F.greatest(F.col("_n") - n, F.lit(0))).drop("_n")
