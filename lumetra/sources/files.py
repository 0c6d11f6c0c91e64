"""File listings and measurement tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import NUCLEI
from .scratch import stored
from .single_file import write_lines
from .walk import local_path, matching, walk


def listing(spark: SparkSession, roots: str | list[str], pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, length and modificationTime of matching files; contents are never read.

    On mounted storage tasks list the directories (``walk``). In a store that
    only Spark reads its own scan does, which passes over empty files and over
    directories whose name begins with '_' or '.'.
    """
    roots = [roots] if isinstance(roots, str) else roots
    mounted = [local_path(r) for r in roots]
    if None not in mounted:
        return matching(walk(spark, mounted, recursive), pattern)
    scans = [spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(r) for r in roots]
    return reduce(DataFrame.unionByName, [scan.select("path", "length", "modificationTime") for scan in scans]).dropDuplicates(["path"])


def stream_listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """The same as a stream: files that appear are listed once, across restarts with a checkpoint."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")


def named_files(spark: SparkSession, path: str) -> DataFrame:
    """A list of file names, a line each."""
    return spark.read.text(path)


def nuclei(spark: SparkSession, path: str, passthrough: str | None = None, strict: bool = False, keep: list[str] = ()) -> DataFrame:
    """Measured objects from CSV. A column named ``passthrough`` is kept as text, 'N/A' if the file has none; those of ``keep`` must be there."""
    held = spark.read.option("header", True).csv(path)
    missing = ({f.name for f in NUCLEI.fields} | set(keep)) - set(held.columns) - {"ImageNumber"}
    if missing:
        raise ValueError(f"columns missing from {path}: {', '.join(sorted(missing))}")
    cast = lambda f: F.col(f.name).cast(f.dataType) if strict else F.col(f.name).try_cast(f.dataType)
    columns = [(cast(f) if f.name in held.columns else F.lit(1).cast("int")).alias(f.name) for f in NUCLEI.fields]
    if passthrough is not None:
        columns.append((F.col(passthrough) if passthrough in held.columns else F.lit("N/A")).alias("IntegratedIntensity"))
    return held.select(columns + [F.col(f"`{c}`") for c in keep if c not in NUCLEI.names])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """The rows of one CSV file with a header, and ``line``, their number in it from 1.

    A large file is read in blocks by many tasks. A block's rows are counted, and
    its first row's number is the sum over the blocks before it, of which there is
    one small row each. How a file is cut depends on the cores there are at the
    time, so counts and rows come from one reading, which is kept.
    """
    held = spark.read.option("header", True).csv(path)
    held = stored(held.withColumns({"_block": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()}))
    blocks = held.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    bases = blocks.select("_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_base"))
    return held.join(F.broadcast(bases), "_block").withColumn("line", F.col("_at") + F.col("_base")).drop("_block", "_at", "_base")


def write_measurements(df: DataFrame, path: str, order: list[str] = (), single_file: bool = False) -> None:
    """CSV with a header and NaN written out; ordered where asked for. ``single_file``: one file of that name, which many tasks write."""
    out = df.orderBy(*order) if order else df
    if not single_file:
        out.write.mode("overwrite").option("header", True).option("nanValue", "NaN").csv(path)
        return
    columns = [F.col(f"`{c}`") for c in df.columns]
    write_lines(out.select(F.to_csv(F.struct(*columns), {"nanValue": "NaN"}).alias("line")), path, ",".join(df.columns))


def write_export(objects: DataFrame, images: DataFrame, folder: str, prefix: str) -> None:
    """Measurements of objects and of images as two files whose names begin alike."""
    for name, table in (("Objects", objects), ("Images", images)):
        write_measurements(table, f"{folder.rstrip('/')}/{prefix}{name}.csv", single_file=True)
