"""A folder that all tasks can write to and read from."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder; without one, and on one machine, a temporary folder is made it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        root = context.getConf().get("spark.checkpoint.dir")
        if not root:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            root = tempfile.mkdtemp(prefix="lumetra-")
        context.setCheckpointDir(root)
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A new local path below the checkpoint folder."""
    url = urlparse(shared_folder(spark))
    if url.scheme not in ("", "file"):
        raise RuntimeError(f"images are written through mounted folders, not {url.scheme}")
    path = os.path.join(url.path, f"{name}-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below the checkpoint folder, and read again: what it did is done once, whatever is lost later.

    The planner takes it for as large as its file, which for pixels and objects of an image (names
    repeated, places in order) can be a hundredth of the rows: their joins carry the merge hint.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
