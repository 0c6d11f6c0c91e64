"""Directory trees listed by tasks, level by level.

A directory is a row; a task lists it and gives its entries as they come, and
the directories among them are the next level's rows. No list of paths is ever
on the driver, which only learns how many directories a level has. Files of any
name are seen, those in directories that begin with ``_`` or ``.`` and empty
ones as well.

Defined cases: a root that is a file is listed itself, a root that is not there
is an error; links to directories are not followed, links to files count as
what they point to; what vanishes while it is listed is left out; names that
are not UTF-8 have replacement characters. A single directory is listed by a
single task, as its entries come one after another.
"""

from __future__ import annotations

import datetime
import glob
import os
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bands import spread
from .scratch import stored

ENTRIES = "path string, directory boolean, length long, modificationTime timestamp"
#: Entries of a batch of rows.
BATCH = 10_000


def glob_matches(name: Column, pattern: str) -> Column:
    """Whether a name matches a pattern of ``*``, ``?``, ``[...]`` and ``{one,another}``."""
    out, depth = "", 0
    parts = re.findall(r"\[[^\]]+\]|.", pattern, re.DOTALL)
    for p in parts:
        if p == "{":
            out, depth = out + "(?:", depth + 1
        elif p == "}" and depth:
            out, depth = out + ")", depth - 1
        elif p == "," and depth:
            out += "|"
        elif p[0] == "[" and len(p) > 1:
            out += "[^" + p[2:] if p[1] == "!" else p
        else:
            out += {"*": ".*", "?": "."}.get(p, re.escape(p))
    return name.rlike(f"(?s)^(?:{out})$")


def local_path(path: str) -> str | None:
    """The path on mounted storage, or None for a store that only Spark reads."""
    scheme = re.match(r"^([A-Za-z][A-Za-z0-9+.-]*):", path)
    return path if scheme is None else re.sub(r"^file:/+", "/", path) if scheme[1] == "file" else None


def walk(spark: SparkSession, roots: list[str], recursive: bool = True) -> DataFrame:
    """path, length and modificationTime of all files below the roots, whose own patterns are expanded."""
    found = sorted({p for root in roots for p in (glob.glob(root) if glob.has_magic(root) else [root])})
    for root in found:
        if not os.path.exists(root):
            raise FileNotFoundError(root)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        utc = datetime.timezone.utc
        schema = pa.schema([("path", pa.string()), ("directory", pa.bool_()), ("length", pa.int64()), ("modificationTime", pa.timestamp("us", "UTC"))])
        told = lambda path: path.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            held = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return held

        def add(path: str, state) -> None:
            rows.append((told(path), False, state.st_size, datetime.datetime.fromtimestamp(state.st_mtime, utc)))

        for batch in batches:
            for path in batch.column(0).to_pylist():
                if os.path.isfile(path):
                    add(path, os.stat(path))
                    continue
                try:
                    with os.scandir(path) as entries:
                        for entry in entries:
                            try:
                                if entry.is_dir(follow_symlinks=False):
                                    rows.append((told(entry.path), True, None, None))
                                elif entry.is_file():
                                    add(entry.path, entry.stat())
                            except FileNotFoundError:
                                continue
                            if len(rows) >= BATCH:
                                yield out()
                except FileNotFoundError:
                    continue
        if rows:
            yield out()

    level, n, levels = spark.createDataFrame([(p,) for p in found], "path string"), len(found), []
    while n:
        entries = stored(spread(level, n, "path", task_rows=16).mapInArrow(scan, ENTRIES))
        levels.append(entries.filter("not directory").select("path", "length", "modificationTime"))
        level = entries.filter("directory").select("path")
        n = level.count() if recursive else 0
    if not levels:
        return spark.createDataFrame([], "path string, length long, modificationTime timestamp")
    files = reduce(DataFrame.unionByName, levels)
    return files.dropDuplicates(["path"]) if len(found) > 1 else files


def matching(files: DataFrame, pattern: str) -> DataFrame:
    """Files whose name matches a pattern."""
    return files if pattern == "*" else files.filter(glob_matches(F.substring_index("path", "/", -1), pattern))
