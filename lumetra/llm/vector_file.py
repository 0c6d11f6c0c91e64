"""Exact top-k by a vector-approximation file.

The file holds, in blocks, the quantised cell of every component of every
vector and nothing else; exact vectors stay in a table by row. Of equal vectors
the file holds those of the k + 1 smallest identifiers: no query ranks another
of them among its first k. A search has three steps:

1. *Scan.* Queries meet blocks of cells in a grid of rectangles of bounded
   sides, one task each. Cells give a lower and an upper bound of each score; a
   task carries each query's k greatest lower bounds from block to block, and
   gives the vectors that the k-th of them leaves.
2. *Shared bound.* The k-th greatest lower bound over all rectangles drops what
   cannot reach a query's k best any more.
3. *Exact vectors.* They are fetched by row in the order of their bounds: the
   first ``2 * k`` a query, whose k-th score then says which of the rest could
   still be better; only these are fetched as well.

Defined cases: vectors that are null, or hold null or non-finite components,
or are of another length than most, take no part; empty vectors score 0; a
finite component whose floor(scale * x) does not fit a long is an error, as is
a score that does not; ties go to the smaller vec_id; rows of one vec_id are
queries and candidates of their own but not of each other; fewer candidates
than k give all of them; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import bound_batches, checkpointed, column, release, stored

CELL_BITS = 6
#: Rows of a block of cells and of a block of queries at most, and components of one where vectors are long.
BLOCK_ROWS, QUERY_ROWS, BLOCK_VALUES = 8192, 1024, 1 << 19
#: Sides of a rectangle at most, and rectangles at least (where there are so many blocks), so that small tables too use many tasks.
ROWS_SIDE, QUERIES_SIDE, SPREAD = 1 << 17, 1 << 12, 24
#: Survivors that a block of queries holds back before it gives them out.
HELD = 1 << 18

BLOCKS = "range int, kind int, rows binary, ids binary, vectors binary, low binary, high binary"
SEEN = "query_row long, row long, vec_id long, least double, most double"
OUT = "query_id long, rank int, vec_id long, score long"


def quantised(vectors: np.ndarray, bits: int = CELL_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of every component, and the least and greatest component of each cell, as [dim, cells] marks.

    Cells of a component are cut at equal counts of this block's own values.
    """
    n, dim = vectors.shape
    k = 1 << bits
    cells = np.zeros((n, dim), np.uint8)
    low = np.zeros((dim, k), np.int64)
    high = np.zeros((dim, k), np.int64)
    for j in range(dim):
        column = vectors[:, j]
        ordered = np.sort(column)
        marks = np.unique(ordered[(np.arange(1, k) * n) // k])
        own = np.searchsorted(marks, column, side="right")
        cells[:, j] = own
        for c in np.unique(own):
            inside = column[own == c]
            low[j, c], high[j, c] = inside.min(), inside.max()
    return cells, low, high


def cell_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of every (query, vector) inner product from the ends of the vectors' cells, as floats.

    q * x lies within |q| * half a cell of q * the cell's middle; everything is
    doubled to stay whole, and widened by what floating addition can lose.
    """
    q = queries.astype(np.float64)
    size = np.abs(q)
    middle, half = q @ (low + high).T, size @ (high - low).T
    most = max(np.abs(low).max(initial=0), np.abs(high).max(initial=0))
    slack = (size.sum(axis=1) * most * 2 * (low.shape[1] + 1) * 2.0**-50)[:, None]
    return (middle - half - slack) / 2, (middle + half + slack) / 2


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products row by row; Python integers where 64 bits might not hold them."""
    # as floats, for the least long has no absolute value
    size = np.abs(queries.astype(np.float64)).max(axis=1, initial=0) * np.abs(vectors.astype(np.float64)).max(axis=1, initial=0) * queries.shape[1]
    score = np.einsum("ij,ij->i", queries, vectors)
    for i in np.flatnonzero(size >= 2.0**62).tolist():
        big = sum(int(a) * int(b) for a, b in zip(queries[i], vectors[i], strict=True))
        if not -(2**63) <= big < 2**63:
            raise OverflowError("a score does not fit a long")
        score[i] = big
    return score


class Survivors:
    """Of the blocks met so far, what each query of a block may still rank among its first k."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, held: int = HELD):
        self.rows, self.ids, self.vectors, self.k, self.held = rows, ids, vectors, k, held
        self.best = np.full((len(ids), k), -np.inf)  # the k greatest lower bounds, in no order
        self.kept, self.n = [], 0

    def meet(self, rows: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Take a block of vectors in, given the ends of their cells; rows of the query's own id are left out."""
        for begin in range(0, len(self.ids), 128):
            part = slice(begin, begin + 128)
            least, most = cell_bounds(self.vectors[part], low, high)
            own = self.ids[part, None] == ids[None, :]
            least[own] = most[own] = -np.inf
            self.best[part] = np.partition(np.concatenate([self.best[part], least], axis=1), len(ids), axis=1)[:, len(ids) :]
            query, vector = np.nonzero((most >= self.best[part].min(axis=1)[:, None]) & ~own)
            self.kept.append([query + begin, rows[vector], ids[vector], least[query, vector], most[query, vector]])
            self.n += len(query)
            if self.n > self.held:
                self.prune()
                if 2 * self.n > self.held:
                    yield from self.result()

    def prune(self) -> None:
        query, rows, ids, least, most = (np.concatenate(parts) for parts in zip(*self.kept, strict=True))
        fit = most >= self.best.min(axis=1)[query]
        self.kept, self.n = [[x[fit] for x in (query, rows, ids, least, most)]], int(fit.sum())

    def result(self):
        """What is held, given out."""
        if self.kept:
            self.prune()
            query, *rest = self.kept[0]
            self.kept, self.n = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (self.rows[query], *rest)], [c.split()[0] for c in SEEN.split(", ")])


def integer_vectors(embeddings: DataFrame, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """vec_id and floor(scale * component) of every vector that takes part, and the columns to keep."""
    vector = F.col(f"`{vector_col}`")
    fit = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))

    def whole(c):
        scaled = c.cast("double") * F.lit(scale)
        fits = (scaled >= F.lit(-(2.0**63))) & (scaled < F.lit(2.0**63))
        return F.when(fits, F.floor(scaled).cast("long")).otherwise(F.raise_error(F.lit("a scaled component does not fit a long")).cast("long"))

    return embeddings.filter(F.coalesce(fit, F.lit(False)) & F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"),
        F.transform(vector, whole).alias("vector"),
        *(keep or []),
    )


def packed(rows: pa.Table | pa.RecordBatch, dim: int, vector: str = "vector") -> np.ndarray:
    flat = rows.column(vector)
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    return flat.flatten().to_numpy().reshape(rows.num_rows, dim)


def raw(values: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(values).tobytes()], pa.binary())


def candidates(vectors: DataFrame, k: int) -> DataFrame:
    """The rows that can be among a query's first k: of equal vectors those of the k + 1 smallest ids, of which one may be the query's own.

    Spark limits both groups before their exchange as well, so copies do not reach one task whole.
    """
    repeated, equal = W.partitionBy("vector", "vec_id").orderBy("row"), W.partitionBy("vector").orderBy("vec_id")
    kept = vectors.withColumn("_n", F.row_number().over(repeated)).filter(F.col("_n") <= k)
    return kept.withColumn("_n", F.dense_rank().over(equal)).filter(F.col("_n") <= k + 1).drop("_n")


def scan_grid(n: int, q: int, n_blocks: int, rows_side: int, queries_side: int) -> tuple[int, int]:
    """Ranges of rows and ranges of queries."""
    down = -(-q // queries_side)
    return max(-(-n // rows_side), min(-(-SPREAD // down), n_blocks)), down


def scanned(vectors: DataFrame, is_query, dim: int, n_blocks: int, n_queries: int, grid: tuple[int, int], k: int, bits: int) -> DataFrame:
    """Step 1: bounds of what every rectangle of rows and queries leaves to its queries."""
    across, down = grid
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def packing(kind: int, over: int):
        def pack(group: pa.Table) -> pa.Table:
            own = packed(group, dim)
            cells, low, high = quantised(own, bits) if kind else (own, own[:0], own[:0])
            arrays = [pa.array([group["b"][0].as_py() % over], pa.int32()), pa.array([kind], pa.int32())]
            return pa.Table.from_arrays([*arrays, *[raw(x) for x in (group["row"].to_numpy(), group["vec_id"].to_numpy(), cells, low, high)]], names)

        return pack

    def blocks(rows: DataFrame, n: int, kind: int, over: int, other: int, part: str) -> DataFrame:
        dealt = rows.withColumn("b", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")).groupBy("b").applyInArrow(packing(kind, over), BLOCKS)
        # to every rectangle of its line of the grid: the stated query set against all rows, in blocks
        return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(other - 1)))).withColumn("part", F.expr(part)).drop("other", "range")

    cells = blocks(candidates(vectors, k), n_blocks, 1, across, down, f"range * {down} + other")
    asked = blocks(vectors.filter(is_query), n_queries, 0, down, across, f"other * {down} + range")

    def scan(batches):
        held = []
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c, kind="<i8": np.frombuffer(column(batch, c)[i].as_buffer(), kind)  # noqa: B023, E731
                if column(batch, "kind")[i].as_py() == 0:
                    held.append(Survivors(get("rows"), get("ids"), get("vectors").reshape(-1, dim), k))
                    continue
                at, own = np.arange(dim), get("vectors", "u1").reshape(-1, dim)
                low, high = (get(c).reshape(dim, -1)[at, own].astype(np.float64) for c in ("low", "high"))
                for queries in held:
                    yield from queries.meet(get("rows"), get("ids"), low, high)
        for queries in held:
            yield from queries.result()
        release()

    dealt = asked.unionByName(cells).repartitionById(across * down, F.col("part").cast("int")).sortWithinPartitions("kind")
    return dealt.mapInArrow(scan, SEEN)


def scored(pairs: DataFrame, vectors: DataFrame, is_query, dim: int) -> DataFrame:
    """(query_row, query_id, vec_id, score) of pairs (query_row, row), their exact vectors fetched by row."""

    def score(batches):
        for batch in batches:
            found = exact_scores(packed(batch, dim, "query"), packed(batch, dim))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("query_row", "query_id", "vec_id")], pa.array(found)], ["query_row", "query_id", "vec_id", "score"])

    queries = vectors.filter(is_query).select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    met = pairs.select("query_row", "row").join(vectors, "row").join(queries, "query_row")
    return met.select("query_row", "query_id", "vec_id", "query", "vector").mapInArrow(score, "query_row long, query_id long, vec_id long, score long")


def top_k(embeddings: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, bits: int = CELL_BITS, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, id_col: str = "vec_id", vector_col: str = "embedding", rows_side: int = ROWS_SIDE, queries_side: int = QUERIES_SIDE) -> DataFrame:
    """Each query's k nearest by inner product: query_id, rank, vec_id, score. Queries: ids divisible by ``every``."""
    bound_batches(embeddings.sparkSession)
    # the exact vectors by row: written once, so that a row keeps its number
    vectors = stored(integer_vectors(embeddings, scale, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()))
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    sizes = vectors.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes or not sizes[0]["q"]:
        return embeddings.sparkSession.createDataFrame([], OUT)
    dim, n, q = (int(sizes[0][c]) for c in ("dim", "n", "q"))
    vectors = vectors.filter(F.size("vector") == dim)
    if not dim:
        dim, vectors = 1, vectors.withColumn("vector", F.array(F.lit(0).cast("long")))
    block_rows, query_rows = (min(x, max(256, BLOCK_VALUES // dim)) for x in (block_rows, query_rows))
    n_blocks = -(-n // block_rows)
    seen = checkpointed(scanned(vectors, is_query, dim, n_blocks, -(-q // query_rows), scan_grid(n, q, n_blocks, rows_side, queries_side), k, bits))
    by_least = W.partitionBy("query_row").orderBy(F.desc("least"), "row")
    floors = seen.withColumn("_nth", F.row_number().over(by_least)).filter(F.col("_nth") == k).select("query_row", F.col("least").alias("_floor"))
    alive = seen.join(floors, "query_row", "left").filter("_floor is null or most >= _floor")
    by_most = W.partitionBy("query_row").orderBy(F.desc("most"), "vec_id", "row")
    alive = checkpointed(alive.withColumn("_nth", F.row_number().over(by_most)).select("query_row", "row", "most", "_nth"))
    first = checkpointed(scored(alive.filter(F.col("_nth") <= 2 * k), vectors, is_query, dim))
    best = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    certain = first.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") == k).select("query_row", F.col("score").alias("_kth"))
    rest = alive.filter(F.col("_nth") > 2 * k).join(certain, "query_row", "left").filter("_kth is null or most >= _kth")
    everything = first.unionByName(scored(rest, vectors, is_query, dim))
    return everything.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
