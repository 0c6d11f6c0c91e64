"""Hard negatives by Four-Russians scoring.

Vectors are whole numbers, so a score is a sum over bit planes. Components are
taken in groups of eight. For an anchor and a group, a table holds the sum of
each of the 256 subsets of the anchor's eight components; a candidate is packed
to one byte a group and bit plane, and looks its partial sums up. A plane's sum
is shifted by its place (the sign's plane counts negative) and added: the full
exact score, with no multiplication of components.

Anchors meet all rows in a grid of rectangles of bounded size, one task each.
The grid is scored twice: once for the positives of each anchor, and once for
the negatives that lie in the range that these positives set. A task keeps a
few rows an anchor, so what it sends does not grow with what it reads.

Defined cases: rows whose identifier, label or vector is null, or whose vector
holds null or non-finite components or is of another length than most, take no
part; a finite component whose floor(scale * x) does not fit a long, and a
score that does not, is an error; empty vectors score 0; ties go to the smaller
identifier; rows of one identifier are anchors of their own, but neither
positives nor negatives of each other, and rows repeated otherwise count each;
an anchor without another row of its label gives nothing; an empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import bound_batches, release, stored
from .vector_file import integer_vectors, packed

#: Sides of a rectangle at most, and of the blocks that a task scores at once.
ROWS, ANCHORS = 1 << 17, 1 << 13
BLOCK, TABLES = 2048, 256
#: Rectangles at least (where there are so many rows), so that small tables too use many tasks.
SPREAD = 24

OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
BLOCKS = "part int, kind int, n int, rows binary, ids binary, labels binary, vectors binary, least binary"


def subset_sums(anchors: np.ndarray, kind: np.dtype) -> np.ndarray:
    """[groups, 256, anchors]: the sum of every subset of each group of eight components."""
    n, dim = anchors.shape
    groups = anchors.T.reshape(dim // 8, 8, n).astype(kind)
    table = np.zeros((dim // 8, 256, n), kind)
    for bit in range(8):
        half = 1 << bit
        table[:, half : 2 * half] = table[:, :half] + groups[:, bit, None]
    return table


def bit_planes(vectors: np.ndarray) -> np.ndarray:
    """[groups, planes, rows]: the bytes that index the tables; two's complement in as many planes as the values need."""
    n, dim = vectors.shape
    folded = np.where(vectors < 0, ~vectors, vectors)
    planes = int(folded.max(initial=0)).bit_length() + 1
    out = np.empty((dim // 8, planes, n), np.uint8)
    for plane in range(planes):
        bits = ((vectors >> plane) & 1).astype(np.uint8)
        out[:, plane] = np.packbits(bits.reshape(n, dim // 8, 8), axis=2, bitorder="little")[:, :, 0].T
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """[rows, anchors]: every score, by look-ups, shifts and additions, in the tables' kind of number."""
    groups, n_planes, n = planes.shape
    total = None
    for plane in range(n_planes - 1, -1, -1):
        part = tables[0].take(planes[0, plane], axis=0)
        for group in range(1, groups):
            part += tables[group].take(planes[group, plane], axis=0)
        if total is None:  # the sign's plane
            total = -part
        else:
            total += total
            total += part
    return total


def number_kind(anchors: np.ndarray, vectors: np.ndarray) -> type:
    """The smallest kind of number that holds all sums on the way: each is at most sum |a| * 2 * max |x|."""
    most = np.abs(anchors.astype(np.float64)).sum(axis=1).max(initial=0) * 2 * (np.abs(vectors.astype(np.float64)).max(initial=0) + 1)
    return np.int32 if most < 2.0**31 else np.int64 if most < 2.0**62 else object


def block_scores(anchors: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """[rows, anchors] as longs; an error where one does not fit."""
    kind = number_kind(anchors, vectors)
    if kind is object:
        anchors, kind = anchors.astype(object), np.dtype(object)
    found = scores(subset_sums(anchors, kind), bit_planes(vectors))
    if found.dtype == object:
        if any(not -(2**63) <= s < 2**63 for s in found.ravel().tolist()):
            raise OverflowError("a score does not fit a long")
        found = found.astype(np.int64)
    return found


def first_of(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group, higher scores and then smaller identifiers first."""
    order = np.lexsort((ids, ~score, group))
    ordered = group[order]
    begin = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
    nth = np.arange(len(ordered)) - np.repeat(begin, np.diff(np.r_[begin, len(ordered)]))
    return order[nth < k]


def leaders(score: np.ndarray, fit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) of what may be among an anchor's first k of those that fit: all that reach its k-th score."""
    floor = np.iinfo(score.dtype).min
    held = np.where(fit, score, floor)
    if len(held) > k:
        kth = np.partition(held, len(held) - k, axis=0)[len(held) - k]
        fit = fit & (held >= kth)
    row, anchor = np.nonzero(fit)
    return anchor, row


class Best:
    """The first k of each group so far."""

    def __init__(self, k: int):
        self.k, self.kept = k, [np.zeros(0, np.int64)] * 3

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        first = first_of(group, score, ids, self.k)  # of this block alone, then with what was kept
        parts = [np.concatenate([a, b[first].astype(np.int64)]) for a, b in zip(self.kept, (group, score, ids), strict=True)]
        first = first_of(*parts, self.k)
        self.kept = [p[first] for p in parts]


def _binary(values: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(values, "<i8").tobytes()], pa.binary())


def _blocks(rows: DataFrame, dim: int, size: int, kind: int, over: int, place: Column, other: int, copies) -> DataFrame:
    """Rows packed to blocks of at most ``size``, each dealt to the rectangles of its range; a narrow pass before the exchange."""

    def pack(batches):
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            ranges = get("range").to_numpy()
            vectors, least = packed(batch, dim), get("least") if kind == 0 else None
            for r in np.unique(ranges).tolist():
                at = np.flatnonzero(ranges == r)
                for begin in range(0, len(at), size):
                    own = at[begin : begin + size]
                    bounds = np.array(least.take(pa.array(own)).flatten(), np.int64) if least is not None else np.zeros(0, np.int64)
                    arrays = [pa.array([r], pa.int32()), pa.array([kind], pa.int32()), pa.array([len(own)], pa.int32())]
                    arrays += [_binary(x) for x in (get("row").to_numpy()[own], get("vec_id").to_numpy()[own], get("label").to_numpy()[own], vectors[own], bounds)]
                    yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in BLOCKS.split(", ")])

    blocks = rows.withColumn("range", F.pmod(place, F.lit(over)).cast("int")).mapInArrow(pack, BLOCKS)
    # each block goes to every rectangle of its line of the grid
    return blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(other - 1)))).withColumn("part", copies(F.col("part"), F.col("other"))).drop("other")


def met(rows: DataFrame, anchors: DataFrame, dim: int, grid: tuple[int, int], work, schema: str) -> DataFrame:
    """Run ``work(anchor arrays, row arrays) -> ...`` in each rectangle: a task holds its anchors and reads its rows block by block."""
    across, down = grid  # ranges of rows, ranges of anchors
    place = F.xxhash64("row")
    wide = (dim + 7) // 8 * 8 or 8
    rest = _blocks(rows, dim, BLOCK, 1, across, place, down, lambda own, other: own * down + other)
    own = _blocks(anchors, dim, TABLES, 0, down, place, across, lambda own, other: other * down + own)

    def run(batches):
        held, best = [], None

        def arrays(batch, i):
            get = lambda c: np.frombuffer(batch.column(batch.schema.get_field_index(c))[i].as_buffer(), "<i8")
            n = batch.column(batch.schema.get_field_index("n"))[i].as_py()
            vectors = np.zeros((n, wide), np.int64)
            vectors[:, :dim] = get("vectors").reshape(n, dim)
            return get("rows"), get("ids"), get("labels"), vectors, get("least").reshape(n, -1) if len(get("least")) else None

        for batch in batches:
            kinds = batch.column(batch.schema.get_field_index("kind")).to_pylist()
            for i in range(batch.num_rows):
                if kinds[i] == 0:
                    held.append(arrays(batch, i))
                    continue
                best = best or [work() for _ in held]
                row = arrays(batch, i)
                for state, anchor in zip(best, held, strict=True):
                    state.meet(anchor, row)
        for state, anchor in zip(best or [], held, strict=False):
            yield from state.result(anchor)
        release()

    dealt = own.unionByName(rest).repartitionById(across * down, F.col("part")).sortWithinPartitions("kind")
    return dealt.mapInArrow(run, schema)


class Positives:
    """Of each anchor the first k other rows of its label in this rectangle."""

    SCHEMA = "row long, vec_id long, score long"

    def __init__(self, k: int):
        self.best, self.k = Best(k), k

    def meet(self, anchor, row) -> None:
        score = block_scores(anchor[3], row[3])
        fit = (row[2][:, None] == anchor[2][None, :]) & (row[1][:, None] != anchor[1][None, :])
        a, r = leaders(score, fit, self.k)
        self.best.add(a, score[r, a], row[1][r])

    def result(self, anchor):
        group, score, ids = self.best.kept
        yield pa.RecordBatch.from_arrays([pa.array(anchor[0][group]), pa.array(ids), pa.array(score)], ["row", "vec_id", "score"])


class Negatives:
    """Of each anchor and positive the first k rows of other labels within the positive's range."""

    SCHEMA = "row long, nth int, vec_id long, score long"

    def __init__(self, k: int, low: int, high: int):
        self.best, self.k, self.low, self.high = Best(k), k, low, high

    def meet(self, anchor, row) -> None:
        score = block_scores(anchor[3], row[3])
        most = anchor[4]  # [anchors, positives], the least long where there are fewer
        given = most > np.iinfo(np.int64).min
        least = least_negative(most, given, self.low, self.high)
        top = np.where(given, most, np.iinfo(np.int64).min)
        fit = (score >= least.min(axis=1)[None, :]) & (score <= top.max(axis=1)[None, :]) & (row[2][:, None] != anchor[2][None, :]) & (row[1][:, None] != anchor[1][None, :])
        r, a = np.nonzero(fit)
        found, ids = score[r, a].astype(np.int64), row[1][r]
        for j in range(most.shape[1]):
            own = np.flatnonzero((found >= least[a, j]) & (found <= top[a, j]) & given[a, j])
            if len(own):
                self.best.add(a[own] * most.shape[1] + j, found[own], ids[own])

    def result(self, anchor):
        group, score, ids = self.best.kept
        n = anchor[4].shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(anchor[0][group // n]), pa.array((group % n).astype(np.int32)), pa.array(ids), pa.array(score)], ["row", "nth", "vec_id", "score"])


def least_negative(positive: np.ndarray, given: np.ndarray, low: int, high: int) -> np.ndarray:
    """The least score s with low * positive <= high * s; the greatest long where no positive is given."""
    out = np.full(positive.shape, np.iinfo(np.int64).max)
    if given.any():
        whole = positive[given]
        if np.abs(whole.astype(np.float64)).max() * low < 2.0**62:
            out[given] = -((-low * whole) // high)
        else:
            out[given] = [-((-low * p) // high) for p in whole.tolist()]
    return out


def hard_negatives(
    embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", rows_side: int = ROWS, anchors_side: int = ANCHORS,
) -> DataFrame:
    """For each anchor (identifiers divisible by ``every``) and each of its positives the first ``negatives`` rows of other labels that score
    from low/high of the positive's score up to it: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = embeddings.sparkSession
    bound_batches(spark)
    labelled = embeddings.filter(F.col(f"`{label_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("vector"), F.col(f"`{label_col}`").cast("long").alias("label"))
    # written once, so that a row keeps its number
    rows = stored(integer_vectors(labelled, scale, "vec_id", "vector", keep=["label"]).withColumn("row", F.monotonically_increasing_id()))
    is_anchor = F.pmod("vec_id", F.lit(every)) == 0
    sizes = rows.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_anchor).alias("a")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes or not sizes[0]["a"]:
        return spark.createDataFrame([], OUT)
    dim, n, a = (int(sizes[0][c]) for c in ("dim", "n", "a"))
    rows = rows.filter(F.size("vector") == dim)
    anchors = rows.filter(is_anchor)
    down = -(-a // anchors_side)
    grid = (max(-(-n // rows_side), min(-(-SPREAD // down), -(-n // BLOCK))), down)

    none = F.array().cast("array<bigint>")
    near = met(rows, anchors.withColumn("least", none), dim, grid, lambda: Positives(positives), Positives.SCHEMA)
    best = W.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("nth", F.row_number().over(best) - 1).filter(F.col("nth") < positives)
    # at most ``positives`` rows an anchor
    by_anchor = stored(near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("near")))

    missing = F.lit(np.iinfo(np.int64).min)
    bounds = F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.try_element_at("near.score", i), missing))
    asking = anchors.join(by_anchor, "row").withColumn("least", bounds)
    hard = met(rows, asking, dim, grid, lambda: Negatives(negatives, low, high), Negatives.SCHEMA)
    best = W.partitionBy("row", "nth").orderBy(F.desc("score"), "vec_id")
    hard = hard.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    names = anchors.select("row", F.col("vec_id").alias("anchor_id")).join(by_anchor, "row")
    own = F.col("near")[F.col("nth")]
    return hard.join(names, "row").select("anchor_id", own["vec_id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), own["score"].alias("positive_score"), F.col("score").alias("negative_score"))
