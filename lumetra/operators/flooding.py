"""Objects that grow from seeds over an image: declumping and secondary objects.

Every pixel that can be reached gets a cost and an owner. Two kinds of cost:

* *flood*: (level, steps). The level is the greatest value on the way, the
  pixel's own included, from a seed's own value on; steps count from where the
  level was last raised. Seeds in a picture turned upside down are peaks, and
  their basins the declumped objects (a seeded watershed).
* *distance*: whole numbers. A step costs ``base`` (at least 1) and ``weight``
  times the difference of the two values, so edges are far apart (secondary
  objects that stop at a ``limit``).

A pixel's cost is the least over its neighbours' costs, each one step on; its
owner is the least owner among the neighbours that give it that cost. Costs
rise along every way, so this names one owner for every pixel, whatever the
tiles or the order.

Tiles relax on their own; those that changed send the rim that a neighbour
sees, and rounds go on until nothing changes: first costs, then owners. A round
works on tiles that have been sent something, and writes these alone: a tile's
state is its version of the latest round. Every ``COMPACT`` rounds the versions
become one table again. What a task holds is one tile.

Defined cases: pixels named by whole y and x from 0, once each (of repeated ones
the least value and least seed count); a pixel that is not in the table is a
wall; values are whole numbers from 0 to 2^31 - 1 for floods; a pixel that no
seed reaches, or only beyond the limit, has no row; a seed keeps its own pixel;
an empty table, or one without seeds, gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .segments import packed_key, unpacked_key

TILE = 128
#: Rounds after which versions of tiles are put together.
COMPACT = 8
FAR = np.iinfo(np.int64).max
SIDES = {4: [(0, -1), (0, 1), (-1, 0), (1, 0)], 8: [(0, -1), (0, 1), (-1, 0), (1, 0), (-1, -1), (-1, 1), (1, -1), (1, 1)]}

#: A tile: its values, costs and owners with a rim of its neighbours', as whole numbers end to end.
STATE = "key string, ty long, tx long, body binary, changed boolean"
SENT = "key string, ty long, tx long, dy int, dx int, rim binary"
VALUE, OPEN, SEED, COST, OWNER = range(5)


def step(kind: str, cost: np.ndarray, before: np.ndarray, value: np.ndarray, base: int, weight: int) -> np.ndarray:
    """The cost one step on from neighbours of ``cost`` and value ``before``."""
    if kind == "distance":
        on = cost + (base + weight * np.abs(value - before))
    else:
        on = np.where(value > cost >> 32, value << 32 | 1, cost + 1)
    return np.where(cost == FAR, FAR, on)


def seen(body: np.ndarray, layer: int, dy: int, dx: int) -> np.ndarray:
    """A layer of the tile as the inner pixels see it in one direction."""
    h, w = body.shape[1:]
    return body[layer, 1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx]


def relaxed(body: np.ndarray, phase: int, kind: str, base: int, weight: int, limit: int, sides) -> bool:
    """Bring the inner pixels to rest; whether anything changed."""
    inner = body[:, 1:-1, 1:-1]
    free = (inner[OPEN] == 1) & (inner[SEED] == FAR)
    changed = False
    while True:
        layer = COST if phase == 0 else OWNER
        best = inner[layer].copy()
        for dy, dx in sides:
            on = step(kind, seen(body, COST, dy, dx), seen(body, VALUE, dy, dx), inner[VALUE], base, weight)
            on = np.where(on > limit, FAR, on)
            offer = on if phase == 0 else np.where((on == inner[COST]) & (on != FAR), seen(body, OWNER, dy, dx), FAR)
            best = np.where(free, np.minimum(best, offer), best)
        if (best == inner[layer]).all():
            return changed
        inner[layer] = best
        changed = True


def newest(versions: DataFrame) -> DataFrame:
    """Each tile's version of the latest round."""
    latest = W.partitionBy("key", "ty", "tx").orderBy(F.desc("round"))
    return versions.withColumn("_nth", F.row_number().over(latest)).filter("_nth = 1").drop("_nth")


def strip(n: int, d: int, whole: int) -> slice:
    """The part of an axis that a neighbour on side d sees: its rim on that side, or all of it."""
    return slice(1, 1 + whole) if d == 0 else slice(1, 2) if d < 0 else slice(n - 2, n - 1)


def grown(pixels: DataFrame, value: str = "v", seed: str = "seed", keys: list[str] = (), kind: str = "distance", base: int = 1, weight: int = 0, limit: int | None = None, connectivity: int = 4, tile: int = TILE) -> DataFrame:
    """keys, y, x, object_id and cost (``distance``) or level and steps (``flood``) of every pixel that a seed reaches.

    ``seed`` names the object that begins on a pixel, null elsewhere.
    """
    if kind not in ("distance", "flood") or base < 1 or weight < 0:
        raise ValueError("kind is distance or flood, base at least 1, weight at least 0")
    keys, sides, bound = list(keys), SIDES[connectivity], FAR - 1 if limit is None else limit if kind == "distance" else limit << 32 | 0xFFFFFFFF
    edge = tile + 2
    held = pixels.select(packed_key(pixels, keys).alias("key"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col(value).cast("long").alias("v"), F.col(seed).cast("long").alias("s"))
    names = [c.split()[0] for c in STATE.split(", ")]

    def row(key, ty, tx, body: np.ndarray, changed: bool) -> pa.Table:
        arrays = [pa.array([key], pa.string()), pa.array([ty], pa.int64()), pa.array([tx], pa.int64()), pa.array([body.tobytes()], pa.binary()), pa.array([changed])]
        return pa.RecordBatch.from_arrays(arrays, names)

    def build(group: pa.Table) -> pa.Table:
        body = np.full((5, edge, edge), FAR, np.int64)
        body[OPEN] = 0
        ty, tx = group["ty"][0].as_py(), group["tx"][0].as_py()
        y, x = group["y"].to_numpy() - ty * tile + 1, group["x"].to_numpy() - tx * tile + 1
        body[OPEN, y, x] = 1
        np.minimum.at(body[VALUE], (y, x), group["v"].to_numpy())
        seeds = group["s"].is_valid().to_numpy()
        np.minimum.at(body[SEED], (y[seeds], x[seeds]), group["s"].drop_null().to_numpy())
        at = body[SEED] != FAR
        body[COST][at] = 0 if kind == "distance" else body[VALUE][at] << 32
        body[OWNER][at] = body[SEED][at]
        body[VALUE][body[OPEN] == 0] = 0
        relaxed(body, 0, kind, base, weight, bound, sides)
        return pa.Table.from_batches([row(group["key"][0].as_py(), ty, tx, body, bool((body[COST] != FAR).any()))])

    def body_of(data) -> np.ndarray:
        return np.frombuffer(data.as_buffer(), np.int64).reshape(5, edge, edge)

    def send(batches):
        for batch in batches:
            for key, ty, tx, data in zip(*(batch.column(i) for i in range(4)), strict=True):
                body, out = body_of(data), []
                for dy, dx in sides:  # to the tile on this side
                    out.append((key.as_py(), ty.as_py() + dy, tx.as_py() + dx, dy, dx, body[[VALUE, COST, OWNER], strip(edge, dy, tile), strip(edge, dx, tile)].tobytes()))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in SENT.split(", ")])

    def update(phase: int):
        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    key, ty, tx = (batch.column(c)[i].as_py() for c in range(3))
                    body = body_of(batch.column(3)[i]).copy()
                    for m in batch.column(4)[i].as_py() or []:
                        # what lies on side (-dy, -dx) of this tile
                        ys, xs = (slice(1, 1 + tile) if d == 0 else slice(edge - 1, edge) if d < 0 else slice(0, 1) for d in (m["dy"], m["dx"]))
                        h, w = (tile if d == 0 else 1 for d in (m["dy"], m["dx"]))
                        body[[VALUE, COST, OWNER], ys, xs] = np.frombuffer(m["rim"], np.int64).reshape(3, h, w)
                    yield row(key, ty, tx, body, relaxed(body, phase, kind, base, weight, bound, sides))

        return run

    state = held.withColumn("ty", F.floor(F.col("y") / tile)).withColumn("tx", F.floor(F.col("x") / tile)).groupBy("key", "ty", "tx").applyInArrow(build, STATE)
    tile_of = ["key", "ty", "tx"]
    moved = stored(state)
    versions, n = moved.withColumn("round", F.lit(0)), 0
    for phase in (0, 1):
        if phase:  # owners: all tiles once, then those that are sent something
            alone = newest(versions).select(*tile_of, "body", F.lit(None).cast("array<struct<dy:int,dx:int,rim:binary>>").alias("inbox"))
            moved = stored(alone.mapInArrow(update(1), STATE))
            versions, n = moved.withColumn("round", F.lit(0)), 0
        while not (moved := moved.filter("changed")).isEmpty():
            n += 1
            # a tile is sent at most one rim from each side
            inbox = moved.mapInArrow(send, SENT).groupBy(*tile_of).agg(F.collect_list(F.struct("dy", "dx", "rim")).alias("inbox"))
            met = newest(versions.hint("merge").join(inbox, tile_of)).select(*tile_of, "body", "inbox")
            moved = stored(met.mapInArrow(update(phase), STATE))
            versions = versions.unionByName(moved.withColumn("round", F.lit(n)))
            if n % COMPACT == 0:
                versions = stored(newest(versions))
    state = newest(versions).select(*names)

    def pixels_of(batches):
        for batch in batches:
            for key, ty, tx, data in zip(*(batch.column(i) for i in range(4)), strict=True):
                inner = body_of(data)[:, 1:-1, 1:-1]
                y, x = np.nonzero((inner[COST] != FAR) & (inner[OPEN] == 1))
                if len(y):
                    arrays = [pa.array([key.as_py()] * len(y), pa.string()), pa.array(y + ty.as_py() * tile), pa.array(x + tx.as_py() * tile), pa.array(inner[OWNER, y, x]), pa.array(inner[COST, y, x])]
                    yield pa.RecordBatch.from_arrays(arrays, ["key", "y", "x", "object_id", "cost"])

    found = state.mapInArrow(pixels_of, "key string, y long, x long, object_id long, cost long")
    cost = [F.col("cost")] if kind == "distance" else [F.shiftright("cost", 32).alias("level"), F.col("cost").bitwiseAND(0xFFFFFFFF).alias("steps")]
    return found.select(*unpacked_key(pixels, keys), "y", "x", "object_id", *cost)


def declumped(pixels: DataFrame, value: str = "v", seed: str = "seed", keys: list[str] = (), most: int = 255, connectivity: int = 4, tile: int = TILE) -> DataFrame:
    """keys, y, x, object_id of a foreground's pixels: the basin of each seed in the picture turned upside down, so that touching objects part at the dim line between them."""
    upside = pixels.withColumn(value, F.lit(most) - F.col(value))
    return grown(upside, value, seed, keys, "flood", connectivity=connectivity, tile=tile).select(*keys, "y", "x", "object_id")


def secondary_objects(pixels: DataFrame, value: str = "v", seed: str = "seed", keys: list[str] = (), base: int = 1, weight: int = 1, limit: int | None = None, connectivity: int = 4, tile: int = TILE) -> DataFrame:
    """keys, y, x, object_id, cost: each primary object (its pixels are seeds) with the pixels that are nearer to it than to any other, steps over edges of intensity being longer."""
    return grown(pixels, value, seed, keys, "distance", base, weight, limit, connectivity, tile)
