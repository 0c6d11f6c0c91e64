import heapq
import random

import pytest
from pyspark.sql import functions as F

from lumetra.operators import flooding, segments

SIDES = flooding.SIDES


def flood_fill(cells, connectivity):
    """{pixel: name of its object} by plain search."""
    out = {}
    for start in sorted(cells):
        if start in out:
            continue
        out[start], todo = start, [start]
        while todo:
            y, x = todo.pop()
            for dy, dx in SIDES[connectivity]:
                if (q := (y + dy, x + dx)) in cells and q not in out:
                    out[q] = start
                    todo.append(q)
    return {p: s[0] << 32 | s[1] for p, s in out.items()}


def dijkstra(values, seeds, kind, base, weight, limit, connectivity):
    """Costs by a queue, then owners by rising cost: least owner among the neighbours that give a pixel its cost."""
    cost = {p: (0,) if kind == "distance" else (values[p], 0) for p in seeds}
    queue = [(c, p) for p, c in cost.items()]
    heapq.heapify(queue)

    def on(c, p, q):
        if kind == "distance":
            return (c[0] + base + weight * abs(values[q] - values[p]),)
        return (values[q], 1) if values[q] > c[0] else (c[0], c[1] + 1)

    while queue:
        c, p = heapq.heappop(queue)
        if c > cost[p]:
            continue
        for dy, dx in SIDES[connectivity]:
            q = (p[0] + dy, p[1] + dx)
            if q in values and q not in seeds and (limit is None or on(c, p, q)[0] <= limit) and on(c, p, q) < cost.get(q, (2**62, 0)):
                cost[q] = on(c, p, q)
                heapq.heappush(queue, (cost[q], q))
    owner = dict(seeds)
    for c, q in sorted((c, q) for q, c in cost.items() if q not in seeds):
        near = [(q[0] + dy, q[1] + dx) for dy, dx in SIDES[connectivity]]
        owner[q] = min(owner[p] for p in near if p in cost and p in owner and on(cost[p], p, q) == c)
    return cost, owner


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("tile", [5, 64])
def test_components_equal_flood_fill(spark, connectivity, tile):
    rng = random.Random(connectivity)
    images = {i: {(y, x) for y in range(23) for x in range(31) if rng.random() < (0.55 if i != 2 else 0.4)} for i in range(3)}
    images[3] = {(y, x) for y in range(20) for x in range(20) if y % 4 == 0 or x == (0 if y // 4 % 2 else 19)}  # one winding object
    images[None] = {(0, 0), (100, 7), (7, 100)}
    rows = [(i, "b", y, x) for i, cells in images.items() for y, x in cells]
    df = spark.createDataFrame(rows + rows[:5], "image long, plate string, y int, x int").withColumn("key", F.lit(1)).withColumn("label", F.lit(2))
    got = {(r["image"], (r["y"], r["x"])): r["object_id"] for r in segments.components(df, ["image", "plate"], connectivity, tile).collect()}
    assert got == {(i, p): o for i, cells in images.items() for p, o in flood_fill(cells, connectivity).items()}
    assert segments.components(df.filter("false")).count() == 0
    assert segments.components(df.filter("image = 3").select("y", "x"), tile=tile).select("object_id").distinct().count() == 1


@pytest.mark.parametrize("kind,weight,limit", [("distance", 0, None), ("distance", 3, 40), ("flood", 0, None), ("flood", 0, 6)])
@pytest.mark.parametrize("connectivity,tile", [(4, 6), (8, 6), (4, 128)])
def test_growth_equals_dijkstra(spark, kind, weight, limit, connectivity, tile):
    rng = random.Random(weight * 10 + connectivity)
    rows, want = [], {}
    for image in range(2):
        values = {(y, x): rng.randrange(9) for y in range(22) for x in range(27) if rng.random() < 0.85}
        places = rng.sample(sorted(values), 7)
        seeds = {p: 100 - i // 2 for i, p in enumerate(places)}
        rows += [(image, y, x, v, seeds.get((y, x))) for (y, x), v in values.items()]
        cost, owner = dijkstra(values, seeds, kind, 2 if kind == "distance" else 1, weight, limit, connectivity)
        want |= {(image, p): (owner[p], *cost[p]) for p in cost}
    df = spark.createDataFrame(rows, "image long, y int, x int, v int, seed long")
    got = flooding.grown(df, keys=["image"], kind=kind, base=2 if kind == "distance" else 1, weight=weight, limit=limit, connectivity=connectivity, tile=tile)
    costs = ["cost"] if kind == "distance" else ["level", "steps"]
    assert {(r["image"], (r["y"], r["x"])): (r["object_id"], *[r[c] for c in costs]) for r in got.collect()} == want


def test_touching_objects_part_at_the_dim_line(spark):
    line = [9, 8, 7, 3, 6, 8, 9, 5]
    df = spark.createDataFrame([(y, x, v, {0: 1, 6: 2}.get(x) if y == 1 else None) for y in range(3) for x, v in enumerate(line)], "y int, x int, v int, seed int")
    got = {(r["y"], r["x"]): r["object_id"] for r in flooding.declumped(df, most=9, tile=3).collect()}
    assert {x: got[1, x] for x in range(8)} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 2, 7: 2}
    assert flooding.secondary_objects(df.filter("false")).count() == 0
    assert flooding.secondary_objects(df.withColumn("seed", F.lit(None).cast("int"))).count() == 0
    with pytest.raises(ValueError):
        flooding.grown(df, base=0)


def test_rounds_write_only_tiles_that_were_sent_something(spark, monkeypatch):
    # a corridor that winds through 30 tiles, and 40 tiles of another image that no seed reaches
    corridor = [(y, x) for y in range(0, 12, 4) for x in range(20)] + [(y, 19 if y // 4 % 2 == 0 else 0) for y in range(12) if y % 4]
    values = {p: (p[0] * 7 + p[1] * 3) % 5 for p in corridor}
    rows = [("a", y, x, v, 1 if (y, x) == (0, 0) else None) for (y, x), v in values.items()] + [("b", y, x, 1, None) for y in range(0, 20, 4) for x in range(0, 32, 4)]
    df = spark.createDataFrame(rows, "image string, y int, x int, v int, seed long")
    written = []

    def counted(table):
        out = stored(table)
        written.append(out.count())
        return out

    stored = flooding.stored
    monkeypatch.setattr(flooding, "stored", counted)
    monkeypatch.setattr(flooding, "COMPACT", 5)
    got = {(r["y"], r["x"]): (r["object_id"], r["cost"]) for r in flooding.grown(df, keys=["image"], weight=2, tile=4).collect()}
    cost, owner = dijkstra(values, {(0, 0): 1}, "distance", 1, 2, None, 4)
    assert got == {p: (owner[p], *c) for p, c in cost.items()}
    whole = written[0]
    few = [n for n in written if n < whole]
    assert whole > 40 and len(written) > 25 and len(few) > 0.7 * len(written) and max(few) <= 4
