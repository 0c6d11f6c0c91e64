import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumetra.functions import optics
from lumetra.operators import density, images, ranking, regions


def od(pixel, level):
    pixel = max(pixel, 1.0)
    return 0.0 if pixel >= level else math.log10(level / pixel)


@pytest.mark.parametrize("pixel,level,want", [(0.0, 100.0, 2.0), (1.0, 100.0, 2.0), (100.0, 100.0, 0.0), (101.0, 100.0, 0.0), (50.0, 0.5, 0.0), (10.0, 100.0, 1.0)])
def test_optical_density(spark, pixel, level, want):
    assert spark.range(1).select(optics.optical_density(F.lit(pixel), F.lit(level))).first()[0] == pytest.approx(want)


def test_whole_numbers_cut_towards_zero(spark):
    row = spark.range(1).select(optics.whole(F.lit(-3.7)), optics.whole(F.lit(3.99)), optics.whole(F.lit(float("nan"))), optics.circle_radius(F.lit(1.0)), optics.circle_radius(F.lit(-1.0)), optics.circle_radius(F.lit(30.0))).first()
    assert list(row) == [-3, 3, None, 0, None, 3]


def test_background_is_interpolated(spark):
    values = [random.Random(1).randrange(256) for _ in range(500)]
    got = density.background(spark.createDataFrame([(float(v),) for v in values], "v double"), "v").first()[0]
    ordered, at = sorted(values), 0.95 * 499
    low = int(at)
    assert got == pytest.approx(ordered[low] + (ordered[low + 1] - ordered[low]) * (at - low))


@pytest.mark.parametrize("n,percent,kept", [(10, 40.0, 10), (11, 5.0, 11), (20, 5.0, 18), (20, 50.0, 0), (40, 5.0, 36), (20, 0.0, 20)])
def test_trimming(spark, n, percent, kept):
    objects = spark.createDataFrame([(float(i // 2), i) for i in range(n)], "True_IOD double, k int")
    out = density.trimmed(objects, ["True_IOD", "k"], percent=percent).orderBy("True_IOD", "k").collect()
    assert [r["rank"] for r in out] == list(range(1, n + 1))
    assert sum(r["QC_Passed"] == "Yes" for r in out) == kept
    grouped = density.trimmed(objects.withColumn("g", F.lit(1)), ["True_IOD", "k"], ["g"], percent)
    assert grouped.filter("QC_Passed = 'Yes'").count() == kept


def test_flag_by_number_spreads_over_images(spark):
    rows = spark.createDataFrame([(1, "7", "Yes"), (2, "7", "No"), (2, "8", "No")], "image int, number string, QC_Passed string")
    assert sorted(r["QC_Passed"] for r in density.flag_by_number(rows, "number").collect()) == ["No", "Yes", "Yes"]
    assert density.flag_by_number(rows, "number", compat=False).filter("QC_Passed = 'Yes'").count() == 1


def test_variation_is_zero_without_a_positive_mean(spark):
    rows = spark.createDataFrame([(0.0, "Yes"), (0.0, "Yes"), (5.0, "No")], "True_IOD double, QC_Passed string")
    got = density.summary(rows).first()
    assert (got["n"], got["mean"], got["cv"]) == (2, 0.0, 0.0)
    assert density.summary(rows.filter("False")).first()["n"] == 0


def test_circles_equal_a_mask(spark):
    rng = random.Random(4)
    h, w = 23, 31
    image = {(y, x): float(rng.randrange(256)) for y in range(h) for x in range(w)}
    circles = [(i, rng.uniform(-5, w + 5), rng.uniform(-5, h + 5), rng.choice([1.0, 2.9, 3.2, 30.0, 200.0])) for i in range(40)] + [(99, 500.0, 500.0, 30.0), (100, float("nan"), 1.0, 9.0)]
    pixels = spark.createDataFrame([(y, x, v) for (y, x), v in image.items()], "y int, x int, v double")
    table = spark.createDataFrame(circles, "id int, cx double, cy double, area double")
    sums = regions.region_pixels(table, pixels, "id", "cx", "cy", "area").groupBy("object_id").agg(F.sum("v").alias("total"), F.count("v").alias("n"))
    got = {r["object_id"]: (r["total"], r["n"]) for r in regions.with_empty_regions(sums, table, "id", ["total", "n"]).collect()}
    for i, cx, cy, area in circles:
        inside = [] if math.isnan(cx) else [v for (y, x), v in image.items() if (x - int(cx)) ** 2 + (y - int(cy)) ** 2 <= int(math.sqrt(area / math.pi)) ** 2]
        assert got[i] == (sum(inside), len(inside))


def test_standards(spark):
    assert optics.STANDARDS == {"chicken": 1.25, "trout": 2.60}
    assert spark.range(1).select(optics.genome_size(F.lit(20.0), F.lit(10.0), F.lit(1.25))).first()[0] == 2.5


def test_percentiles_by_key_are_exact(spark):
    rng = random.Random(8)
    rows = [(k, float(rng.randrange(40)) / 3 if k != "one" else 2.5) for k in [*"aaabb", *["c"] * 300, "one", None, None]] + [("a", None), ("empty", None)]
    got = {r["k"]: (r["p"], r["m"]) for r in ranking.percentiles(spark.createDataFrame(rows, "k string, v double"), "v", ["k"], {"p": 95.0, "m": 50.0}).collect()}
    want = {}
    for k in {k for k, v in rows if v is not None}:
        held = [v for key, v in rows if key == k and v is not None]
        want[k] = tuple(np.percentile(held, q) for q in (95, 50))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert ranking.percentiles(spark.createDataFrame([], "k string, v double"), "v", ["k"], {"p": 5.0}).count() == 0
    whole = ranking.percentiles(spark.createDataFrame(rows, "k string, v double"), "v", [], {"p": 95.0}).first()["p"]
    assert whole == pytest.approx(np.percentile([v for _, v in rows if v is not None], 95))


@pytest.mark.parametrize("n", [3, 4, 9, 60])
def test_cuts_equal_all_pairs(n):
    rng = np.random.default_rng(n)
    for _ in range(40):
        level = np.sort(rng.choice(1000, n, replace=False)).astype(float)
        count = rng.integers(1, 50, n)
        w, m = np.cumsum(count), np.cumsum(count * level)
        pairs = [(round(m[i] ** 2 / w[i] + (m[j] - m[i]) ** 2 / (w[j] - w[i]) + (m[-1] - m[j]) ** 2 / (w[-1] - w[j]), 6), -level[i], -level[j]) for j in range(1, n - 1) for i in range(j)]
        best = max(pairs)
        assert images.best_cuts(level, count) == (-best[1], -best[2])


def test_a_surface_is_level_outside_the_middles(spark):
    px = spark.createDataFrame([(i, y, x) for i in range(2) for y in range(10) for x in range(7)], "image int, y int, x int")
    marks = spark.createDataFrame([(i, r, c, float(10 * r + c + i), 1.0) for i in range(2) for r in range(3) for c in range(2)], "image int, row long, column long, low double, high double")
    got = {(r["image"], r["y"], r["x"]): r["low"] for r in images.threshold_surface(px, marks, 4, ["image"]).collect()}
    ys, xs = [1.5, 5.5, 8.5], [1.5, 5.0]  # middles; the last windows have two lines and three columns
    for (i, y, x), low in got.items():
        assert low == pytest.approx(np.interp(y, ys, [0, 10, 20]) + np.interp(x, xs, [0, 1]) + i)
    assert len(got) == 140


def test_exploded_cells_are_not_broadcast(spark):
    circles = spark.range(50).selectExpr("id as k", "double(id % 9) as cx", "double(id % 7) as cy", "double(40) as area")
    pixels = spark.range(100).selectExpr("id div 10 as y", "id % 10 as x", "1.0 as v")
    met = regions.region_pixels(circles, pixels, "k", "cx", "cy", "area")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    held = {(r["y"], r["x"]) for r in met.filter("object_id = 0").collect()}
    assert held == {(y, x) for y in range(4) for x in range(4) if x * x + y * y <= 9}


def test_pixels_are_dealt_to_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(density, "DEALT_ROWS", 100)
    rows = spark.range(5000).selectExpr("id % 400 as image", "id as object")
    levels = rows.groupBy("image").agg(F.lit(1.0).alias("background")).hint("merge")
    held, by_image = density.dealt(rows, levels, ["image"])
    sizes = held.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.count_distinct("image").alias("k")).collect()
    assert held.rdd.getNumPartitions() == 50 and max(r["n"] for r in sizes) < 400
    assert sum(r["k"] for r in sizes) == 400 and sum(r["n"] for r in sizes) == 5000
    assert density.dealt(rows.limit(400), levels, ["image"])[0].rdd.getNumPartitions() < 50
    # what follows by image keeps the tasks
    joined = density.with_background(held, by_image, ["image"])
    assert joined.rdd.getNumPartitions() == 50 and joined.count() == 5000
