import pytest
from pyspark.sql import functions as F

from lumetra.operators import flooding, images, segments
from lumetra.plans import measured, segmentation
from lumetra.sources.scratch import stored

FILE = """Version:5
Images:[module_num:1]
    Filter images?:Images only

NamesAndTypes:[module_num:2]
    Name to assign these images:Dark

ImageMath:[module_num:3]
    Operation:Invert
    Set values less than 0 equal to 0?:Yes
    Name the output image:Bright
    Select the first image:Dark

IdentifyPrimaryObjects:[module_num:4]
    Select the input image:Bright
    Name the primary objects to be identified:Nuclei
    Typical diameter of objects, in pixel units (Min,Max):4,12
    Discard objects outside the diameter range?:Yes
    Discard objects touching the border of the image?:Yes
    Method to distinguish clumped objects:Intensity
    Method to draw dividing lines between clumped objects:Intensity
    Size of smoothing filter:0
    Suppress local maxima that are closer than this minimum allowed distance:3
    Fill holes in identified objects?:After both thresholding and declumping
    Threshold strategy:Global
    Thresholding method:Otsu
    Threshold smoothing scale:0
    Two-class or three-class thresholding?:Two classes

IdentifySecondaryObjects:[module_num:5]
    Select the input objects:Nuclei
    Name the objects to be identified:Cells
    Select the method to identify the secondary objects:Distance - N
    Select the input image:Bright
    Number of pixels by which to expand the primary objects:2
    Discard secondary objects touching the border of the image?:Yes
    Discard the associated primary objects?:Yes
    Name the new primary objects:FilteredNuclei

MeasureObjectSizeShape:[module_num:6]
    Select object sets to measure:Nuclei, Cells

MeasureObjectIntensity:[module_num:7]
    Select images to measure:Dark
    Select objects to measure:Nuclei

ExportToSpreadsheet:[module_num:8]
    Add a prefix to file names?:Yes
    Filename prefix:Oil_
"""


def discs(spark):
    """Two images of dark discs: two that touch, one with a hole, one at the border, one too small, one near the border."""
    rows = []
    for image in ("a", "b"):
        for y in range(40):
            for x in range(50):
                v = 0.9
                for cy, cx, r in ((10, 10, 4), (10, 17, 4), (28, 12, 5), (20, 48, 4), (30, 30, 1), (35, 40, 3)):
                    d = ((y - cy) ** 2 + (x - cx) ** 2) ** 0.5
                    if d <= r:
                        v = min(v, 0.2 + 0.04 * d + (0.01 if image == "b" else 0))
                rows.append((image, y, x, 0.9 if (y, x) == (28, 14) else v))
    return spark.createDataFrame(rows, "image string, y long, x long, v double")


def test_a_file_runs_as_its_chain(spark, tmp_path):
    (tmp_path / "p.cppipe").write_text(FILE)
    dark, keys = discs(spark), ["image"]
    run = segmentation.run_pipeline(spark, str(tmp_path / "p.cppipe"), {"Dark": dark}, keys, str(tmp_path / "out"))
    # the chain by hand
    bright = dark.withColumn("v", F.greatest(F.lit(0.0), 1 - F.col("v")))
    level = images.otsu(images.histogram(bright, "v", keys, 256), 2, keys)
    hole = (F.col("y") == 28) & (F.col("x") == 14)
    kept = bright.join(level, keys).filter((F.col("v") >= F.col("threshold") + 1 / 256) | hole).drop("threshold")
    levels = kept.withColumn("v", F.round(F.col("v") * 1000).cast("long"))
    tops = segments.components(images.local_maxima(levels, 3, keys), keys, 8).withColumnRenamed("object_id", "seed")
    parted = flooding.declumped(levels.join(tops, [*keys, "y", "x"], "left"), keys=keys, most=1000, connectivity=8)
    sizes = {(r["image"], r["object_id"]): r for r in parted.groupBy("image", "object_id").agg(F.count("*").alias("n"), F.max("x").alias("x")).collect()}
    want = {k for k, r in sizes.items() if 4 <= (4 * r["n"] / 3.141592653589793) ** 0.5 <= 12 and r["x"] < 49}
    nuclei = {(r["image"], r["y"], r["x"]): r["object_id"] for r in run.objects["Nuclei"].collect()}
    assert nuclei == {(r["image"], r["y"], r["x"]): r["object_id"] for r in parted.collect() if (r["image"], r["object_id"]) in want}
    assert len(want) == 8 and ("a", 28, 14) in nuclei  # of six discs one is small and one at the border
    # cells grow by two; the disc near the border loses its cell, and its nucleus
    cells = run.objects["Cells"].groupBy("image").agg(F.count_distinct("object_id").alias("n")).collect()
    assert {r["image"]: r["n"] for r in cells} == {"a": 3, "b": 3}
    assert run.objects["FilteredNuclei"].select("image", "object_id").distinct().count() == 6
    table = spark.read.option("header", True).csv(str(tmp_path / "out" / "Oil_Nuclei.csv"))
    assert table.count() == 8 and {"area", "integrated_Dark", "equivalent_diameter"} <= set(table.columns)
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "Oil_Cells.csv")).count() == 6


def test_adaptive_thresholds_and_propagation(spark, tmp_path):
    text = FILE.replace("Distance - N", "Propagation").replace("    Number of pixels by which to expand the primary objects:2\n", "    Regularization factor:0.01\n    Threshold strategy:Adaptive\n    Thresholding method:Otsu\n    Two-class or three-class thresholding?:Three classes\n    Assign pixels in the middle intensity class to the foreground or the background?:Foreground\n    Size of adaptive window:20\n    Threshold correction factor:0.8\n    Lower and upper bounds on threshold:0.3,1.0\n")
    (tmp_path / "p.cppipe").write_text(text)
    run = segmentation.run_pipeline(spark, str(tmp_path / "p.cppipe"), {"Dark": discs(spark)}, ["image"])
    inside = run.objects["Nuclei"].join(run.objects["FilteredNuclei"], ["image", "y", "x", "object_id"], "left_semi")
    grown = run.objects["Cells"]
    assert inside.count() > 0 and inside.join(grown, ["image", "y", "x", "object_id"], "left_anti").count() == 0


@pytest.mark.parametrize("old,new,said", [
    ("ImageMath:", "Crop:", "no operator for module 3 Crop"), ("Select the first image:Dark", "Select the first image:Other", "asks for image 'Other'"), ("Select the input objects:Nuclei", "Select the input objects:Cells", "asks for object 'Cells'"),
    ("Name to assign these images:Dark", "Name to assign these images:Dark, Blue", "no image is given for 'Blue'"), ("Operation:Invert", "Operation:Log", "'Operation' is 'Log'"), ("Thresholding method:Otsu", "Thresholding method:Robust", "only Otsu"),
])
def test_what_cannot_run_is_named(spark, tmp_path, old, new, said):
    (tmp_path / "p.cppipe").write_text(FILE.replace(old, new))
    with pytest.raises(segmentation.PipelineError, match=said):
        segmentation.run_pipeline(spark, str(tmp_path / "p.cppipe"), {"Dark": discs(spark).limit(1)}, ["image"])


def test_pixels_and_objects_are_not_broadcast(spark, tmp_path):
    """A file of pixels is a small part of its rows: a table that is broadcast for its file's size would not fit the driver."""
    (tmp_path / "p.cppipe").write_text(FILE.replace(":4,12", ":2,12"))
    y, x = F.col("id") % 25600 / 160, F.col("id") % 160
    at = spark.range(51200).select(F.concat((F.col("id") >= 25600).cast("string"), F.lit("n" * 1000)).alias("image"), y.cast("long").alias("y"), x.alias("x"))
    dark = at.withColumn("v", F.when((F.col("y") % 4).isin(1, 2) & (F.col("x") % 4).isin(1, 2), 0.2).otherwise(0.9))
    # 51 MB of pixels, 3 MB of objects, 5 MB of tiles; what is seen at run time to be small may be broadcast
    limits = {"spark.sql.maxBroadcastTableSize": "3m", "spark.sql.adaptive.autoBroadcastJoinThreshold": "1m"}
    for key, value in limits.items():
        spark.conf.set(key, value)
    try:
        run = segmentation.run_pipeline(spark, str(tmp_path / "p.cppipe"), {"Dark": stored(dark)}, ["image"])
        rows = measured.measured(run.exports["Oil_Nuclei"], ["image"]).groupBy("ImageNumber", "AreaShape_Area").agg(F.count(F.lit(1)).alias("n"), F.max("ObjectNumber").alias("most")).collect()
        assert sorted(map(tuple, rows)) == [(1, 4, 1600, 1600), (2, 4, 1600, 1600)]
        cells, kept = (run.objects[name].groupBy("image").agg(F.count_distinct("object_id").alias("n")).collect() for name in ("Cells", "FilteredNuclei"))
        assert [r["n"] for r in cells] == [r["n"] for r in kept] == [38 * 38] * 2  # those around touch the border
    finally:
        for key in limits:
            spark.conf.unset(key)
