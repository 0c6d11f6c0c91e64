import numpy as np
import pytest
from pyspark.sql import functions as F

from lumetra import cli
from lumetra.plans import measured
from lumetra.sources import files, tiles
from lumetra.sources.tiff import write_tiled

FILE = """Version:5
NamesAndTypes:[module_num:1]
    Name to assign these images:Dark

ImageMath:[module_num:2]
    Operation:Invert
    Name the output image:Bright
    Select the first image:Dark

IdentifyPrimaryObjects:[module_num:3]
    Select the input image:Bright
    Name the primary objects to be identified:Nuclei
    Typical diameter of objects, in pixel units (Min,Max):4,20
    Discard objects outside the diameter range?:Yes
    Method to distinguish clumped objects:None
    Threshold strategy:Global
    Thresholding method:Otsu
    Two-class or three-class thresholding?:Two classes

MeasureObjectSizeShape:[module_num:4]
    Select object sets to measure:Nuclei

MeasureObjectIntensity:[module_num:5]
    Select images to measure:Dark
    Select objects to measure:Nuclei

ExportToSpreadsheet:[module_num:6]
    Add a prefix to file names?:No
"""
#: Centres, radius and brightness of dark discs by image.
DISCS = {"a": [(10, 12, 4, 60), (30, 40, 5, 80)], "b": [(20, 25, 6, 100)], "empty": []}


def drawn(name, most, dtype):
    y, x = np.mgrid[0:50, 0:60]
    image = np.full((50, 60), 0.9 * most).astype(dtype)
    if name == "empty":
        image[0, 0] = 0.5 * most  # two levels, and no disc
    for cy, cx, r, v in DISCS[name]:
        image[(y - cy) ** 2 + (x - cx) ** 2 <= r * r] = v * (most // 255)
    return np.repeat(image[:, :, None], 3, axis=2)


@pytest.fixture
def folder(tmp_path):
    made = tmp_path / "images"
    made.mkdir()
    for name, dtype in (("a", np.uint8), ("b", np.uint16), ("empty", np.uint8)):
        image = drawn(name, np.iinfo(dtype).max, dtype)
        with open(made / f"{name}.tif", "wb") as f:
            write_tiled(f, lambda p, q, image=image: image[p:q], 50, 60, dtype, "<OME/>", 16, samples=3)
    (tmp_path / "p.cppipe").write_text(FILE)
    return made


def test_from_images_to_densities(spark, folder, tmp_path, capsys):
    out = tmp_path / "out"
    assert cli.main(["segment", str(tmp_path / "p.cppipe"), str(folder), str(out)]) == 0
    held = spark.read.option("header", True).csv(str(out / "Nuclei.csv"))
    assert held.columns[:3] == ["image_id", "ImageNumber", "ObjectNumber"] and {"AreaShape_Area", "AreaShape_Center_X", "Intensity_IntegratedIntensity_Dark"} <= set(held.columns)
    got = {(r["image_id"].rsplit("/", 1)[1], int(r["ImageNumber"]), int(r["ObjectNumber"])): r for r in held.collect()}
    assert sorted(got) == [("a.tif", 1, 1), ("a.tif", 1, 2), ("b.tif", 2, 1)]
    assert (float(got["a.tif", 1, 2]["AreaShape_Center_X"]), float(got["b.tif", 2, 1]["AreaShape_Center_Y"])) == (40.0, 20.0)
    area = sum(1 for y in range(-4, 5) for x in range(-4, 5) if y * y + x * x <= 16)
    assert int(got["a.tif", 1, 1]["AreaShape_Area"]) == area and float(got["a.tif", 1, 1]["Intensity_IntegratedIntensity_Dark"]) == pytest.approx(area * 60 / 255, abs=1e-4)

    told = str(tmp_path / "densities.csv")
    assert cli.main(["iod", str(folder), str(out / "Nuclei.csv"), told, "--image-column", "image_id"]) == 0
    rows = {(r["image_id"].rsplit("/", 1)[1], r["ObjectNumber"]): r for r in spark.read.option("header", True).csv(told).collect()}
    assert sorted(rows) == [("a.tif", "1"), ("a.tif", "2"), ("b.tif", "1")] and all(r["QC_Passed"] == "Yes" for r in rows.values())
    for (image, number), r in rows.items():
        _, _, radius, v = DISCS[image[0]][int(number) - 1]
        most = 255 if image == "a.tif" else 65535
        # a whole radius out of the area: the circle lies inside its disc
        assert int((float(r["Area_pixels"]) / np.pi) ** 0.5) in (radius - 1, radius) and float(r["Background_I0"]) == int(0.9 * most)
        assert float(r["Mean_OD"]) == pytest.approx(np.log10(int(0.9 * most) / (v * (most // 255))), abs=1e-5)
    # a file name will do as well; an image that is not there stops the run
    lines = (out / "Nuclei.csv").read_text().replace(f"{folder}/", "")
    (tmp_path / "n.csv").write_text(lines)
    assert cli.main(["iod", str(folder), str(tmp_path / "n.csv"), told, "--image-column", "image_id"]) == 0
    (tmp_path / "n.csv").write_text(lines.replace("b.tif", "c.tif"))
    assert cli.main(["iod", str(folder), str(tmp_path / "n.csv"), told, "--image-column", "image_id"]) == 2
    assert "1 objects of images that are not in" in capsys.readouterr().err
    with pytest.raises(ValueError, match="columns missing"):
        files.nuclei(spark, str(tmp_path / "n.csv"), keep=["FileName"])


def test_segment_refuses_what_it_cannot_run(folder, tmp_path, capsys):
    (tmp_path / "q.cppipe").write_text(FILE.replace("ImageMath:", "Crop:"))
    assert cli.main(["segment", str(tmp_path / "q.cppipe"), str(folder), str(tmp_path / "o")]) == 2
    (tmp_path / "q.cppipe").write_text(FILE.replace("images:Dark", "images:Dark, Blue"))
    assert cli.main(["segment", str(tmp_path / "q.cppipe"), str(folder), str(tmp_path / "o")]) == 2
    said = capsys.readouterr().err
    assert "no operator for module 2 Crop" in said and "names 2 images" in said and not (tmp_path / "o").exists()


def test_objects_are_placed_and_numbered(spark):
    images = spark.createDataFrame([("/x/a.tif",), ("/x/b.tif",), ("/y/b.tif",)], "path string")
    nuclei = spark.createDataFrame([(1, "a.tif"), (2, "/y/b.tif"), (3, "b.tif"), (4, None), (5, "z")], "object_id long, name string")
    got = {r["object_id"]: r["image_id"] for r in measured.placed(nuclei, "name", images).collect()}
    assert got == {1: "/x/a.tif", 2: "/y/b.tif", 3: None, 4: None, 5: None}  # two images are named b.tif
    table = spark.createDataFrame([("q", 9, 5, 0.5), ("p", 7, 4, 0.1), ("q", 3, 6, 0.2), (None, 1, 1, 0.3)], "plate string, object_id long, area long, mean_Dark_1 double").withColumn("_own", F.lit(1))
    rows = {(r["plate"], r["ImageNumber"], r["ObjectNumber"], r["AreaShape_Area"], r["Intensity_MeanIntensity_Dark_1"], r["_own"]) for r in measured.measured(table, ["plate"]).collect()}
    assert rows == {(None, 1, 1, 1, 0.3, 1), ("p", 2, 1, 4, 0.1, 1), ("q", 3, 1, 6, 0.2, 1), ("q", 3, 2, 5, 0.5, 1)}
    alone = measured.measured(table.drop("plate")).collect()
    assert sorted((r["ImageNumber"], r["ObjectNumber"], r["AreaShape_Area"]) for r in alone) == [(1, 1, 1), (1, 2, 6), (1, 3, 4), (1, 4, 5)]
    assert measured.measured(table.filter("false"), ["plate"]).count() == 0
    tile = "image_id string, y0 int, x0 int, w int, dtype string, data array<int>"
    px = measured.image_pixels(spark.createDataFrame([("i", 2, 4, 2, "uint16", [0, 65535, 13107])], tile))
    assert sorted((r["y"], r["x"], r["v"]) for r in px.collect()) == [(2, 4, 0.0), (2, 5, 1.0), (3, 4, 0.2)]
    with pytest.raises(Exception, match="no scale for pixels of float32"):
        measured.image_pixels(spark.createDataFrame([("i", 0, 0, 1, "float32", [1])], tile)).collect()


def test_grey_images_are_taken_as_they_are(spark, tmp_path):
    """What extraction writes has one channel: density and objects come from it without naming it."""
    made = tmp_path / "images"
    made.mkdir()
    image = drawn("a", 255, np.uint8)
    for name, held in (("grey", image[:, :, :1]), ("colour", np.dstack([image[:, :, 0] // 2, image[:, :, 0], image[:, :, 0] // 3]))):
        with open(made / f"{name}.tif", "wb") as f:
            write_tiled(f, lambda p, q, held=held: held[p:q], 50, 60, np.uint8, "<OME/>", 16, samples=held.shape[2])
    (tmp_path / "n.csv").write_text("ObjectNumber,AreaShape_Center_X,AreaShape_Center_Y,AreaShape_Area\n1,12,10,30\n2,40,30,30\n")
    told = {}
    for name in ("grey", "colour"):
        assert cli.main(["iod", str(made / f"{name}.tif"), str(tmp_path / "n.csv"), str(tmp_path / f"{name}.csv")]) == 0
        told[name] = sorted(tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / f"{name}.csv")).collect())
    assert told["grey"] == told["colour"] and len(told["grey"]) == 2
    assert {r[0]: float(r[5]) for r in told["grey"]} == pytest.approx({"1": np.log10(229 / 60), "2": np.log10(229 / 80)}, abs=1e-5)
    (tmp_path / "p.cppipe").write_text(FILE)
    assert cli.main(["segment", str(tmp_path / "p.cppipe"), str(made), str(tmp_path / "o")]) == 0
    rows = spark.read.option("header", True).csv(str(tmp_path / "o" / "Nuclei.csv")).drop("image_id", "ImageNumber").collect()
    assert len(rows) == 4 and len(set(map(tuple, rows))) == 2
    tiles.register(spark)
    held = spark.read.format("tiff_tiles").option("path", str(made)).option("tile", 16)
    assert {(r["image_id"].rsplit("/", 1)[1], r["channel"]) for r in held.option("take", 2).load().select("image_id", "channel").distinct().collect()} == {("grey.tif", 0), ("colour.tif", 2)}
    with pytest.raises(Exception, match="no channel 3"):
        held.option("take", 3).load().collect()


def test_pages_that_are_channels():
    class Plane:
        samples = 1

    def at(planes):
        return [a for _, a in planes]

    stack = [(Plane, (0, 0, 0)), (Plane, (1, 0, 0))]
    assert at(tiles.taken(stack, 1, "f")) == [(0, 0, 0), (1, 0, 0)]
    assert at(tiles.taken([(Plane, (0, 0, 0)), (Plane, (0, 0, 1))], 1, "f")) == [(0, 0, 1)]
    with pytest.raises(tiles.TiffError, match="f: no channel 2"):
        tiles.taken([(Plane, (0, 0, 0)), (Plane, (0, 0, 1))], 2, "f")


def test_pictures_of_one_row_group_are_made_by_many_tasks(spark, tmp_path):
    """A table may lie in a single row group, which only one task reads."""
    from lumetra.plans import file_catalog

    held = spark.range(5000).selectExpr("id AS vec_id", "array(float(-0.599), float(id % 128 / 200.0 - 0.59), float(0.67)) AS embedding")
    held.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    made = file_catalog._pictures(spark, str(tmp_path))
    assert made.rdd.getNumPartitions() > 1
    levels = {r["vec_id"]: r["l"] for r in held.selectExpr("vec_id", "transform(embedding, v -> floor((double(v) + 0.6) * 200)) AS l").collect()}
    got = {r["image"] * 100 + r["y"]: (bytes(r["data"]), r["samples"]) for r in made.collect()}
    assert got == {k: (bytes(s for v in row for s in (v, 255 - v, v // 2)), 3) for k, row in levels.items()}
    (tmp_path / "bad").mkdir()
    spark.createDataFrame([(1, [0.1, 0.9])], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "bad" / "embeddings.parquet"))
    with pytest.raises(Exception, match="range"):  # 0.9 is beyond 8 bits
        file_catalog._pictures(spark, str(tmp_path / "bad")).collect()
