import io
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumetra import cli
from lumetra.extract import Options, extract_channel, limited
from lumetra.sources import files, tiles
from lumetra.sources.bands import TASK_BYTES, task_count
from lumetra.sources.single_file import write_lines
from lumetra.sources.tiff_sink import write_images
from lumetra.sources.tiff import TiffError, compress_lzw, expand_lzw, read_pages, read_region, write_tiled


def picture(h, w, samples=3, seed=0, dtype=np.uint8):
    return np.random.default_rng(seed).integers(0, np.iinfo(dtype).max, (h, w, samples), dtype)


@pytest.mark.parametrize("h,w,samples,dtype", [(70, 45, 3, np.uint8), (16, 16, 1, np.uint16), (33, 64, 4, np.uint8)])
def test_write_and_read(h, w, samples, dtype):
    image, f = picture(h, w, samples, dtype=dtype), io.BytesIO()
    write_tiled(f, lambda a, b: image[a:b], h, w, dtype, "<OME/>", 16, resolution=(20000.0, 10000.0), samples=samples)
    page = read_pages(f)[0]
    assert page.shape == (image.shape if samples > 1 else (h, w)) and page.description == "<OME/>" and page.ratio(282) == 20000.0
    assert (read_region(f, page, 0, h) == image).all()
    assert (read_region(f, page, 5, 29, 3, 40) == image[5:29, 3:40]).all()


def test_not_a_tiff():
    with pytest.raises(TiffError):
        read_pages(io.BytesIO(b"GIF89a"))


def test_lzw():
    # clear, 'A', 'B', first new code (AB), end; nine bits each
    codes, bits = [256, 65, 66, 258, 257], ""
    bits = "".join(f"{c:09b}" for c in codes).ljust(48, "0")
    assert expand_lzw(int(bits, 2).to_bytes(6, "big")) == b"ABAB"
    assert zlib.decompress(zlib.compress(b"x")) == b"x"


@pytest.mark.parametrize("data", [b"", b"a", b"a" * 100_000, bytes(range(256)) * 40, np.random.default_rng(2).integers(0, 256, 60_000, np.uint8).tobytes(), np.random.default_rng(3).integers(0, 3, 90_000, np.uint8).tobytes()])
def test_lzw_round_trip(data):
    packed = compress_lzw(data)
    assert expand_lzw(packed) == data
    for n in (509, 510, 511, 512, 3836, 3837, 3838, 3839, 3840):  # where codes widen and tables are cleared
        part = np.random.default_rng(n).permutation(np.arange(n) % 256).astype(np.uint8).tobytes()
        assert expand_lzw(compress_lzw(part)) == part


@pytest.mark.parametrize("compression", ["lzw", "deflate", "none"])
@pytest.mark.parametrize("dtype,predictor,planar,pages", [(np.uint8, 2, 1, 1), (np.uint16, 2, 1, 2), (np.uint16, 1, 2, 3), (np.uint8, 2, 2, 2)])
def test_predictor_planes_and_pages(compression, dtype, predictor, planar, pages):
    stack, f = np.stack([picture(37, 45, 3, seed=i, dtype=dtype) for i in range(pages)]), io.BytesIO()
    size = write_tiled(f, lambda a, b, page=0: stack[page, a:b], 37, 45, dtype, "<OME/>", 16, samples=3, compression=compression, predictor=predictor, planar=planar, pages=pages)
    held = read_pages(f)
    assert len(held) == pages and size == len(f.getvalue()) and [p.description for p in held] == ["<OME/>"] + [None] * (pages - 1)
    for page, image in zip(held, stack):
        assert (read_region(f, page, 0, 37) == image).all()
        assert (read_region(f, page, 5, 29, 3, 40, 2) == image[5:29, 3:40, 2:]).all()


def test_axes_of_pages():
    page = lambda text: tiles.Page("<", {270: text, 277: (1,)})
    about = '<OME:Pixels DimensionOrder="XYCZT" SizeX="9" SizeZ="2" SizeC="3" SizeT="2"/>'
    assert tiles.plane_axes([page(about)] * 12)[:8] == [(0, 0, 0), (0, 0, 1), (0, 0, 2), (1, 0, 0), (1, 0, 1), (1, 0, 2), (0, 1, 0), (0, 1, 1)]
    assert tiles.plane_axes([page(about)] * 3) == [(0, 0, 0), (1, 0, 0), (2, 0, 0)]  # it tells of other pages
    assert tiles.plane_axes([page("")] * 3) == [(0, 0, 0), (1, 0, 0), (2, 0, 0)]


def test_pages_of_stacks(spark, tmp_path, monkeypatch):
    tiles.register(spark)
    stack = np.stack([picture(40, 20, seed=i) for i in range(5)])
    with open(tmp_path / "s.tif", "wb") as f:
        write_tiled(f, lambda a, b, page: stack[page, a:b], 40, 20, np.uint8, tile=16, samples=3, pages=5, planar=2)
    for part_bytes in (32 << 20, 900):
        monkeypatch.setattr(tiles, "PART_BYTES", part_bytes)
        got = spark.read.format("tiff_tiles").option("path", str(tmp_path / "s.tif")).option("tile", 16).option("chunk_rows", 16).option("pages", "all").load().filter("channel = 2").collect()
        held = np.zeros((5, 40, 20), np.uint8)
        for r in got:
            held[r["z"], r["y0"] : r["y0"] + r["h"], r["x0"] : r["x0"] + r["w"]] = np.array(r["data"]).reshape(r["h"], r["w"])
        assert (held == stack[..., 2]).all() and {r["page"] for r in got} == set(range(5))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    for name, samples in (("a.ome.btf", 3), ("grey.tif", 1)):
        image = picture(70, 45, samples)
        with open(root / name, "wb") as f:
            write_tiled(f, lambda a, b, image=image: image[a:b], 70, 45, np.uint8, '<OME><Image><Pixels PhysicalSizeX="0.5" PhysicalSizeY="0.5"/></Image></OME>', 16, samples=samples)
    (root / "bad.tif").write_bytes(b"")
    return root


@pytest.mark.parametrize("part_bytes", [32 << 20, 1000])
def test_tiles_of_one_channel(spark, folder, part_bytes, monkeypatch):
    monkeypatch.setattr(tiles, "PART_BYTES", part_bytes)
    tiles.register(spark)
    got = spark.read.format("tiff_tiles").option("path", str(folder / "a.ome.btf")).option("tile", 16).option("chunk_rows", 20).load().filter(F.col("channel") == 1).collect()
    image = np.zeros((70, 45), np.uint8)
    for r in got:
        image[r["y0"] : r["y0"] + r["h"], r["x0"] : r["x0"] + r["w"]] = np.array(r["data"]).reshape(r["h"], r["w"])
    assert (image == picture(70, 45)[:, :, 1]).all()


def test_extraction(spark, folder, tmp_path):
    tiles.register(spark)
    headers = spark.read.format("tiff_headers").option("path", str(folder)).load()
    assert headers.filter("error is not null").count() == 1
    done = {r["path"].rsplit("/", 1)[1]: r for r in extract_channel(headers, str(tmp_path), Options(channel=1, tile=16)).collect()}
    assert done["a.ome.btf"]["success"] and not done["grey.tif"]["success"] and not done["bad.tif"]["success"]
    with open(tmp_path / "a_green.ome.tiff", "rb") as f:
        page = read_pages(f)[0]
        assert (read_region(f, page, 0, 70)[:, :, 0] == picture(70, 45)[:, :, 1]).all()
        assert 'Name="green"' in page.description and 'PhysicalSizeX="0.5"' in page.description


def tasks_of(spark, group, f):
    """How many tasks the widest stage of ``f`` had."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = f()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [s for job in tracker.getJobIdsForGroup(group) for s in (tracker.getJobInfo(job).stageIds if tracker.getJobInfo(job) else [])]
    return out, max(i.numTasks for i in map(tracker.getStageInfo, stages) if i)


def test_many_files_and_large_files_take_many_tasks(spark, tmp_path):
    tiles.register(spark)
    (tmp_path / "many").mkdir()
    for i in range(60):
        with open(tmp_path / "many" / f"s{i}.tif", "wb") as f:
            write_tiled(f, lambda a, b, i=i: picture(20, 20, seed=i)[a:b], 20, 20, np.uint8, tile=16, samples=3)
    headers = spark.read.format("tiff_headers").option("path", str(tmp_path / "many")).load()
    done, n = tasks_of(spark, "many", lambda: extract_channel(headers, str(tmp_path / "out"), Options(tile=32)).collect())
    assert n >= 60 and sum(r["success"] for r in done) == 60
    image = picture(1000, 40)
    (tmp_path / "one").mkdir()
    with open(tmp_path / "one" / "large.tif", "wb") as f:
        write_tiled(f, lambda a, b: image[a:b], 1000, 40, np.uint8, tile=16, samples=3)
    headers = spark.read.format("tiff_headers").option("path", str(tmp_path / "one")).load()
    done, n = tasks_of(spark, "one", lambda: extract_channel(headers, str(tmp_path / "out"), Options(tile=16, compression="zstd")).collect())
    assert n >= 63 and done[0]["success"] and done[0]["message"] == "extracted"
    # the bytes of the writer that is one task
    with open(done[0]["output"], "rb") as f:
        held = f.read()
    page, again = read_pages(io.BytesIO(held))[0], io.BytesIO()
    write_tiled(again, lambda a, b: image[a:b, :, 1], 1000, 40, np.uint8, page.description, 16, 6, None, 1, "zstd")
    assert held == again.getvalue() and done[0]["output_bytes"] == len(held)


def test_a_file_that_breaks_off_has_no_output(spark, tmp_path):
    tiles.register(spark)
    (tmp_path / "in").mkdir()
    image = picture(200, 40)
    with open(tmp_path / "in" / "cut.tif", "wb") as f:
        write_tiled(f, lambda a, b: image[a:b], 200, 40, np.uint8, tile=16, samples=3)
        page = read_pages(open(f.name, "rb"))[0] if f.flush() is None else None
    with open(tmp_path / "in" / "cut.tif", "r+b") as f:
        f.seek(page.tags[324][-1])
        f.write(b"not what was packed")
    headers = spark.read.format("tiff_headers").option("path", str(tmp_path / "in")).load()
    done = extract_channel(headers, str(tmp_path / "out"), Options(tile=16)).collect()
    assert [r["success"] for r in done] == [False] and done[0]["message"] and not list((tmp_path / "out").glob("*"))


def test_a_decode_is_stopped(monkeypatch):
    began = time.monotonic()
    with pytest.raises(TimeoutError), limited(0.2):
        while True:
            pass
    assert time.monotonic() - began < 5
    with limited(None):
        pass


def test_lines_must_be_whole(spark, tmp_path):
    rows = [(1, y, bytearray(range(30)), 3) for y in range(50)] + [(2, y, bytearray(range(9)), 3) for y in range(3)]
    df = spark.createDataFrame(rows, "image int, y int, data binary, samples int").repartition(5)
    got = {r["image"]: r for r in write_images(df, str(tmp_path), tile=16).collect()}
    with open(got[1]["path"], "rb") as f:
        page = read_pages(f)[0]
        assert (read_region(f, page, 0, 50) == np.arange(30, dtype=np.uint8).reshape(1, 10, 3)).all() and page.shape == (50, 10, 3)
    for odd in ("image = 2 or y <> 7", "true"):
        broken = df.filter(odd) if odd != "true" else df.union(df.filter("y = 3"))
        with pytest.raises(Exception, match="lines are missing or uneven"):
            write_images(broken, str(tmp_path), tile=16).collect()


def test_pages_of_other_heights(spark, tmp_path):
    tiles.register(spark)
    stack = [picture(h, 20, seed=h) for h in (40, 6, 33)]
    rows = [(1, page, y, bytearray(line.tobytes()), 3) for page, image in enumerate(stack) for y, line in enumerate(image)]
    df = spark.createDataFrame(rows, "image int, page int, y int, data binary, samples int").repartition(5)
    write_images(df, str(tmp_path / "in"), tile=16, compression="lzw", predictor=2).collect()
    headers = spark.read.format("tiff_headers").option("path", str(tmp_path / "in")).load()
    assert headers.first()["heights"] == [40, 6, 33]
    done = extract_channel(headers, str(tmp_path / "out"), Options(channel=1, tile=32, pages=True)).collect()
    assert [r["message"] for r in done] == ["extracted"]
    for path, channels in ((tmp_path / "in" / "1.tiff", slice(0, 3)), (done[0]["output"], slice(1, 2))):
        with open(path, "rb") as f:
            assert all((read_region(f, page, 0, len(image)) == image[:, :, channels]).all() for page, image in zip(read_pages(f), stack, strict=True))
    for odd in ("page <> 1", "page <> 0 or y <> 0"):
        with pytest.raises(Exception, match="lines are missing or uneven"):
            write_images(df.filter(odd), str(tmp_path / "in"), tile=16).collect()


def test_batch_resumes(spark, folder, tmp_path):
    out, told = str(tmp_path / "out"), lambda i: str(tmp_path / f"report{i}")
    assert cli.main(["batch", str(folder), out, "--tile", "16", "--report", told(0), "--seconds", "0"]) == 1
    rows = spark.read.option("header", True).csv(told(0)).collect()
    assert len(rows) == 3 and sum("stopped after 0 s" in r["message"] for r in rows) == 1 and not list((tmp_path / "out").glob("*"))
    assert cli.main(["batch", str(folder), out, "--tile", "16", "--report", told(1)]) == 1  # one grey, one broken
    assert sum(r["success"] == "true" for r in spark.read.option("header", True).csv(told(1)).collect()) == 1
    cli.main(["batch", str(folder), out, "--tile", "16", "--report", told(2)])
    assert sorted(r["path"].rsplit("/", 1)[1] for r in spark.read.option("header", True).csv(told(2)).collect()) == ["bad.tif", "grey.tif"]


def test_command_line_density(spark, folder, tmp_path):
    (tmp_path / "n.csv").write_text("ObjectNumber,AreaShape_Center_X,AreaShape_Center_Y,AreaShape_Area\n1,20,20,30\n2,500,500,30\n")
    assert cli.main(["iod", str(folder / "a.ome.btf"), str(tmp_path / "n.csv"), str(tmp_path / "out")]) == 0
    rows = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert {r["ObjectNumber"]: float(r["True_IOD"]) > 0 for r in rows} == {"1": True, "2": False}


def test_command_line_density_refuses_several_images(folder, tmp_path, capsys):
    (tmp_path / "n.csv").write_text("ObjectNumber,AreaShape_Center_X,AreaShape_Center_Y,AreaShape_Area\n1,20,20,30\n")
    assert cli.main(["iod", str(folder), str(tmp_path / "n.csv"), str(tmp_path / "out")]) == 2
    assert cli.main(["iod", str(folder / "none.tif"), str(tmp_path / "n.csv"), str(tmp_path / "out")]) == 2
    assert "takes one image" in capsys.readouterr().err and not (tmp_path / "out").exists()


def test_one_file_by_many_tasks(spark, tmp_path):
    rows = [(i, f"é{i}" * (i % 5), float("nan") if i % 7 == 0 else i / 3, None if i % 3 else "a,b") for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, t string, v double, n string")
    path = str(tmp_path / "t" / "one.csv")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "one.csv").write_text("old")
    files.write_measurements(df.repartition(7), path, ["i"], single_file=True)
    held = open(path, encoding="utf-8").read().splitlines()
    assert held[0] == "i,t,v,n" and [int(line.split(",")[0]) for line in held[1:]] == list(range(3000))
    assert "NaN" in held[1] and list((tmp_path / "t").glob("*")) == [tmp_path / "t" / "one.csv"]
    lines = df.select(F.col("i").cast("string"))
    assert write_lines(lines, path, block_bytes=50) == sum(len(str(i)) + 1 for i in range(3000))
    assert sorted(map(int, open(path).read().split())) == list(range(3000))
    assert write_lines(lines.filter("false"), path, "head") == 5


def test_lines_of_a_file_in_blocks_are_numbered(spark, tmp_path):
    path = tmp_path / "many.csv"
    path.write_text("a,b\n" + "".join(f"{i},{'x' * (i % 9)}\n" for i in range(1, 5001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = files.numbered_lines(spark, str(path))
        assert got.rdd.getNumPartitions() > 10
        assert sorted((r["line"], int(r["a"])) for r in got.collect()) == [(i, i) for i in range(1, 5001)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_many_small_files_share_tasks(spark, tmp_path):
    tiles.register(spark)
    image = picture(8, 8, 1)
    for i in range(200):
        with open(tmp_path / f"s{i}.tif", "wb") as f:
            write_tiled(f, lambda a, b: image[a:b], 8, 8, np.uint8, tile=16)
    for source, option in (("tiff_headers", "path"), ("tiff_tiles", "tile")):
        held = spark.read.format(source).option("path", str(tmp_path)).option(option, str(tmp_path) if option == "path" else 16).load()
        assert 32 <= held.rdd.getNumPartitions() < 40 and held.count() == 200
    rows = spark.range(1000).selectExpr("id as image", "0 as y", "cast('abcd' as binary) as data", "1 as samples")
    done, n = tasks_of(spark, "small", lambda: write_images(rows, str(tmp_path / "out"), tile=16).collect())
    assert n <= 64 and len(done) == 1000 and len(list((tmp_path / "out").glob("*.tiff"))) == 1000


def test_tasks_follow_the_work():
    assert [task_count(n) for n in (0, 1, 60, 1000, 100_000)] == [1, 1, 60, 64, 391]
    assert task_count(1000, 1000 * TASK_BYTES) == 1000 and task_count(1000, 100 * TASK_BYTES) == 100 and task_count(10**6, 10**6 * TASK_BYTES) == 10_000


def test_lines_are_numbered_over_one_reading(spark, tmp_path):
    """A second reading may cut the file at other places, as cores come and go."""
    path = tmp_path / "many.csv"
    path.write_text("a\n" + "".join(f"{i}\n" for i in range(1, 2001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = files.numbered_lines(spark, str(path))
        path.unlink()
        assert sorted((r["line"], int(r["a"])) for r in got.collect()) == [(i, i) for i in range(1, 2001)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
