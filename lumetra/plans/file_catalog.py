"""Queries over files, with their SQL: images, tables and listings are written from the driver's tables and read back.

Importing this module registers the queries beside those of ``catalog``.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..extract import Options
from ..extract import extract_channel as extract_files
from ..functions import names, units
from ..operators import density, images, ome, planning, ranking, regions, report, tiled
from ..sources import files, tiles, zarr
from ..sources.scratch import new_folder, stored
from ..sources.tiff_sink import write_images
from . import measured, segmentation
from .catalog import IMAGE_CTE, OD_SQL, OBJECT_CTE, _image, _pixels, query, table

# --- images: a hundred lines of embeddings make a picture of three samples, v, 255 - v and v / 2 ---

PICTURE_CTE = f"{IMAGE_CTE}, pic AS (SELECT y // 100 AS image, y % 100 AS y, x, CAST(v AS BIGINT) AS v FROM px)"


#: Lines of a task that makes pictures: a table may lie in one row group, which one task reads.
TASK_LINES = 4096


def _pictures(spark, d) -> DataFrame:
    def lines(batches):
        for batch in batches:
            rows = batch.column(2)
            if rows.null_count or rows.flatten().null_count:
                raise ValueError("a line without values")
            v, ends = rows.flatten().to_numpy(), [0, *np.cumsum(rows.value_lengths().to_numpy() * 3).tolist()]
            if len(v) and not 0 <= v.min() <= v.max() <= 255:
                raise ValueError("values of a line must be in range(0, 256)")
            data = np.stack([v, 255 - v, v // 2], axis=1).astype(np.uint8).tobytes()
            held = [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(held, pa.binary()), pa.array([3] * len(held), pa.int32())], ["image", "y", "data", "samples"])

    k, held = F.col("vec_id").cast("long"), table(spark, d, "embeddings").select("vec_id", "embedding")
    n = -(-held.count() // TASK_LINES)
    held = held.repartition(n, "vec_id") if n > 1 else held
    level = F.transform("embedding", lambda v: F.floor((v.cast("double") + 0.6) * 200).cast("int"))
    rows = held.select(F.floor(k / 100).cast("long").alias("image"), (k % 100).alias("y"), level.alias("level"))
    return rows.mapInArrow(lines, "image long, y long, data binary, samples int")


def _pictures_of(spark, d) -> int:
    """How many pictures the table makes."""
    return table(spark, d, "embeddings").agg(F.floor(F.max("vec_id") / 100)).first()[0] + 1


def _written(spark, d, compression: str = "deflate") -> str:
    """The pictures in a new folder; what comes back is a row a file."""
    folder = new_folder(spark, "pictures")
    about = '<OME><Instrument ID="I"><Objective ID="A"/><Objective ID="B" Model="M40" NominalMagnification="40"/></Instrument><Image ID="0"><Pixels ID="P" PhysicalSizeX="0.5" PhysicalSizeY="0.25"><Channel ID="0" Name="RGB"/></Pixels></Image></OME>'
    write_images(_pictures(spark, d), folder, tile=16, resolution=(20000.0, 40000.0), description=about, compression=compression)
    tiles.register(spark)
    return folder


def _read(spark, folder: str, channel: int) -> DataFrame:
    """(image, y, x, v) of one channel out of tiles."""
    held = spark.read.format("tiff_tiles").option("path", folder).option("tile", 32).option("chunk_rows", 64).load().filter(F.col("channel") == channel)
    cells = held.select(_number(F.col("image_id")).alias("image"), "y0", "x0", "w", F.posexplode("data").alias("i", "v"))
    return cells.select("image", (F.col("y0") + F.floor(F.col("i") / F.col("w"))).cast("long").alias("y"), (F.col("x0") + F.col("i") % F.col("w")).cast("long").alias("x"), F.col("v").cast("long").alias("v"))


def _number(path: Column) -> Column:
    return F.regexp_extract(names.base_name(path), r"^([0-9]+)", 1).cast("long")


@query(f"WITH {PICTURE_CTE} SELECT image, y, x, v FROM pic")
def tiff_whole_image(spark, d):
    return _read(spark, _written(spark, d), 0)


@query(f"WITH {PICTURE_CTE} SELECT image, y, x, 255 - v AS v FROM pic")
def tiff_channel_window(spark, d):
    return _read(spark, _written(spark, d, "zstd"), 1)


@query(f"WITH {PICTURE_CTE} SELECT image, 1 AS n_pages, CAST(max(y) + 1 AS INTEGER) AS height, 64 AS width, 3 AS samples, 'uint8' AS dtype, 20000.0 AS x_resolution, 40000.0 AS y_resolution, 3 AS resolution_unit FROM pic GROUP BY image")
def tiff_header(spark, d):
    held = spark.read.format("tiff_headers").option("path", _written(spark, d, "none")).load()
    at = lambda i: F.get(F.col("shape"), F.lit(i))
    return held.select(_number(F.col("path")).alias("image"), "n_pages", at(0).alias("height"), at(1).alias("width"), at(2).alias("samples"), "dtype", "x_resolution", "y_resolution", "resolution_unit")


def _extracted(spark, d, dry_run: bool = False) -> tuple[DataFrame, str]:
    headers = spark.read.format("tiff_headers").option("path", _written(spark, d)).load()
    folder = new_folder(spark, "extracted")
    done = extract_files(headers, folder, Options(channel=1, tile=32, compression="zstd", dry_run=dry_run))
    return done, folder


@query(f"WITH {PICTURE_CTE} SELECT image, y, x, 255 - v AS v FROM pic")
def extracted_pixels(spark, d):
    return _read(spark, _extracted(spark, d)[1], 0)


@query(f"WITH {PICTURE_CTE} SELECT image, 20000.0 AS x_resolution, 40000.0 AS y_resolution, 3 AS resolution_unit, 'M40' AS objective, '40' AS magnification, '0.5' AS physical_size_x, '0.25' AS physical_size_y, 'green' AS channels, 'valid' AS status FROM pic GROUP BY image")
def extracted_metadata(spark, d):
    held = spark.read.format("tiff_headers").option("path", _extracted(spark, d)[1]).load()
    told = ome.parse(held.withColumn("xml", F.col("description")), "xml")
    state = ome.status(F.col("length").isNotNull(), F.lit(""), F.lit(""), F.col("physical_size_x"), F.col("physical_size_y"), F.col("description").isNotNull())
    return told.select(_number(F.col("path")).alias("image"), "x_resolution", "y_resolution", "resolution_unit", "objective", "magnification", "physical_size_x", "physical_size_y", F.array_join("channels", ",").alias("channels"), state.alias("status"))


@query(f"WITH {PICTURE_CTE} SELECT image, true AS success, 'planned' AS message, CAST(0 AS BIGINT) AS output_bytes FROM pic GROUP BY image")
def extraction_dry_run(spark, d):
    done, folder = _extracted(spark, d, dry_run=True)
    if os.listdir(folder):
        raise RuntimeError("a dry run has written")
    return done.select(_number(F.col("path")).alias("image"), "success", "message", "output_bytes")


def _stacks(spark, d) -> str:
    """The pictures as stacks of two pages of fifty lines, in LZW with differences."""
    folder = new_folder(spark, "stacks")
    about = '<OME><Image ID="0"><Pixels ID="P" DimensionOrder="XYCZT" SizeX="64" SizeY="50" SizeZ="2" SizeC="3" SizeT="1"/></Image></OME>'
    lines = _pictures(spark, d).select("image", F.floor(F.col("y") / 50).alias("page"), (F.col("y") % 50).alias("y"), "data", "samples")
    write_images(lines, folder, tile=16, description=about, compression="lzw", predictor=2)
    tiles.register(spark)
    return folder


def _planes(spark, folder: str, channel: int) -> DataFrame:
    """(image, z, y, x, v) of one channel of every page."""
    held = spark.read.format("tiff_tiles").option("path", folder).option("tile", 32).option("pages", "all").load().filter(F.col("channel") == channel)
    cells = held.select(_number(F.col("image_id")).alias("image"), F.col("z").cast("long").alias("z"), "y0", "x0", "w", F.posexplode("data").alias("i", "v"))
    return cells.select("image", "z", (F.col("y0") + F.floor(F.col("i") / F.col("w"))).cast("long").alias("y"), (F.col("x0") + F.col("i") % F.col("w")).cast("long").alias("x"), F.col("v").cast("long").alias("v"))


STACK_SQL = f"WITH {PICTURE_CTE} SELECT image, y // 50 AS z, y % 50 AS y, x, 255 - v AS v FROM pic"


@query(STACK_SQL)
def stack_channel_slice(spark, d):
    """One channel out of a 4-D stack."""
    return _planes(spark, _stacks(spark, d), 1)


@query(STACK_SQL)
def extracted_stack(spark, d):
    """One channel of every page of stacks, extracted to stacks of their own."""
    folder = new_folder(spark, "extracted")
    headers = tiles.headers_of(files.listing(spark, _stacks(spark, d), "*.tiff"))
    extract_files(headers, folder, Options(channel=1, tile=32, compression="lzw", predictor=2, pages=True))
    return _planes(spark, folder, 0)


@query(f"WITH {PICTURE_CTE} SELECT image, y, x, 255 - v AS v FROM pic WHERE y >= 10 AND y < 45 AND x >= 20 AND x < 50")
def zarr_window(spark, d):
    """A window of one channel out of chunked arrays: of all that the table makes."""
    folder = new_folder(spark, "arrays")
    made = zarr.write_zarr(_pictures(spark, d), folder, chunk=16)
    stores = made.select(F.concat(F.lit(f"{folder}/"), F.col("image").cast("string"), F.lit(".zarr")).alias("path"))
    held = zarr.windows(stores, channel=1, rows="10:45", columns="20:50")
    cells = held.select(_number(F.col("image_id")).alias("image"), "y0", "x0", "w", F.posexplode("data").alias("i", "v"))
    return cells.select("image", (F.col("y0") + F.floor(F.col("i") / F.col("w"))).cast("long").alias("y"), (F.col("x0") + F.col("i") % F.col("w")).cast("long").alias("x"), F.col("v").cast("long").alias("v"))


CIRCLES_CTE = "ci AS (SELECT p_partkey AS object_id, p_partkey % (SELECT max(vec_id) // 100 + 1 FROM embeddings) AS image, CAST(trunc(p_partkey % 64 + 0.7) AS BIGINT) AS cx, CAST(trunc((p_partkey * 7) % 100 - 0.5) AS BIGINT) AS cy, CAST(trunc(sqrt(p_size * 2.0 / pi())) AS BIGINT) AS r FROM part)"


@query(f"""WITH {PICTURE_CTE}, {CIRCLES_CTE}, bg AS (SELECT image, quantile_cont(CAST(v AS DOUBLE), 0.95) AS b FROM pic GROUP BY image)
    SELECT ci.image, object_id, round(sum({OD_SQL.format(v='CAST(v AS DOUBLE)', b='b')}), 6) AS True_IOD, CAST(count(*) AS BIGINT) AS PixelCount
    FROM ci JOIN pic ON ci.image = pic.image AND (pic.x - cx) * (pic.x - cx) + (pic.y - cy) * (pic.y - cy) <= r * r JOIN bg ON bg.image = pic.image GROUP BY ALL""")
def region_iod_per_image(spark, d):
    """Circles of several images, each over its own image's pixels and background, out of written files."""
    px = _read(spark, _written(spark, d), 0).withColumn("v", F.col("v").cast("double"))
    p = F.col("p_partkey")
    circles = table(spark, d, "part").select("p_partkey", (p % _pictures_of(spark, d)).alias("image"), (p % 64 + 0.7).alias("cx"), ((p * 7) % 100 - 0.5).alias("cy"), (F.col("p_size") * 2.0).alias("area"))
    inside = regions.region_pixels(circles, px, "p_partkey", "cx", "cy", "area", "image")
    od = density.densities(density.with_background(inside, density.background(px, "v", ["image"]), ["image"]), "v")
    return density.object_density(od, ["image", "object_id"]).select("image", "object_id", "True_IOD", "PixelCount")


@query(f"""WITH {PICTURE_CTE}, {CIRCLES_CTE}, bg AS (SELECT image, quantile_cont(CAST(v AS DOUBLE), 0.95) AS b FROM pic GROUP BY image)
    SELECT ci.image, object_id, round(sum({OD_SQL.format(v='CAST(v AS DOUBLE)', b='b')}), 6) AS True_IOD, round(avg({OD_SQL.format(v='CAST(v AS DOUBLE)', b='b')}), 6) AS Mean_OD, round(max({OD_SQL.format(v='CAST(v AS DOUBLE)', b='b')}), 6) AS Max_OD,
           round(min({OD_SQL.format(v='CAST(v AS DOUBLE)', b='b')}), 6) AS Min_OD, CAST(count(*) AS BIGINT) AS PixelCount, any_value(b) AS Background_I0
    FROM ci JOIN pic ON ci.image = pic.image AND (pic.x - cx) * (pic.x - cx) + (pic.y - cy) * (pic.y - cy) <= r * r JOIN bg ON bg.image = pic.image GROUP BY ALL""")
def tiled_iod(spark, d):
    """The same circles summed up tile by tile, without a row a pixel."""
    folder, p = _written(spark, d), F.col("p_partkey")
    held = spark.read.format("tiff_tiles").option("path", folder).option("tile", 32).load().filter(F.col("channel") == 0)
    circles = table(spark, d, "part").select("p_partkey", F.concat(F.lit(f"{folder}/"), (p % _pictures_of(spark, d)).cast("string"), F.lit(".tiff")).alias("image_id"), (p % 64 + 0.7).alias("cx"), ((p * 7) % 100 - 0.5).alias("cy"), (F.col("p_size") * 2.0).alias("area"))
    sums = tiled.tile_sums(held, circles, tiled.tile_background(held), "p_partkey", "cx", "cy", "area", 32)
    return sums.select(_number(F.col("image_id")).alias("image"), "object_id", "True_IOD", "Mean_OD", "Max_OD", "Min_OD", "PixelCount", "Background_I0")


# --- measurements -----------------------------------------------------------------------------


@query("SELECT CAST(p_partkey AS VARCHAR) AS ObjectNumber, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN CAST('NaN' AS DOUBLE) ELSE p_size + 0.75 END AS x, p_retailprice AS y, CAST(p_size AS DOUBLE) AS area, 1 AS image, 'N/A' AS intensity FROM part")
def nuclei_from_csv(spark, d):
    folder, k = f"{new_folder(spark, 'tables')}/nuclei", F.col("p_partkey")
    x = F.when(k % 7 == 0, F.lit("")).when(k % 5 == 0, "NaN").otherwise((F.col("p_size") + 0.75).cast("string"))
    rows = table(spark, d, "part").select(k.alias("ObjectNumber"), x.alias("AreaShape_Center_X"), F.col("p_retailprice").alias("AreaShape_Center_Y"), F.col("p_size").alias("AreaShape_Area"))
    rows.write.option("header", True).csv(folder)
    held = files.nuclei(spark, folder, passthrough="Intensity_IntegratedIntensity_OrigGreen")
    return held.select("ObjectNumber", F.col("AreaShape_Center_X").alias("x"), F.col("AreaShape_Center_Y").alias("y"), F.col("AreaShape_Area").alias("area"), F.col("ImageNumber").alias("image"), F.col("IntegratedIntensity").alias("intensity"))


@query(f"WITH {OBJECT_CTE} SELECT CAST(row_number() OVER (ORDER BY True_IOD, ObjectNumber) AS BIGINT) AS line, CAST(ObjectNumber AS VARCHAR) AS ObjectNumber, QC_Passed FROM qc")
def measurements_file(spark, d):
    """Every object, passed or not, in one file in the order of its density."""
    folder = f"{new_folder(spark, 'tables')}/iod"
    objects = density.object_density(_pixels(spark, d), ["l_orderkey"]).withColumnRenamed("l_orderkey", "ObjectNumber")
    files.write_measurements(density.trimmed(objects, ["True_IOD", "ObjectNumber"]).select("ObjectNumber", "True_IOD", "QC_Passed"), folder, ["True_IOD", "ObjectNumber"], single_file=True)
    return files.numbered_lines(spark, folder).select("line", "ObjectNumber", "QC_Passed")


@query("""SELECT 'Images' AS kind, user_id AS image, CAST(count(*) AS BIGINT) AS n, round(avg(value), 4) AS value FROM events GROUP BY user_id
    UNION ALL SELECT 'Objects', user_id, event_id, round(value, 4) FROM events""")
def exported_measurements(spark, d):
    """Objects and images in tables of their own with one prefix, read back."""
    folder, rows = new_folder(spark, "export"), table(spark, d, "events").select(F.col("user_id").alias("image"), F.col("event_id").alias("n"), F.round("value", 4).alias("value"))
    stats = report.measurement_stats(table(spark, d, "events"), "user_id", "value").select(F.col("user_id").alias("image"), "n", F.round("mean", 4).alias("value"))
    files.write_export(rows, stats, folder, "Oil_")
    read = lambda kind: spark.read.option("header", True).csv(f"{folder}/Oil_{kind}.csv").select(F.lit(kind).alias("kind"), F.col("image").cast("long"), F.col("n").cast("long"), F.col("value").cast("double"))
    return read("Images").unionByName(read("Objects"))


@query(f"WITH {OBJECT_CTE}, low AS (SELECT l_orderkey, round(min(od), 6) AS Min_OD FROM px GROUP BY 1) SELECT ObjectNumber, Mean_OD, Min_OD, Max_OD FROM qc JOIN low ON l_orderkey = ObjectNumber")
def od_range(spark, d):
    return density.object_density(_pixels(spark, d), ["l_orderkey"]).select(F.col("l_orderkey").alias("ObjectNumber"), "Mean_OD", "Min_OD", "Max_OD")


@query("SELECT image, n, cv FROM (SELECT p_partkey % 8 AS image, count(*) AS n, round(stddev_pop(p_retailprice + (p_partkey % 8) * p_size * 10) / avg(p_retailprice + (p_partkey % 8) * p_size * 10) * 100, 6) AS cv FROM part GROUP BY 1) WHERE n >= 20 AND cv < 20")
def sample_acceptance_stated(spark, d):
    """The documented bounds: 20 objects at least and a variation below 20; samples lie on both sides of it."""
    image = F.col("p_partkey") % 8
    objects = table(spark, d, "part").select(image.alias("image"), (F.col("p_retailprice") + image * F.col("p_size") * 10).alias("True_IOD"), F.lit("Yes").alias("QC_Passed"))
    return density.accepted_samples(density.summary(objects, keys=["image"]), least_n=20, most_cv=20.0).select("image", "n", "cv")


# --- listings ---------------------------------------------------------------------------------


def _tree(spark, d) -> str:
    """A file of as many bytes as its key for every nation, every third one a directory deeper."""
    folder = new_folder(spark, "tree")
    os.makedirs(os.path.join(folder, "deep"))

    def write(batches):
        for batch in batches:
            for key in batch.column(0).to_pylist():
                end = ("_raw.ome.btf", ".BTF", ".vsi", ".ome.tiff", ".Btf")[key % 5]
                with open(os.path.join(folder, "deep" if key % 3 == 0 else "", f"s{key}{end}"), "wb") as f:
                    f.write(b"x" * key)
            yield batch

    table(spark, d, "nation").select("n_nationkey").mapInArrow(write, "n_nationkey int").write.format("noop").mode("overwrite").save()
    return folder


TREE_CTE = "tree AS (SELECT n_nationkey AS k, 's' || n_nationkey || CASE n_nationkey % 5 WHEN 0 THEN '_raw.ome.btf' WHEN 1 THEN '.BTF' WHEN 2 THEN '.vsi' WHEN 3 THEN '.ome.tiff' ELSE '.Btf' END AS name, n_nationkey % 3 = 0 AS deep FROM nation)"


@query("""SELECT lang || '/_' || (doc_id % 3) || '/.' || (doc_id % 11) || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.btf' WHEN 1 THEN '.BTF' WHEN 2 THEN '.vsi' ELSE '.txt' END AS name, CAST(doc_id % 50 AS BIGINT) AS length
    FROM documents WHERE doc_id % 4 < 3""")
def tree_listing(spark, d):
    """A file a document in a tree of hidden and underscored directories, some files empty: a tree that grows with the table."""
    folder = new_folder(spark, "grown")

    def write(batches):
        for batch in batches:
            for name, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = os.path.join(folder, name)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as f:
                    f.write(b"x" * (key % 50))
            yield batch

    k = F.col("doc_id")
    end = F.element_at(F.array(*[F.lit(e) for e in (".btf", ".BTF", ".vsi", ".txt")]), (k % 4 + 1).cast("int"))
    name = F.concat(F.col("lang"), F.lit("/_"), (k % 3).cast("string"), F.lit("/."), (k % 11).cast("string"), F.lit("/"), k.cast("string"), end)
    table(spark, d, "documents").select(name.alias("name"), "doc_id").mapInArrow(write, "name string, doc_id long").write.format("noop").mode("overwrite").save()
    return files.listing(spark, folder, "*.{btf,BTF,vsi}").select(F.substring(F.col("path"), len(folder) + 2, 1000).alias("name"), "length")


@query(f"WITH {TREE_CTE} SELECT name, CAST(k AS BIGINT) AS length FROM tree WHERE k % 5 IN (0, 1)")
def stack_listing(spark, d):
    return files.listing(spark, _tree(spark, d), "*.{btf,BTF}").select(names.base_name(F.col("path")).alias("name"), "length")


@query(f"WITH {TREE_CTE} SELECT name FROM tree WHERE k % 5 = 3")
def tiff_listing(spark, d):
    return planning.of_kind(files.listing(spark, _tree(spark, d)), planning.TIFFS).select(names.base_name(F.col("path")).alias("name"))


@query(f"WITH {TREE_CTE} SELECT name FROM tree WHERE k % 5 IN (0, 2) AND NOT deep")
def flat_listing(spark, d):
    """One directory alone, and the narrower list of suffixes that scripts look for."""
    return files.listing(spark, _tree(spark, d), "*.{btf,vsi,VSI}", recursive=False).select(names.base_name(F.col("path")).alias("name"))


@query("SELECT doc_id FROM documents WHERE doc_id % 10 = 3")
def listed_files(spark, d):
    folder = f"{new_folder(spark, 'lists')}/names"
    paths = table(spark, d, "documents").select("doc_id", F.concat(F.lit("/data/s "), F.col("doc_id").cast("string"), F.lit(".btf")).alias("path"))
    paths.filter("doc_id % 10 = 3").select("path").write.text(folder)
    return planning.listed_in(paths, files.named_files(spark, folder)).select("doc_id")


def _shown(spark, d):
    k = F.col("doc_id")
    folder = F.when(k % 6 == 0, "/data/.cache/").otherwise("/data/x/")
    part = F.when(k % 2 == 0, "_green").otherwise("_red")
    end = F.element_at(F.array(*[F.lit(e) for e in (".tif", ".PNG", ".txt", ".btf")]), (k % 4 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.concat(folder, k.cast("string"), part, end).alias("path"))


@query("SELECT doc_id FROM documents WHERE doc_id % 6 <> 0 AND doc_id % 4 <> 2")
def visible_image_files(spark, d):
    return planning.visible_images(_shown(spark, d)).select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 0")
def image_set_by_name(spark, d):
    return planning.named_like(_shown(spark, d), "green").select("doc_id")


@query("SELECT doc_id, doc_id % 3 = 0 AS slide FROM documents")
def slide_suffix(spark, d):
    k = F.col("doc_id")
    end = F.when(k % 6 == 0, ".VSI").when(k % 3 == 0, ".vsi").otherwise(".vsi.bak")
    return table(spark, d, "documents").select("doc_id", planning.is_slide(F.concat(F.lit("/data/a.b/"), k.cast("string"), end)).alias("slide"))


@query("SELECT doc_id, switch FROM documents, (VALUES ('raw'), ('slides')) t(switch) WHERE CASE switch WHEN 'raw' THEN doc_id % 2 = 0 ELSE doc_id % 2 = 1 END")
def kind_switches(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "btf").otherwise("vsi").alias("kind"))
    one = lambda name, **switch: planning.only_kinds(rows, **switch).select("doc_id", F.lit(name).alias("switch"))
    return one("raw", raw_only=True).unionByName(one("slides", slides_only=True)).unionByName(one("both", raw_only=True, slides_only=True))


@query("SELECT doc_id, round(n_chars * 1000 / (1024.0 * 1024.0), 6) AS mb, round(n_chars * 1000 / (1024.0 * 1024.0 * 1024.0), 6) AS gb FROM documents WHERE n_chars * 1000 <= 1000000")
def small_outputs(spark, d):
    """Outputs of a million bytes at most count as not done; sizes in MB and GB."""
    rows = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), (F.col("n_chars") * 1000).alias("length"))
    left = planning.missing_outputs(rows, F.col("path"), rows, least_bytes=1_000_000)
    return left.select("doc_id", F.round(units.megabytes(F.col("length")), 6).alias("mb"), F.round(units.gigabytes(F.col("length")), 6).alias("gb"))


@query("SELECT source AS directory, doc_id AS name, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS place FROM documents")
def dir_listing_numbered(spark, d):
    return report.numbered_by_directory(table(spark, d, "documents").select(F.col("source").alias("directory"), F.col("doc_id").alias("name")), "directory", "name")


# --- text, times and states -------------------------------------------------------------------


@query("""SELECT conv_id, turn, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT contains(x, 'the')), chr(10)) AS kept,
    array_to_string(list_slice(string_split(text, chr(10)), greatest(len(string_split(text, chr(10))) - 4, 1), len(string_split(text, chr(10)))), chr(10)) AS last_five FROM conversations""")
def filtered_lines(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", names.lines_without(t, "the").alias("kept"), names.last_lines(t, 5).alias("last_five"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, strftime(ts, '%Y_%m_%d') AS folder_date FROM events")
def stamps_and_dates(spark, d):
    folder = F.concat(F.lit("/data/plate "), F.date_format("ts", "yyyy_MM_dd"))
    return table(spark, d, "events").select("event_id", names.stamp(F.col("ts")).alias("stamp"), names.folder_date(folder).alias("folder_date"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'OK' WHEN 1 THEN '!' WHEN 2 THEN 'X' WHEN 3 THEN 'X' WHEN 4 THEN '~' ELSE '?' END AS icon,
    CASE p_partkey % 6 WHEN 0 THEN 'Ready for analysis' WHEN 1 THEN 'Missing pixel size - measurements will be in pixels only' END AS message FROM part""")
def status_lines(spark, d):
    state = F.element_at(F.array(*[F.lit(s) for s in ("valid", "missing_metadata", "file_not_found", "cannot_read", "tiff_only", "unknown")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", ome.status_icon(state).alias("icon"), ome.status_message(state).alias("message"))


# --- objects ----------------------------------------------------------------------------------


@query("SELECT p_partkey FROM part WHERE p_size * 5.0 BETWEEN 30 AND 200 AND p_partkey % 9 > 0 AND p_partkey % 11 > 0 AND p_partkey % 9 + 5 < 12 AND p_partkey % 11 + 5 < 14")
def kept_objects(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(k, (F.col("p_size") * 5.0).alias("equivalent_diameter"), (k % 9).alias("min_x"), (k % 11).alias("min_y"), (k % 9 + 5).alias("max_x"), (k % 11 + 5).alias("max_y"))
    return images.clear_of_border(images.well_sized(rows), 13, 15).select("p_partkey")


@query("SELECT DISTINCT o_orderkey AS object_id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def filtered_parents(spark, d):
    children = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("object_id"))
    return report.surviving_parents(table(spark, d, "orders").select(F.col("o_orderkey").alias("object_id")), children, ["object_id"])


@query(f"""WITH {IMAGE_CTE}, ob AS (SELECT y // 8 AS object_id, x, y FROM px WHERE v > 120), s AS (SELECT * FROM (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) t(dy, dx)),
    e AS (SELECT ob.object_id, count(*) AS inner_edges FROM ob, s, ob AS o WHERE o.object_id = ob.object_id AND o.y = ob.y + s.dy AND o.x = ob.x + s.dx GROUP BY 1), a AS (SELECT object_id, count(*) AS area FROM ob GROUP BY 1)
    SELECT object_id, CAST(area AS BIGINT) AS area, CAST(4 * area - coalesce(inner_edges, 0) AS BIGINT) AS perimeter, round(4 * pi() * area / ((4 * area - coalesce(inner_edges, 0)) * (4 * area - coalesce(inner_edges, 0))), 6) AS form_factor FROM a LEFT JOIN e USING (object_id)""")
def perimeter_form_factor(spark, d):
    return images.perimeters(_image(spark, d).filter("v > 120").withColumn("object_id", F.floor(F.col("y") / 8).cast("long")), "object_id")


@query(f"""WITH {IMAGE_CTE}, k AS (SELECT unnest(range(-2, 3)) AS i)
    SELECT px.y, px.x, round(sum(exp(-(a.i * a.i + b.i * b.i) / 2.0) * q.v) / sum(exp(-(a.i * a.i + b.i * b.i) / 2.0)), 4) AS v
    FROM px, k a, k b, px AS q WHERE q.y = px.y + a.i AND q.x = px.x + b.i GROUP BY 1, 2""")
def smoothed_image(spark, d):
    return images.smoothed(_image(spark, d), 1.0, 2, digits=4)


@query(f"""WITH {IMAGE_CTE}, h AS (SELECT y // 100 AS "row", x // 32 AS "column", greatest(0, least(15, floor(v * (16 / 256.0)))) * 16.0 AS level, count(*) AS n FROM px GROUP BY ALL),
    c AS (SELECT *, sum(n) OVER w AS w, sum(n * level) OVER w AS m, sum(n) OVER (PARTITION BY "row", "column") AS tw, sum(n * level) OVER (PARTITION BY "row", "column") AS tm FROM h WINDOW w AS (PARTITION BY "row", "column" ORDER BY level)),
    p AS (SELECT a."row", a."column", a.level AS low, b.level AS high, round(a.m * a.m / a.w + (b.m - a.m) * (b.m - a.m) / (b.w - a.w) + (b.tm - b.m) * (b.tm - b.m) / (b.tw - b.w), 6) AS score FROM c a JOIN c b USING ("row", "column") WHERE a.level < b.level AND b.w < b.tw)
    SELECT "row", "column", low * 0.8 AS low, high * 0.8 AS high FROM (SELECT *, row_number() OVER (PARTITION BY "row", "column" ORDER BY score DESC, low, high) AS nth FROM p) WHERE nth = 1""")
def adaptive_thresholds(spark, d):
    px = _image(spark, d)
    tall = px.withColumn("y", F.floor(F.col("y") / 100) * 32 + F.col("y") % 32)  # windows of 100 lines by 32 columns
    return images.window_thresholds(tall, "v", 32, 16, 0.0, 256.0, 0.8)


#: Thresholds of windows of 32 lines and columns, from 16 levels.
WINDOWS_CTE = f"""{IMAGE_CTE}, h AS (SELECT y // 32 AS r, x // 32 AS k, greatest(0, least(15, floor(v * (16 / 256.0)))) * 16.0 AS level, count(*) AS n FROM px GROUP BY ALL),
    c AS (SELECT *, sum(n) OVER w AS w, sum(n * level) OVER w AS m, sum(n) OVER (PARTITION BY r, k) AS tw, sum(n * level) OVER (PARTITION BY r, k) AS tm FROM h WINDOW w AS (PARTITION BY r, k ORDER BY level)),
    p AS (SELECT a.r, a.k, a.level AS low, b.level AS high, round(a.m * a.m / a.w + (b.m - a.m) * (b.m - a.m) / (b.w - a.w) + (b.tm - b.m) * (b.tm - b.m) / (b.tw - b.w), 6) AS score FROM c a JOIN c b USING (r, k) WHERE a.level < b.level AND b.w < b.tw),
    t AS MATERIALIZED (SELECT r, k, low * 0.8 AS low, high * 0.8 AS high FROM (SELECT *, row_number() OVER (PARTITION BY r, k ORDER BY score DESC, low, high) AS nth FROM p) WHERE nth = 1)"""


@query(f"""WITH {WINDOWS_CTE}, e AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM px),
    q AS (SELECT y, x, r, k, y - (r * 32 + (least(32, h - r * 32) - 1) / 2.0) AS ey, x - (k * 32 + (least(32, w - k * 32) - 1) / 2.0) AS ex, h, w FROM (SELECT y, x, y // 32 AS r, x // 32 AS k FROM px), e),
    n AS (SELECT *, CASE WHEN ey < 0 AND r > 0 THEN -1 WHEN ey > 0 AND r < (h - 1) // 32 THEN 1 ELSE 0 END AS dr, CASE WHEN ex < 0 AND k > 0 THEN -1 WHEN ex > 0 AND k < (w - 1) // 32 THEN 1 ELSE 0 END AS dk FROM q),
    f AS (SELECT *, CASE WHEN dr = 0 THEN 0 ELSE abs(ey) / abs((r + dr) * 32 + (least(32, h - (r + dr) * 32) - 1) / 2.0 - r * 32 - (least(32, h - r * 32) - 1) / 2.0) END AS fy,
                    CASE WHEN dk = 0 THEN 0 ELSE abs(ex) / abs((k + dk) * 32 + (least(32, w - (k + dk) * 32) - 1) / 2.0 - k * 32 - (least(32, w - k * 32) - 1) / 2.0) END AS fx FROM n)
    SELECT y, x, round((1 - fy) * ((1 - fx) * a.low + fx * b.low) + fy * ((1 - fx) * c.low + fx * d.low), 6) AS low, round((1 - fy) * ((1 - fx) * a.high + fx * b.high) + fy * ((1 - fx) * c.high + fx * d.high), 6) AS high
    FROM f JOIN t a ON a.r = f.r AND a.k = f.k JOIN t b ON b.r = f.r AND b.k = f.k + dk JOIN t c ON c.r = f.r + dr AND c.k = f.k JOIN t d ON d.r = f.r + dr AND d.k = f.k + dk""")
def threshold_surface(spark, d):
    """Thresholds of windows, bilinear between their middles; the last windows are narrower."""
    px = _image(spark, d)
    return images.threshold_surface(px, images.window_thresholds(px, "v", 32, 16, 0.0, 256.0, 0.8), 32)


@query("""WITH h AS (SELECT l_returnflag AS image, floor(l_extendedprice / 20) AS level, count(*) AS n FROM lineitem GROUP BY ALL), c AS (SELECT image, level, sum(n) OVER w AS w, sum(n * level) OVER w AS m, sum(n) OVER (PARTITION BY image) AS tw, sum(n * level) OVER (PARTITION BY image) AS tm FROM h WINDOW w AS (PARTITION BY image ORDER BY level)),
    s AS (SELECT a.image, a.level AS low, b.level AS high, round(a.m * a.m / a.w + (b.m - a.m) * (b.m - a.m) / (b.w - a.w) + (b.tm - b.m) * (b.tm - b.m) / (b.tw - b.w), 6) AS score FROM c a JOIN c b ON a.image = b.image AND a.level < b.level AND b.w < b.tw)
    SELECT image, arg_max(low, (score, -low, -high)) AS low, arg_max(high, (score, -low, -high)) AS high FROM s GROUP BY image""")
def otsu_many_levels(spark, d):
    """Three classes an image out of thousands of levels, without all their pairs."""
    px = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("image"), F.floor(F.col("l_extendedprice") / 20).alias("v"))
    return images.otsu(images.histogram(px, "v", ["image"]), 3, ["image"])


@query("SELECT user_id AS image, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.1), 6) AS p10 FROM events GROUP BY 1 UNION ALL SELECT -1, round(quantile_cont(value, 0.95), 6), round(quantile_cont(value, 0.5), 6), round(quantile_cont(value, 0.1), 6) FROM events")
def percentiles_by_image(spark, d):
    """Exact percentiles of fractions, of each image and of one image (-1) that holds all rows."""
    rows = table(spark, d, "events").select("user_id", "value")
    held = rows.withColumnRenamed("user_id", "image").unionByName(rows.select(F.lit(-1).cast(rows.schema["user_id"].dataType).alias("image"), "value"))
    found = ranking.percentiles(held, "value", ["image"], {"p95": 95.0, "p50": 50.0, "p10": 10.0})
    return found.select("image", *[F.round(c, 6).alias(c) for c in ("p95", "p50", "p10")])


#: A file of modules: upside down, objects of a global threshold, their sizes.
PIPELINE = """Version:5
NamesAndTypes:[module_num:1]
    Name to assign these images:Dark

ImageMath:[module_num:2]
    Operation:Invert
    Set values less than 0 equal to 0?:Yes
    Name the output image:Bright
    Select the first image:Dark

IdentifyPrimaryObjects:[module_num:3]
    Select the input image:Bright
    Name the primary objects to be identified:Nuclei
    Typical diameter of objects, in pixel units (Min,Max):2,40
    Discard objects outside the diameter range?:Yes
    Method to distinguish clumped objects:None
    Threshold strategy:Global
    Thresholding method:Otsu
    Two-class or three-class thresholding?:Three classes
    Assign pixels in the middle intensity class to the foreground or the background?:Background

MeasureObjectSizeShape:[module_num:4]
    Select object sets to measure:Nuclei

ExportToSpreadsheet:[module_num:5]
    Add a prefix to file names?:Yes
    Filename prefix:Oil_
"""


@query(f"""WITH RECURSIVE {IMAGE_CTE}, b AS (SELECT y, x, greatest(0.0, 1 - v / 255.0) AS v FROM px), h AS (SELECT greatest(0, least(255, floor(v * 256.0))) * (1 / 256.0) AS level, count(*) AS n FROM b GROUP BY 1),
    c AS (SELECT level, sum(n) OVER (ORDER BY level) AS w, sum(n * level) OVER (ORDER BY level) AS m, sum(n) OVER () AS tw, sum(n * level) OVER () AS tm FROM h),
    t AS (SELECT b.level + 1 / 256.0 AS high FROM c a JOIN c b ON a.level < b.level AND b.w < b.tw ORDER BY round(a.m * a.m / a.w + (b.m - a.m) * (b.m - a.m) / (b.w - a.w) + (b.tm - b.m) * (b.tm - b.m) / (b.tw - b.w), 6) DESC, a.level, b.level LIMIT 1),
    fg AS MATERIALIZED (SELECT y, x FROM b, t WHERE v >= high), side AS (SELECT a.i AS dy, b.i AS dx FROM (SELECT unnest(range(-1, 2)) AS i) a, (SELECT unnest(range(-1, 2)) AS i) b WHERE a.i <> 0 OR b.i <> 0),
    lab(y, x, label) USING KEY (y, x) AS (SELECT y, x, y * 4294967296 + x FROM fg
        UNION SELECT f.y, f.x, min(l.label) FROM lab l, side s JOIN fg f ON f.y = l.y + s.dy AND f.x = l.x + s.dx JOIN recurring.lab r ON r.y = f.y AND r.x = f.x GROUP BY f.y, f.x, r.label HAVING min(l.label) < r.label)
    SELECT CAST(label AS BIGINT) AS object_id, count(*) AS area, round(avg(x), 6) AS center_x, round(avg(y), 6) AS center_y FROM lab GROUP BY label HAVING round(sqrt(4 * count(*) / pi()), 6) BETWEEN 2 AND 40""")
def pipeline_file(spark, d):
    """A pipeline file run over the image of all embeddings; its export read back."""
    folder = new_folder(spark, "pipeline")
    with open(path := os.path.join(folder, "objects.cppipe"), "w", encoding="utf-8") as f:
        f.write(PIPELINE)
    dark = _image(spark, d).withColumn("v", F.col("v") / 255.0)
    segmentation.run_pipeline(spark, path, {"Dark": dark}, folder=folder)
    held = spark.read.option("header", True).csv(f"{folder}/Oil_Nuclei.csv")
    return held.select(F.col("object_id").cast("long").alias("object_id"), F.col("area").cast("long").alias("area"), F.col("center_x").cast("double").alias("center_x"), F.col("center_y").cast("double").alias("center_y"))


@query(f"""WITH RECURSIVE {PICTURE_CTE}, b AS (SELECT image, y, x, greatest(0.0, 1 - v / 255.0) AS v FROM pic), h AS (SELECT image, greatest(0, least(255, floor(v * 256.0))) * (1 / 256.0) AS level, count(*) AS n FROM b GROUP BY ALL),
    c AS (SELECT image, level, sum(n) OVER w AS w, sum(n * level) OVER w AS m, sum(n) OVER (PARTITION BY image) AS tw, sum(n * level) OVER (PARTITION BY image) AS tm FROM h WINDOW w AS (PARTITION BY image ORDER BY level)),
    s AS (SELECT a.image, a.level AS low, b.level AS high, round(a.m * a.m / a.w + (b.m - a.m) * (b.m - a.m) / (b.w - a.w) + (b.tm - b.m) * (b.tm - b.m) / (b.tw - b.w), 6) AS score FROM c a JOIN c b ON a.image = b.image AND a.level < b.level AND b.w < b.tw),
    t AS (SELECT image, arg_max(high, (score, -low, -high)) + 1 / 256.0 AS high FROM s GROUP BY image),
    fg AS MATERIALIZED (SELECT image, y, x FROM b JOIN t USING (image) WHERE v >= high), side AS (SELECT a.i AS dy, b.i AS dx FROM (SELECT unnest(range(-1, 2)) AS i) a, (SELECT unnest(range(-1, 2)) AS i) b WHERE a.i <> 0 OR b.i <> 0),
    lab(image, y, x, label) USING KEY (image, y, x) AS (SELECT image, y, x, y * 4294967296 + x FROM fg
        UNION SELECT f.image, f.y, f.x, min(l.label) FROM lab l, side s JOIN fg f ON f.image = l.image AND f.y = l.y + s.dy AND f.x = l.x + s.dx JOIN recurring.lab r ON r.image = f.image AND r.y = f.y AND r.x = f.x GROUP BY f.image, f.y, f.x, r.label HAVING min(l.label) < r.label),
    o AS (SELECT image, label, count(*) AS area, avg(x) AS cx, avg(y) AS cy FROM lab GROUP BY image, label HAVING round(sqrt(4 * count(*) / pi()), 6) BETWEEN 2 AND 40)
    SELECT image, dense_rank() OVER (ORDER BY concat(image, '.tiff')) AS ImageNumber, row_number() OVER (PARTITION BY image ORDER BY label) AS ObjectNumber, area AS AreaShape_Area, round(cx, 6) AS AreaShape_Center_X, round(cy, 6) AS AreaShape_Center_Y FROM o""")
def measured_objects(spark, d):
    """A pipeline file run over written images, what it measures named and numbered as in measurement files."""
    folder = new_folder(spark, "pipeline")
    with open(path := os.path.join(folder, "objects.cppipe"), "w", encoding="utf-8") as f:
        f.write(PIPELINE)
    held = spark.read.format("tiff_tiles").option("path", _written(spark, d)).option("tile", 32).load().filter(F.col("channel") == 0)
    run = segmentation.run_pipeline(spark, path, {"Dark": stored(measured.image_pixels(held))}, ["image_id"])
    table_of = measured.measured(run.exports["Oil_Nuclei"], ["image_id"])
    return table_of.select(_number(F.col("image_id")).alias("image"), "ImageNumber", "ObjectNumber", "AreaShape_Area", "AreaShape_Center_X", "AreaShape_Center_Y")


@query(f"""WITH {PICTURE_CTE}, {CIRCLES_CTE}, bg AS (SELECT image, quantile_cont(CAST(v AS DOUBLE), 0.95) AS b FROM pic GROUP BY image),
    od AS (SELECT object_id, round(sum({OD_SQL.format(v='CAST(v AS DOUBLE)', b='b')}), 6) AS True_IOD, count(*) AS n FROM ci JOIN pic ON ci.image = pic.image AND (pic.x - cx) * (pic.x - cx) + (pic.y - cy) * (pic.y - cy) <= r * r JOIN bg ON bg.image = pic.image GROUP BY object_id),
    every AS (SELECT ci.image, ci.object_id, coalesce(True_IOD, 0) AS True_IOD, CAST(coalesce(n, 0) AS BIGINT) AS PixelCount, b AS Background_I0 FROM ci JOIN bg ON bg.image = ci.image LEFT JOIN od ON od.object_id = ci.object_id),
    rk AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY True_IOD, object_id) AS rn, count(*) OVER (PARTITION BY image) AS total FROM every)
    SELECT image, object_id, True_IOD, PixelCount, Background_I0, CASE WHEN total <= 10 OR floor(total * 5.0 / 100) = 0 OR (rn > floor(total * 5.0 / 100) AND rn <= total - floor(total * 5.0 / 100)) THEN 'Yes' ELSE 'No' END AS QC_Passed FROM rk""")
def measured_density(spark, d):
    """Nuclei of many images out of one measurement file, placed by file name: density and quality control image by image."""
    pictures, path, p = _written(spark, d), f"{new_folder(spark, 'tables')}/nuclei.csv", F.col("p_partkey")
    rows = table(spark, d, "part").select(p.alias("ObjectNumber"), (p % 64 + 0.7).alias("AreaShape_Center_X"), ((p * 7) % 100 - 0.5).alias("AreaShape_Center_Y"), (F.col("p_size") * 2.0).alias("AreaShape_Area"), F.concat((p % _pictures_of(spark, d)).cast("string"), F.lit(".tiff")).alias("FileName"))
    files.write_measurements(rows, path, single_file=True)
    nuclei = measured.placed(files.nuclei(spark, path, keep=["FileName"]), "FileName", files.listing(spark, pictures)).withColumn("object_id", F.col("ObjectNumber").cast("long"))
    held = spark.read.format("tiff_tiles").option("path", pictures).option("tile", 32).load().filter(F.col("channel") == 0)
    found = measured.image_density(held, nuclei, 32)
    return found.select(_number(F.col("image_id")).alias("image"), "object_id", "True_IOD", "PixelCount", "Background_I0", "QC_Passed")
