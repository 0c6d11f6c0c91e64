"""Every registered query of the library with its SQL.

The driver's tables stand in for the domain: line items for labelled pixels
(object: order, intensity: quantity), embeddings for image lines (y: vec_id,
x: place), parts for circles and image descriptions, documents for files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, optics, units
from ..operators import density, flooding, images, ome, planning, ranking, regions, report, segments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- background and density -------------------------------------------------------------------


@query("SELECT quantile_cont(l_quantity, 0.95) AS background FROM lineitem")
def background_percentile(spark, d):
    return density.ranked_percentile(table(spark, d, "lineitem"), "l_quantity")


@query("SELECT round(quantile_cont(value, 0.95), 6) AS background FROM events")
def background_percentile_float(spark, d):
    return density.ranked_percentile(table(spark, d, "events"), "value").select(F.round("background", 6).alias("background"))


@query("SELECT quantile_cont(l_quantity, 0.95) AS background FROM lineitem")
def background_by_histogram(spark, d):
    return density.background(table(spark, d, "lineitem"), "l_quantity")


def _pixels(spark, d, keys=()):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return density.densities(density.with_background(lines, density.background(lines, "l_quantity", list(keys)), list(keys)), "l_quantity")


OD_SQL = "CASE WHEN greatest({v}, 1.0) >= {b} THEN 0.0 ELSE log10({b} / greatest({v}, 1.0)) END"
PIXEL_CTE = f"bg AS (SELECT quantile_cont(l_quantity, 0.95) AS b FROM lineitem), px AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, b, {OD_SQL.format(v='l_quantity', b='b')} AS od FROM lineitem, bg)"


@query(f"WITH {PIXEL_CTE} SELECT l_orderkey, l_linenumber, l_quantity, round(od, 6) AS od FROM px")
def pixel_od(spark, d):
    return _pixels(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", F.round("od", 6).alias("od"))


OBJECT_CTE = f"""{PIXEL_CTE}, ob AS (
    SELECT l_orderkey AS ObjectNumber, round(sum(od), 6) AS True_IOD, round(avg(od), 6) AS Mean_OD, round(max(od), 6) AS Max_OD, count(*) AS PixelCount, any_value(b) AS Background_I0
    FROM px GROUP BY l_orderkey
), rk AS (SELECT *, row_number() OVER (ORDER BY True_IOD, ObjectNumber) AS rn, count(*) OVER () AS n FROM ob), qc AS (
    SELECT *, CASE WHEN n <= 10 OR floor(n * 5.0 / 100) = 0 OR (rn > floor(n * 5.0 / 100) AND rn <= n - floor(n * 5.0 / 100)) THEN 'Yes' ELSE 'No' END AS QC_Passed FROM rk
)"""


def _objects(spark, d):
    objects = density.object_density(_pixels(spark, d), ["l_orderkey"]).withColumnRenamed("l_orderkey", "ObjectNumber").drop("Min_OD")
    return density.trimmed(objects, ["True_IOD", "ObjectNumber"], percent=5.0)


@query(f"WITH {OBJECT_CTE} SELECT ObjectNumber, True_IOD, Mean_OD, Max_OD, CAST(PixelCount AS BIGINT) AS PixelCount, Background_I0, QC_Passed FROM qc")
def iod_by_object_qc(spark, d):
    return _objects(spark, d).drop("rank", "total")


@query(f"""WITH {OBJECT_CTE} SELECT count(*) AS n, round(avg(True_IOD), 6) AS mean, round(stddev_pop(True_IOD), 6) AS std,
    round(CASE WHEN avg(True_IOD) > 0 THEN stddev_pop(True_IOD) / avg(True_IOD) * 100 ELSE 0 END, 6) AS cv, min(True_IOD) AS min, max(True_IOD) AS max FROM qc WHERE QC_Passed = 'Yes'""")
def iod_summary(spark, d):
    return density.summary(_objects(spark, d))


@query(f"""WITH px0 AS (SELECT l_suppkey AS image, l_orderkey AS object, l_quantity - 1 AS v FROM lineitem),
    bg AS (SELECT image, quantile_cont(v, 0.95) AS b FROM px0 GROUP BY image),
    ob AS (SELECT image, object, round(sum({OD_SQL.format(v='v', b='b')}), 6) AS True_IOD, round(any_value(b), 6) AS Background_I0 FROM px0 JOIN bg USING (image) GROUP BY image, object),
    rk AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY True_IOD, object) AS rn, count(*) OVER (PARTITION BY image) AS n FROM ob)
    SELECT image, object, True_IOD, Background_I0, CASE WHEN n <= 10 OR floor(n * 10.0 / 100) = 0 OR (rn > floor(n * 10.0 / 100) AND rn <= n - floor(n * 10.0 / 100)) THEN 'Yes' ELSE 'No' END AS QC_Passed FROM rk""")
def iod_per_image_qc(spark, d):
    px = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("image"), F.col("l_orderkey").alias("object"), (F.col("l_quantity") - 1).alias("v"))
    od = density.densities(density.with_background(*density.dealt(px, density.background(px, "v", ["image"]), ["image"]), ["image"]), "v")
    objects = density.object_density(od, ["image", "object"]).select("image", "object", "True_IOD", F.round("Background_I0", 6).alias("Background_I0"))
    return density.trimmed(objects, ["True_IOD", "object"], ["image"], 10.0).drop("rank", "total")


@query(f"""WITH {PIXEL_CTE}, ob AS (SELECT l_orderkey AS image, l_suppkey AS object, round(sum(od), 6) AS True_IOD FROM px GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (ORDER BY True_IOD, image, object) AS rn, count(*) OVER () AS n FROM ob),
    qc AS (SELECT *, (rn > floor(n * 40.0 / 100) AND rn <= n - floor(n * 40.0 / 100)) AS ok FROM rk)
    SELECT image, object, True_IOD, CASE WHEN object IN (SELECT object FROM qc WHERE ok) THEN 'Yes' ELSE 'No' END AS QC_Passed FROM qc""")
def qc_flag_compat(spark, d):
    objects = density.object_density(_pixels(spark, d).select(F.col("l_orderkey").alias("image"), F.col("l_suppkey").alias("object"), "od", "background"), ["image", "object"]).select("image", "object", "True_IOD")
    return density.flag_by_number(density.trimmed(objects, ["True_IOD", "image", "object"], percent=40.0), "object").select("image", "object", "True_IOD", "QC_Passed")


# --- regions of an image ----------------------------------------------------------------------

IMAGE_CTE = "px AS (SELECT vec_id AS y, CAST(x AS BIGINT) - 1 AS x, floor((CAST(embedding[x] AS DOUBLE) + 0.6) * 200) AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS x FROM embeddings))"
CIRCLE_CTE = "ci AS (SELECT p_partkey AS object_id, CAST(trunc(p_partkey % 64 + 0.7) AS BIGINT) AS cx, CAST(trunc((p_partkey * 7) % 500 - 0.5) AS BIGINT) AS cy, CAST(trunc(sqrt(p_size * 2.0 / pi())) AS BIGINT) AS r FROM part)"


def _image(spark, d):
    return images.array_pixels(table(spark, d, "embeddings"), "vec_id", "embedding", F.floor((F.col("_v").cast("double") + 0.6) * 200).cast("double"))


def _circles(spark, d):
    p = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", (p % 64 + 0.7).alias("cx"), ((p * 7) % 500 - 0.5).alias("cy"), (F.col("p_size") * 2.0).alias("area"))


@query(f"WITH {IMAGE_CTE}, {CIRCLE_CTE} SELECT object_id, CAST(coalesce(sum(v), 0) AS DOUBLE) AS total, CAST(count(v) AS BIGINT) AS n FROM ci LEFT JOIN px ON (px.x - cx) * (px.x - cx) + (px.y - cy) * (px.y - cy) <= r * r GROUP BY object_id")
def circle_region_sum(spark, d):
    sums = regions.region_pixels(_circles(spark, d), _image(spark, d), "p_partkey", "cx", "cy", "area").groupBy("object_id").agg(F.sum("v").alias("total"), F.count("v").alias("n"))
    return regions.with_empty_regions(sums, _circles(spark, d), "p_partkey", ["total", "n"])


@query(f"WITH {IMAGE_CTE}, {CIRCLE_CTE}, bg AS (SELECT quantile_cont(v, 0.95) AS b FROM px) SELECT object_id, round(sum({OD_SQL.format(v='v', b='b')}), 6) AS True_IOD, round(avg({OD_SQL.format(v='v', b='b')}), 6) AS Mean_OD, CAST(count(*) AS BIGINT) AS PixelCount FROM ci JOIN px ON (px.x - cx) * (px.x - cx) + (px.y - cy) * (px.y - cy) <= r * r, bg GROUP BY object_id")
def region_iod(spark, d):
    px = _image(spark, d)
    od = density.densities(density.with_background(regions.region_pixels(_circles(spark, d), px, "p_partkey", "cx", "cy", "area"), density.background(px, "v")), "v")
    return density.object_density(od, ["object_id"]).select("object_id", "True_IOD", "Mean_OD", "PixelCount")


@query("SELECT vec_id, CAST(embedding[2] AS DOUBLE) AS green FROM embeddings")
def channel_extract(spark, d):
    return table(spark, d, "embeddings").select("vec_id", images.extract_channel("embedding", 1).cast("double").alias("green"))


@query(f"WITH {IMAGE_CTE}, ob AS (SELECT y // 8 AS object_id, x, y, v FROM px WHERE v > 120), m AS (SELECT object_id, count(*) AS area, avg(x) AS cx, avg(y) AS cy, var_pop(x) + 1.0 / 12 AS xx, var_pop(y) + 1.0 / 12 AS yy, covar_pop(x, y) AS xy FROM ob GROUP BY object_id), e AS (SELECT *, (xx + yy + sqrt((xx - yy) * (xx - yy) + 4 * xy * xy)) / 2 AS hi, (xx + yy - sqrt((xx - yy) * (xx - yy) + 4 * xy * xy)) / 2 AS lo FROM m) SELECT object_id, CAST(area AS BIGINT) AS area, round(cx, 6) AS center_x, round(cy, 6) AS center_y, round(4 * sqrt(hi), 6) AS major_axis, round(4 * sqrt(greatest(lo, 0.0)), 6) AS minor_axis, round(sqrt(greatest(1 - lo / hi, 0.0)), 6) AS eccentricity, round(sqrt(4 * area / pi()), 6) AS equivalent_diameter FROM e")
def shape_moments(spark, d):
    objects = _image(spark, d).filter("v > 120").withColumn("object_id", F.floor(F.col("y") / 8).cast("long"))
    return images.shape_moments(objects, "object_id")


@query(f"WITH {IMAGE_CTE} SELECT y AS object_id, sum(v) AS integrated, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min, max(v) AS max FROM px GROUP BY y")
def intensity_stats(spark, d):
    return images.intensity_stats(_image(spark, d).withColumnRenamed("y", "object_id"), "object_id")


@query(f"WITH {IMAGE_CTE} SELECT y, x, round(least(1.0, greatest(0.0, 1 - v / 255.0)), 6) AS inverted FROM px")
def invert_image(spark, d):
    return _image(spark, d).select("y", "x", F.round(optics.inverted(F.col("v")), 6).alias("inverted"))


@query("WITH h AS (SELECT l_quantity AS level, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT level, sum(n) OVER (ORDER BY level) AS w, sum(n * level) OVER (ORDER BY level) AS m, sum(n) OVER () AS tw, sum(n * level) OVER () AS tm FROM h) SELECT level AS threshold FROM c WHERE w < tw ORDER BY round(m * m / w + (tm - m) * (tm - m) / (tw - w), 6) DESC, level LIMIT 1")
def otsu_threshold(spark, d):
    return images.otsu(images.histogram(table(spark, d, "lineitem"), "l_quantity"), 2)


@query("WITH h AS (SELECT l_quantity AS level, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT level, sum(n) OVER (ORDER BY level) AS w, sum(n * level) OVER (ORDER BY level) AS m, sum(n) OVER () AS tw, sum(n * level) OVER () AS tm FROM h) SELECT a.level AS low, b.level AS high FROM c a JOIN c b ON a.level < b.level AND b.w < b.tw ORDER BY round(a.m * a.m / a.w + (b.m - a.m) * (b.m - a.m) / (b.w - a.w) + (b.tm - b.m) * (b.tm - b.m) / (b.tw - b.w), 6) DESC, low, high LIMIT 1")
def otsu_three_classes(spark, d):
    return images.otsu(images.histogram(table(spark, d, "lineitem"), "l_quantity"), 3)


@query(f"WITH {IMAGE_CTE}, d AS (SELECT unnest(range(-3, 4)) AS d), top AS (SELECT px.y + a.d AS y, px.x + b.d AS x, max(v) AS t FROM px, d a, d b GROUP BY 1, 2) SELECT px.y, px.x, px.v FROM px JOIN top USING (y, x) WHERE v = t")
def local_maxima(spark, d):
    return images.local_maxima(_image(spark, d), 3)


# --- metadata ---------------------------------------------------------------------------------


def _documents(spark, d):
    """Image descriptions of every kind out of parts: namespaces, preambles, malformed and incomplete ones."""
    k, size = F.col("p_partkey"), F.format_string("%.3f", F.col("p_size") / 100.0)
    bad = F.when(k % 11 == 0, "0").when(k % 13 == 0, "abc").when(k % 17 == 0, "NaN").when(k % 19 == 0, "-1").otherwise(size)
    x = F.when(k % 7 != 0, F.concat(F.lit(' PhysicalSizeX="'), bad, F.lit('"'))).otherwise(F.lit(""))
    unit = F.when(k % 5 == 0, F.lit(' PhysicalSizeXUnit="micron"')).otherwise(F.lit(""))
    ns = F.when(k % 3 == 0, F.lit(' xmlns="http://www.openmicroscopy.org/Schemas/OME/2015-01"')).when(k % 3 == 1, F.lit(' xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06"')).otherwise(F.lit(""))
    second = F.when(k % 2 == 0, F.lit('<Channel ID="1" Name="Green"/>')).otherwise(F.lit('<Channel ID="1"/>'))
    text = F.concat(
        F.when(k % 4 == 0, F.lit("reading series\n")).otherwise(F.lit("")), F.lit("<OME"), ns, F.lit('><Instrument ID="I"><Objective ID="O" Model="'), F.col("p_brand"), F.lit('" NominalMagnification="40"/></Instrument><Image ID="0" Name="n"><Pixels ID="P"'),
        x, unit, F.lit(' PhysicalSizeY="0.25" SizeX="'), F.col("p_size").cast("string"), F.lit('" SizeY="7" SizeC="2" SizeZ="1" SizeT="1" Type="uint8"><Channel ID="0" Name="Red"/>'), second, F.lit("</Pixels></Image></OME>"),
    )
    return table(spark, d, "part").select("p_partkey", text.alias("xml"), bad.alias("bad"), size.alias("size"), "p_size", "p_brand")


PART_XML = """pt AS (SELECT *, CASE WHEN p_partkey % 11 = 0 THEN '0' WHEN p_partkey % 13 = 0 THEN 'abc' WHEN p_partkey % 17 = 0 THEN 'NaN' WHEN p_partkey % 19 = 0 THEN '-1' ELSE printf('%.3f', p_size / 100.0) END AS bad FROM part),
    md AS (SELECT *, CASE WHEN p_partkey % 7 <> 0 THEN bad END AS sx FROM pt), ok AS (SELECT *, coalesce(TRY_CAST(sx AS DOUBLE) > 0 AND NOT isnan(TRY_CAST(sx AS DOUBLE)), false) AS usable FROM md)"""


@query(f"""WITH {PART_XML} SELECT p_partkey, sx AS physical_size_x, '0.25' AS physical_size_y, CASE WHEN sx IS NOT NULL THEN CASE WHEN p_partkey % 5 = 0 THEN 'micron' ELSE 'µm' END END AS unit_x, 'µm' AS unit_y,
    p_brand AS objective, '40' AS magnification, CASE WHEN p_partkey % 2 = 0 THEN 'Red,Green' ELSE 'Red,Unknown' END AS channels, CAST(p_size AS VARCHAR) AS width, '7' AS height, usable AS valid,
    CASE WHEN usable THEN '' ELSE 'Missing or unusable physical pixel size' END AS warnings FROM ok""")
def ome_parse(spark, d):
    found = ome.parse(_documents(spark, d).select("p_partkey", "xml"), "xml")
    return found.select(
        "p_partkey", "physical_size_x", "physical_size_y", "unit_x", "unit_y", "objective", "magnification", F.array_join("channels", ",").alias("channels"),
        F.col("dimensions.width").alias("width"), F.col("dimensions.height").alias("height"), F.col("valid_for_measurement").alias("valid"), F.array_join("warnings", "; ").alias("warnings"),
    )


@query(f"""WITH {PART_XML}, st AS (SELECT CASE WHEN p_partkey % 23 = 0 THEN 'file_not_found' WHEN p_partkey % 3 = 0 AND sx IS NOT NULL THEN CASE WHEN usable THEN 'valid' ELSE 'tiff_only' END
    WHEN p_partkey % 29 = 0 THEN 'cannot_read' WHEN usable THEN 'valid' ELSE 'missing_metadata' END AS status FROM ok) SELECT status, count(*) AS n FROM st GROUP BY status""")
def ome_validate_status(spark, d):
    k = F.col("p_partkey")
    found = ome.parse(_documents(spark, d).select("p_partkey", "xml"), "xml")
    header = lambda c: F.when(k % 3 == 0, F.col(c))
    state = ome.status(k % 23 != 0, header("physical_size_x"), header("physical_size_y"), F.col("physical_size_x"), F.col("physical_size_y"), k % 29 != 0)
    return planning.tally(found.select(state.alias("status")), "status")


@query("SELECT p_partkey, round(CASE WHEN p_partkey % 4 < 3 AND p_size <> 10 THEN 1.0 / ((p_size - 10) * 0.0001) END, 4) AS px_per_cm FROM part")
def resolution_px_per_cm(spark, d):
    unit = F.element_at(F.array(F.lit("µm"), F.lit("um"), F.lit("micron"), F.lit("nm")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.round(ome.resolution((F.col("p_size") - 10).cast("double"), unit), 4).alias("px_per_cm"))


@query("""SELECT p_partkey, '<?xml version="1.0" encoding="UTF-8"?><OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06">' || '<Instrument ID="Instrument:0"><Objective ID="Objective:0:0" Model="' || p_brand || '" NominalMagnification="40"/></Instrument>' ||
    '<Image ID="Image:0" Name="green_channel"><Pixels ID="Pixels:0" DimensionOrder="XYCZT" Type="uint8" SizeX="' || p_size || '" SizeY="' || (p_size + 1) || '" SizeC="1" SizeZ="1" SizeT="1" PhysicalSizeX="0.5" PhysicalSizeXUnit="um"' ||
    CASE WHEN p_partkey % 2 = 0 THEN ' PhysicalSizeY="0.25" PhysicalSizeYUnit="nm"' ELSE '' END || '><Channel ID="Channel:0:0" Name="' || CASE p_partkey % 5 WHEN 0 THEN 'red' WHEN 1 THEN 'green' WHEN 2 THEN 'blue' ELSE 'ch' || (p_partkey % 5) END || '" SamplesPerPixel="1"/></Pixels></Image></OME>' AS xml FROM part""")
def ome_render(spark, d):
    k = F.col("p_partkey")
    y = F.when(k % 2 == 0, F.lit("0.25"))
    return table(spark, d, "part").select("p_partkey", ome.rendered(F.col("p_size"), F.col("p_size") + 1, F.lit("uint8"), F.lit("0.5"), y, F.lit("micron"), F.lit("nm"), names.channel_name(k % 5), F.lit("green_channel"), F.col("p_brand"), F.lit("40")).alias("xml"))


@query("SELECT unit, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 4 < 3 THEN 'um' ELSE 'nm' END AS unit FROM part) GROUP BY unit")
def unit_normalise(spark, d):
    unit = F.element_at(F.array(F.lit("µm"), F.lit("um"), F.lit("micron"), F.lit("nm")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return planning.tally(table(spark, d, "part").select(units.normalised_unit(unit).alias("unit")), "unit")


@query("SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 0.0 ELSE p_size / CAST(p_partkey % 6 AS DOUBLE) END AS x_resolution FROM part")
def rational_resolution(spark, d):
    return table(spark, d, "part").select("p_partkey", units.rational(F.col("p_size"), F.col("p_partkey") % 6).alias("x_resolution"))


# --- names, plans and batches -----------------------------------------------------------------


def _files(spark, d):
    """A listing out of documents: raw stacks, slides and others, some with doubled or missing parts."""
    k = F.col("doc_id")
    end = F.when(k % 4 == 0, "_raw.ome.btf").when(k % 4 == 1, ".vsi").when(k % 4 == 2, ".ome.omega.btf").otherwise(".BTF")
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("/data/"), "source", F.lit("/s "), (k % 700).cast("string"), end).alias("path"), F.col("n_chars").alias("length"))


FILE_CTE = "fl AS (SELECT doc_id, '/data/' || source || '/s ' || (doc_id % 700) || CASE doc_id % 4 WHEN 0 THEN '_raw.ome.btf' WHEN 1 THEN '.vsi' WHEN 2 THEN '.ome.omega.btf' ELSE '.BTF' END AS path, n_chars AS length FROM documents), st AS (SELECT *, regexp_replace(path, '^.*/', '') AS name, regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[^.]*$', '') AS stem FROM fl)"


@query(f"WITH {FILE_CTE} SELECT doc_id, replace(stem, '.ome', '') || '_green.ome.tiff' AS extracted, stem || '_green.ome.tiff' AS from_tiff, stem || '.ome.tiff' AS converted, regexp_replace(name, '(\\.ome)?\\.btf$', '') AS script_stem FROM st")
def output_name(spark, d):
    p = F.col("path")
    return _files(spark, d).select("doc_id", names.extracted_name(p, F.lit(1)).alias("extracted"), names.extracted_tiff_name(p, F.lit(1)).alias("from_tiff"), names.converted_name(p).alias("converted"), names.script_stem(p).alias("script_stem"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'green' WHEN doc_id % 5 = 0 THEN 'red' WHEN doc_id % 3 = 0 THEN 'blue' ELSE 'ch' || (doc_id % 4 + 3) END AS channel FROM documents")
def channel_choice(spark, d):
    k = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", names.channel_name(names.chosen_channel(k % 4 + 3, k % 5 == 0, k % 7 == 0, k % 3 == 0)).alias("channel"))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def skip_existing(spark, d):
    done = table(spark, d, "labels").select(F.concat(F.lit("/out/"), F.col("doc_id").cast("string"), F.lit("_green.ome.tiff")).alias("path"))
    return planning.missing_outputs(table(spark, d, "documents").select("doc_id", "source"), F.concat(F.lit("/out/"), F.col("doc_id").cast("string"), F.lit("_green.ome.tiff")), done)


@query(f"""WITH {FILE_CTE}, ex AS (SELECT DISTINCT 's ' || (doc_id % 700) || CASE WHEN doc_id % 2 = 0 THEN '_raw' ELSE '' END AS key FROM labels),
    ca AS (SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN stem ELSE replace(replace(stem, '.ome', ''), '_raw', '') END AS sample FROM st) SELECT doc_id, sample FROM ca WHERE sample NOT IN (SELECT key FROM ex)""")
def skip_existing_normalised(spark, d):
    k = F.col("doc_id")
    done = table(spark, d, "labels").select(F.concat(F.lit("/out/s "), (k % 700).cast("string"), F.when(k % 2 == 0, "_raw").otherwise(""), F.lit("_green.ome.tiff")).alias("path"))
    return planning.missing_samples(planning.with_kind(_files(spark, d)), done, compat=True).select("doc_id", "sample")


@query("SELECT doc_id FROM documents WHERE n_chars <= 1000")
def skip_existing_min_size(spark, d):
    files = table(spark, d, "documents").select("doc_id", F.concat(F.lit("/out/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("length"))
    return planning.missing_outputs(files, F.col("path"), files, least_bytes=1000).select("doc_id")


@query(f"WITH {FILE_CTE} SELECT DISTINCT CASE WHEN doc_id % 4 = 1 THEN 'vsi' ELSE 'btf' END AS kind, path FROM fl")
def distinct_listing(spark, d):
    files = planning.with_kind(_files(spark, d))
    return planning.of_kind(files, planning.RAW_STACKS).unionByName(planning.of_kind(files, planning.SLIDES)).select("kind", "path")


@query("SELECT lang AS kind, doc_id, nth, greatest(total - 10, 0) AS more FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS nth, count(*) OVER (PARTITION BY lang) AS total FROM documents) WHERE nth <= 10")
def first_ten_per_kind(spark, d):
    return ranking.first_per_kind(table(spark, d, "documents").select(F.col("lang").alias("kind"), "doc_id"), "kind", ["doc_id"], 10)


@query(f"WITH {FILE_CTE} SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN doc_id % 4 = 1 THEN 'vsi' ELSE 'btf' END, path, doc_id) AS position, count(*) OVER () AS total FROM fl")
def progress_index(spark, d):
    files = planning.with_kind(_files(spark, d))
    return ranking.global_rank(files.select("kind", "path", "doc_id"), ["kind", "path", "doc_id"]).select("doc_id", F.col("rank").alias("position"), "total")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_tally(spark, d):
    return planning.tally(table(spark, d, "orders").select(F.col("o_orderstatus").alias("status")), "status")


@query("SELECT o_orderstatus AS status, count(*) AS n, round(count(*) * 60.0 / nullif(sum(o_totalprice), 0), 9) AS per_minute FROM orders GROUP BY 1")
def throughput(spark, d):
    held = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("seconds"))
    return held.select("status", "n", F.round(planning.per_minute(F.col("n"), F.col("seconds")), 9).alias("per_minute"))


@query("SELECT o_orderkey, (o_orderstatus = 'F' OR o_totalprice > 1000) AS by_output, o_orderstatus = 'F' AS by_code FROM orders")
def task_success(spark, d):
    code = F.when(F.col("o_orderstatus") == "F", 0).otherwise(1)
    return table(spark, d, "orders").select("o_orderkey", planning.succeeded(code, F.col("o_totalprice")).alias("by_output"), planning.succeeded(code, F.col("o_totalprice"), by_output=False).alias("by_code"))


@query("SELECT lang AS category, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'TOTAL', count(*) FROM documents")
def category_counts(spark, d):
    return report.category_counts(table(spark, d, "documents").select(F.col("lang").alias("category")), "category")


@query(f"WITH {FILE_CTE} SELECT regexp_replace(path, '/[^/]*$', '') AS directory, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM st GROUP BY 1")
def dir_listing(spark, d):
    p = F.col("path")
    return report.by_directory(_files(spark, d).select(names.directory(p).alias("directory"), names.base_name(p).alias("name")), "directory", "name")


@query("SELECT 'supplier' AS category, s_name AS name, s_nationkey AS nation, NULL AS segment FROM supplier UNION ALL SELECT 'customer', c_name, c_nationkey, c_mktsegment FROM customer")
def union_manifest(spark, d):
    one = table(spark, d, "supplier").select(F.lit("supplier").alias("category"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    two = table(spark, d, "customer").select(F.lit("customer").alias("category"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return report.manifest(one, two)


@query("SELECT b.doc_id AS sample, b.source AS broken, a.lang AS alternative FROM documents b JOIN documents a ON a.doc_id = b.doc_id JOIN labels l ON l.doc_id = a.doc_id WHERE b.n_chars < 1000 AND l.quality = 1")
def alternatives_join(spark, d):
    docs, good = table(spark, d, "documents"), table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("sample"))
    broken = docs.filter("n_chars < 1000").select(F.col("doc_id").alias("sample"), F.col("source").alias("broken"))
    return report.alternatives(broken, docs.select(F.col("doc_id").alias("sample"), F.col("lang").alias("alternative")).join(good, "sample"), "sample")


@query("SELECT doc_id AS sample FROM documents WHERE n_chars < 1000 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def unrecoverable(spark, d):
    broken = table(spark, d, "documents").filter("n_chars < 1000").select(F.col("doc_id").alias("sample"))
    return report.unrecoverable(broken, table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("sample")), "sample")


@query("SELECT coalesce(sum(CASE WHEN n_chars = 0 THEN 1 ELSE 0 END), 0)::BIGINT AS empty, coalesce(sum(CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END), 0)::BIGINT AS done, coalesce(sum(CASE WHEN n_chars > 10000 THEN 1 ELSE 0 END), 0)::BIGINT AS large FROM documents")
def source_health(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").agg(F.count_if(n == 0).alias("empty"), F.count_if(n > 1000).alias("done"), F.count_if(n > 10000).alias("large"))


# --- statistics and formulas ------------------------------------------------------------------

STATS = "SELECT user_id AS image, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS std, round(CASE WHEN avg(value) > 0 THEN stddev_pop(value) / avg(value) * 100 ELSE 0 END, 6) AS cv FROM events GROUP BY 1"


@query(STATS)
def per_image_stats(spark, d):
    return report.measurement_stats(table(spark, d, "events").withColumnRenamed("user_id", "image"), "image", "value")


@query(f"WITH s AS ({STATS}) SELECT * FROM s WHERE n >= 20 AND cv < 100")
def sample_acceptance(spark, d):
    return density.accepted_samples(per_image_stats(spark, d), 20, 100.0)


@query("WITH s AS (SELECT p_brand, avg(p_retailprice) AS iod FROM part GROUP BY 1), st AS (SELECT 'chicken' AS standard, 1.25 AS pg UNION ALL SELECT 'trout', 2.60), ref AS (SELECT avg(p_retailprice) AS iod FROM part WHERE p_size = 1) SELECT p_brand, standard, round(s.iod / ref.iod * pg, 6) AS picograms FROM s, st, ref")
def genome_size(spark, d):
    part = table(spark, d, "part")
    standard = part.filter("p_size = 1").agg(F.avg("p_retailprice").alias("ref"))  # one row
    sizes = spark.createDataFrame(sorted(optics.STANDARDS.items()), "standard string, pg double")  # fixed, two rows
    unknown = part.groupBy("p_brand").agg(F.avg("p_retailprice").alias("iod"))
    joined = unknown.crossJoin(F.broadcast(standard)).crossJoin(F.broadcast(sizes))
    return joined.select("p_brand", "standard", F.round(optics.genome_size(F.col("iod"), F.col("ref"), F.col("pg")), 6).alias("picograms"))


@query("SELECT o_orderkey AS object, round(nucleus / cell, 6) AS nc_ratio FROM (SELECT l_orderkey, sum(l_quantity) AS nucleus FROM lineitem GROUP BY 1) JOIN (SELECT o_orderkey, o_totalprice AS cell FROM orders) ON l_orderkey = o_orderkey")
def nc_ratio(spark, d):
    nuclei = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("object")).agg(F.sum("l_quantity").alias("nucleus_area"))
    cells = table(spark, d, "orders").select(F.col("o_orderkey").alias("object"), F.col("o_totalprice").alias("cell_area"))
    return report.nuclear_ratio(nuclei, cells, ["object"])


@query("SELECT p_partkey, round(p_size * CAST(0.2201 AS DOUBLE) * CAST(0.2201 AS DOUBLE), 6) AS um2 FROM part")
def area_um2(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(optics.area_um2(F.col("p_size"), F.lit(0.2201)), 6).alias("um2"))


@query("SELECT o_orderkey AS cell FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def secondary_objects(spark, d):
    """Cells whose nucleus is there."""
    nuclei = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("cell"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("cell")).join(nuclei, "cell", "left_semi")


@query("SELECT p_partkey, p_size * 100 AS width, p_size * 7 AS height FROM part")
def parse_dims(spark, d):
    text = table(spark, d, "part").select("p_partkey", F.concat((F.col("p_size") * 100).cast("string"), F.lit("x"), (F.col("p_size") * 7).cast("string")).alias("dims"))
    w, h = units.dimensions(F.col("dims"))
    return text.select("p_partkey", w.alias("width"), h.alias("height"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size / 10.0 * 1024 ELSE p_size END AS mb FROM part")
def parse_size(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    text = F.when(k % 2 == 0, F.concat(F.format_string("%.1f", n / 10.0), F.lit("GB"))).otherwise(F.concat(n.cast("string"), F.lit("MB")))
    return table(spark, d, "part").select("p_partkey", units.size_text_mb(text).alias("mb"))


@query("SELECT p_partkey, CAST(2048 AS BIGINT) AS band, CAST(ceil(p_size * 997 / 2048.0) AS BIGINT) AS chunks FROM part")
def chunk_plan(spark, d):
    band, chunks = images.chunk_plan(F.col("p_size") * 997, 2000, 512)
    return table(spark, d, "part").select("p_partkey", band.cast("long").alias("band"), chunks.alias("chunks"))


@query("SELECT p_partkey, round(p_size * 1024.0 / nullif(p_partkey % 9, 0), 6) AS ratio FROM part")
def compression_ratio(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(planning.compression_ratio(F.col("p_size"), F.col("p_partkey") % 9), 6).alias("ratio"))


@query("SELECT doc_id, right(text, 200) AS tail, string_split(text, chr(10))[-1] AS last_line FROM documents")
def tail_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.right("text", F.lit(200)).alias("tail"), names.last_lines(F.col("text"), 1).alias("last_line"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'p_1' END AS plate, CASE WHEN doc_id % 3 = 0 THEN 'B' || lpad(CAST(doc_id % 24 AS VARCHAR), 2, '0') END AS well, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 10 AS VARCHAR) END AS site, CASE WHEN doc_id % 3 = 0 THEN '2' END AS channel_number FROM documents")
def plate_metadata(spark, d):
    k = F.col("doc_id")
    name = F.when(k % 3 == 0, F.concat(F.lit("p_1_B"), F.lpad((k % 24).cast("string"), 2, "0"), F.lit("_s"), (k % 10).cast("string"), F.lit("_w2.tif"))).otherwise(F.lit("other.tif"))
    return table(spark, d, "documents").select("doc_id", *names.plate_fields(name))


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS series, CAST(turn * 10 AS INTEGER) AS width, CAST(turn + 1 AS INTEGER) AS height FROM conversations")
def series_info(spark, d):
    """A report of three lines a turn, read back."""
    t = F.col("turn")
    said = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.array(F.lit("Series #x"), F.concat(F.lit("  Width = "), (t * 10).cast("string")), F.concat(F.lit("  Height = "), (t + 1).cast("string")))).alias("i", "line"))
    return planning.series_of(said.withColumn("at", t * 3 + F.col("i")), "at", "line", ["conv_id"])


@query("SELECT count(*) AS n FROM (SELECT doc_id % 3 AS n_axes, doc_id % 6 AS last FROM documents) WHERE n_axes = 2 AND last IN (3, 4)")
def colour_images(spark, d):
    k = F.col("doc_id")
    shape = F.when(k % 3 == 2, F.array(F.lit(10), F.lit(20), (k % 6).cast("int"))).otherwise(F.array(F.lit(10), (k % 6).cast("int")))
    return table(spark, d, "documents").filter(images.is_colour(shape)).agg(F.count(F.lit(1)).alias("n"))


# --- objects out of images: an image is all embeddings, a line each ---------------------------

#: Foreground, neighbours, and seeds: pixels of the foreground that none within three is above.
OBJECTS_CTE = f"""{IMAGE_CTE}, fg AS MATERIALIZED (SELECT y, x, CAST(v AS BIGINT) AS v FROM px WHERE v > 125), side AS (SELECT * FROM (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) t(dy, dx)),
    square AS (SELECT a.i AS dy, b.i AS dx FROM (SELECT unnest(range(-3, 4)) AS i) a, (SELECT unnest(range(-3, 4)) AS i) b),
    over AS (SELECT DISTINCT o.y + dy AS y, o.x + dx AS x, max(o.v) AS most FROM fg o, square GROUP BY 1, 2),
    seeds AS MATERIALIZED (SELECT fg.y, fg.x, fg.v, fg.y * 4294967296 + fg.x AS seed FROM fg JOIN over USING (y, x) WHERE fg.v = most)"""


def _foreground(spark, d):
    return _image(spark, d).filter("v > 125").select("y", "x", F.col("v").cast("long").alias("v"))


def _seeded(spark, d):
    held = _foreground(spark, d)
    tops = images.local_maxima(held, 3).select("y", "x", (F.shiftleft("y", 32) + F.col("x")).alias("seed"))
    return held.join(tops, ["y", "x"], "left")


@query(f"""WITH RECURSIVE {OBJECTS_CTE}, lab(y, x, label) USING KEY (y, x) AS (
        SELECT y, x, y * 4294967296 + x FROM fg
        UNION SELECT f.y, f.x, min(l.label) FROM lab l, side s JOIN fg f ON f.y = l.y + s.dy AND f.x = l.x + s.dx JOIN recurring.lab r ON r.y = f.y AND r.x = f.x
        GROUP BY f.y, f.x, r.label HAVING min(l.label) < r.label)
    SELECT y, x, CAST(label AS BIGINT) AS object_id FROM lab""")
def pixel_components(spark, d):
    """Objects of a threshold, by tiles far smaller than the image."""
    return segments.components(_foreground(spark, d), tile=32)


def _grown_sql(start: str, on: str, limit: str, result: str) -> str:
    return f"""WITH RECURSIVE {OBJECTS_CTE}, cost(y, x, c) USING KEY (y, x) AS (
        SELECT y, x, CAST({start} AS BIGINT) FROM seeds p
        UNION SELECT f.y, f.x, min({on}) FROM (SELECT k.y, k.x, k.c, g.v FROM cost k JOIN fg g ON g.y = k.y AND g.x = k.x) p, side s JOIN fg f ON f.y = p.y + s.dy AND f.x = p.x + s.dx
        LEFT JOIN recurring.cost r ON r.y = f.y AND r.x = f.x LEFT JOIN seeds z ON z.y = f.y AND z.x = f.x WHERE z.seed IS NULL AND {on} <= {limit}
        GROUP BY f.y, f.x, r.c HAVING r.c IS NULL OR min({on}) < r.c),
    whole AS MATERIALIZED (SELECT y, x, c, v FROM cost JOIN fg USING (y, x)),
    tight AS MATERIALIZED (SELECT f.y, f.x, p.y AS py, p.x AS px FROM whole p, side s JOIN whole f ON f.y = p.y + s.dy AND f.x = p.x + s.dx LEFT JOIN seeds z ON z.y = f.y AND z.x = f.x WHERE z.seed IS NULL AND {on} = f.c),
    own(y, x, seed) USING KEY (y, x) AS (
        SELECT y, x, seed FROM seeds
        UNION SELECT t.y, t.x, min(o.seed) FROM own o JOIN tight t ON t.py = o.y AND t.px = o.x LEFT JOIN recurring.own r ON r.y = t.y AND r.x = t.x GROUP BY t.y, t.x, r.seed HAVING r.seed IS NULL OR min(o.seed) < r.seed)
    SELECT y, x, CAST(seed AS BIGINT) AS object_id{result} FROM own JOIN cost USING (y, x)"""


@query(_grown_sql("(255 - p.v) * 4294967296", "CASE WHEN 255 - f.v > p.c // 4294967296 THEN (255 - f.v) * 4294967296 + 1 ELSE p.c + 1 END", "9223372036854775806", ""))
def declumped_objects(spark, d):
    """Touching objects parted by a flood from their peaks."""
    return flooding.declumped(_seeded(spark, d), tile=32)


@query(_grown_sql("0", "p.c + 2 + 3 * abs(f.v - p.v)", "60", ", CAST(c AS BIGINT) AS cost"))
def grown_objects(spark, d):
    """What lies within a distance of each peak, steps over edges of intensity being longer."""
    return flooding.secondary_objects(_seeded(spark, d), base=2, weight=3, limit=60, tile=32)
