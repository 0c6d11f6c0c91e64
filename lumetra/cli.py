"""Command line: ``python -m lumetra.cli iod|segment|verify|extract|batch|plan``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .extract import Options, extract_channel
from .functions.names import extracted_name
from .operators import density, ome, planning, tiled
from .plans import measured, segmentation
from .sources import files, tiles
from .sources.scratch import stored


TILE = 512
#: Columns of the table of densities.
MEASURED = ["ObjectNumber", "AreaShape_Center_X as Center_X", "AreaShape_Center_Y as Center_Y", "AreaShape_Area as Area_pixels", "True_IOD", "Mean_OD", "Max_OD", "Background_I0"]


def iod(spark: SparkSession, args) -> int:
    """Objects of one image, or with a column that tells each object's image of many."""
    if args.image_column:
        return iod_of_images(spark, args)
    found = tiles.paths_of({"path": args.image})
    if len(found) != 1 or not os.path.isfile(found[0]):
        print(f"iod takes one image without --image-column; {args.image} is {len(found)} files" if len(found) != 1 else f"no such image: {args.image}", file=sys.stderr)
        return 2
    image = found[0]
    tiles.register(spark)
    held = spark.read.format("tiff_tiles").option("path", image).option("tile", TILE).option("take", args.channel).load()
    nuclei = files.nuclei(spark, args.nuclei, args.passthrough).withColumn("object_id", F.monotonically_increasing_id()).withColumn("image_id", F.lit(image))
    level = tiled.tile_background(held, args.background_percentile)
    sums = tiled.tile_sums(held, nuclei, level, "object_id", "AreaShape_Center_X", "AreaShape_Center_Y", "AreaShape_Area", TILE).drop("Background_I0", "image_id")
    # the background of one image is one row
    every = nuclei.join(sums, "object_id", "left").fillna(0, ["True_IOD", "Mean_OD", "Max_OD", "PixelCount"]).crossJoin(F.broadcast(level.select(F.col("background").alias("Background_I0"))))
    out = density.trimmed(every, ["True_IOD", "object_id"], percent=args.trim_percent)
    density.summary(out).show(truncate=False)
    names = [*MEASURED, *(["IntegratedIntensity"] if args.passthrough else []), "QC_Passed"]
    files.write_measurements(out.orderBy("True_IOD", "object_id").selectExpr(*names), args.output, single_file=True)
    return 0


def iod_of_images(spark: SparkSession, args) -> int:
    """Every image has its own background and quality control; an object whose image is not there stops the run."""
    tiles.register(spark)
    images = files.listing(spark, args.image).filter(F.lower("path").rlike(tiles.IMAGES))
    rows = files.nuclei(spark, args.nuclei, args.passthrough, keep=[args.image_column])
    # written once, so that an object keeps its number
    nuclei = stored(measured.placed(rows, args.image_column, images).withColumn("object_id", F.monotonically_increasing_id()))
    lost = nuclei.filter("image_id is null").count()
    if lost:
        print(f"{lost} objects of images that are not in {args.image}", file=sys.stderr)
        return 2
    held = spark.read.format("tiff_tiles").option("path", args.image).option("tile", TILE).option("take", args.channel).load()
    out = measured.image_density(held, nuclei, TILE, args.background_percentile, args.trim_percent)
    density.summary(out, keys=["image_id"]).orderBy("image_id").show(truncate=False)
    names = ["image_id", *MEASURED, *(["IntegratedIntensity"] if args.passthrough else []), "QC_Passed"]
    files.write_measurements(out.orderBy("image_id", "True_IOD", "object_id").selectExpr(*names), args.output, single_file=True)
    return 0


def segment(spark: SparkSession, args) -> int:
    """Run a pipeline file over one channel of images; a measurement file a set of objects, as ``iod`` reads them."""
    tiles.register(spark)
    named = [n for m in segmentation.modules_of(spark, args.pipeline) if m.name == "NamesAndTypes" for n in segmentation.names_in(m.get("Name to assign these images"))]
    if len(named) != 1:
        print(f"{args.pipeline} names {len(named)} images, of which segment gives one", file=sys.stderr)
        return 2
    held = spark.read.format("tiff_tiles").option("path", args.images).option("tile", TILE).option("take", args.channel).load()
    try:
        run = segmentation.run_pipeline(spark, args.pipeline, {named[0]: lambda: stored(measured.image_pixels(held))}, ["image_id"])
    except segmentation.PipelineError as error:
        print(error, file=sys.stderr)
        return 2
    for name, table in run.exports.items():
        files.write_measurements(measured.measured(table, ["image_id"]), f"{args.output.rstrip('/')}/{name}.csv", ["ImageNumber", "ObjectNumber"], single_file=True)
    return 0


def put_out(rows: DataFrame, path: str | None) -> None:
    """All rows: as CSV to ``path``, else printed as they come, a partition at a time."""
    if path:
        rows.write.mode("overwrite").option("header", True).csv(path)
        return
    print("\t".join(rows.columns))
    for row in rows.toLocalIterator():
        print("\t".join("" if v is None else ",".join(map(str, v)) if isinstance(v, list) else str(v) for v in row))


def headers_below(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Headers of the images at or below a path, listed and opened by tasks."""
    found = files.listing(spark, path, recursive=recursive)
    return tiles.headers_of(found.filter(F.lower("path").rlike(tiles.IMAGES)))


def verify(spark: SparkSession, args) -> int:
    headers = headers_below(spark, args.path, recursive=False)
    told = ome.parse(headers.withColumn("xml", F.coalesce("description", F.lit(""))), "xml")
    # sizes in micrometres out of the header's own resolution
    per_unit = F.when(F.col("resolution_unit") == 3, F.lit(1e4)).when(F.col("resolution_unit") == 2, F.lit(25400.0))
    own = [F.try_divide(per_unit, F.nullif(F.col(f"{a}_resolution"), F.lit(0.0))).cast("string") for a in "xy"]
    state = ome.status(F.col("length").isNotNull(), *own, F.col("physical_size_x"), F.col("physical_size_y"), F.col("error").isNull() & F.col("description").isNotNull())
    result = told.select("path", F.round(F.col("length") / 1024.0 / 1024.0, 1).alias("size_mb"), state.alias("status"), "objective", "magnification", "channels").orderBy("path")
    put_out(result, args.output)
    planning.tally(result, "status").show()
    return 0


def extract(spark: SparkSession, args) -> int:
    headers = headers_below(spark, args.path)
    done = extract_channel(headers, args.output, Options(args.channel, args.level, {"zlib": "deflate"}.get(args.compression, args.compression), args.tile, args.dry_run, None, args.predictor, args.pages))
    put_out(done, args.report)
    return int(done.filter("not success").count() > 0)


def batch(spark: SparkSession, args) -> int:
    """Extract what has no output of more than 1000 bytes yet; every file's outcome, then totals."""
    headers = headers_below(spark, args.path)
    made = F.concat(F.lit(args.output.rstrip("/") + "/"), extracted_name(F.col("path"), F.lit(args.channel)))
    there = files.listing(spark, args.output) if os.path.isdir(args.output) else headers.select("path", "length").limit(0)
    left = planning.missing_outputs(headers, made, there, least_bytes=1000)
    done = extract_channel(left, args.output, Options(args.channel, args.level, {"zlib": "deflate"}.get(args.compression, args.compression), args.tile, args.dry_run, args.seconds, args.predictor, args.pages))
    put_out(done, args.report)
    totals = done.agg(F.count(F.lit(1)).alias("files"), F.count_if("success").alias("succeeded"), F.coalesce(F.sum("duration"), F.lit(0.0)).alias("seconds"))
    totals.select("files", "succeeded", F.round(planning.per_minute(F.col("files"), F.col("seconds")), 2).alias("per_minute")).show()
    return int(done.filter("not success").count() > 0)


def plan(spark: SparkSession, args) -> int:
    found = planning.with_kind(files.listing(spark, args.roots))
    left = planning.missing_outputs(found, F.concat(F.lit(args.output.rstrip("/") + "/"), extracted_name(F.col("path"), F.lit(args.channel))), files.listing(spark, args.output), least_bytes=1000)
    left = planning.only_kinds(left, args.btf_only, args.vsi_only).orderBy("kind", "path")
    put_out(left, args.report)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lumetra")
    sub = parser.add_subparsers(required=True)
    p = sub.add_parser("iod", help="integrated optical density of measured nuclei")
    p.add_argument("image")
    p.add_argument("nuclei")
    p.add_argument("output")
    p.add_argument("--background-percentile", type=float, default=95.0)
    p.add_argument("--trim-percent", type=float, default=5.0)
    p.add_argument("--channel", type=int, default=1, help="of colour images; grey ones are taken as they are")
    p.add_argument("--passthrough")
    p.add_argument("--image-column", help="column of the nuclei that tells each one's image, by path or file name; the image may then be a directory or pattern")
    p.set_defaults(run=iod)
    p = sub.add_parser("segment", help="objects of images by a pipeline file, as measurement files")
    p.add_argument("pipeline")
    p.add_argument("images", help="a file, a directory or a pattern")
    p.add_argument("output")
    p.add_argument("--channel", type=int, default=1, help="of colour images; grey ones are taken as they are")
    p.set_defaults(run=segment)
    p = sub.add_parser("verify", help="metadata of images")
    p.add_argument("path")
    p.add_argument("--output", help="CSV of all rows instead of a printed list")
    p.set_defaults(run=verify)
    p = sub.add_parser("extract", help="one channel of colour images")
    p.add_argument("path")
    p.add_argument("output")
    p.add_argument("--channel", type=int, default=1)
    p.add_argument("--level", type=int, default=6)
    p.add_argument("--tile", type=int, default=512)
    p.add_argument("--predictor", type=int, choices=[1, 2], default=1, help="2: differences along rows")
    p.add_argument("--pages", action="store_true", help="every page of a stack, not the first alone")
    p.add_argument("--compression", choices=["none", "deflate", "zlib", "lzw", "zstd"], default="deflate")
    p.add_argument("--report", help="CSV of all rows instead of a printed list")
    p.add_argument("--dry-run", action="store_true")
    p.set_defaults(run=extract)
    p = sub.add_parser("batch", help="one channel of all images that have no output yet")
    p.add_argument("path")
    p.add_argument("output")
    p.add_argument("--channel", type=int, default=1)
    p.add_argument("--level", type=int, default=6)
    p.add_argument("--tile", type=int, default=512)
    p.add_argument("--predictor", type=int, choices=[1, 2], default=1, help="2: differences along rows")
    p.add_argument("--pages", action="store_true", help="every page of a stack, not the first alone")
    p.add_argument("--compression", choices=["none", "deflate", "zlib", "lzw", "zstd"], default="deflate")
    p.add_argument("--seconds", type=float, help="time that a file may take")
    p.add_argument("--report", help="CSV of all rows instead of a printed list")
    p.add_argument("--dry-run", action="store_true")
    p.set_defaults(run=batch)
    p = sub.add_parser("plan", help="what is left to do")
    p.add_argument("roots", nargs="+")
    p.add_argument("--output", required=True)
    p.add_argument("--channel", type=int, default=1)
    p.add_argument("--report", help="CSV of all rows instead of a printed list")
    p.add_argument("--btf-only", action="store_true")
    p.add_argument("--vsi-only", action="store_true")
    p.set_defaults(run=plan)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("lumetra").getOrCreate()
    return args.run(spark, args)


if __name__ == "__main__":
    sys.exit(main())
