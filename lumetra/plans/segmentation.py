"""Pipeline files run as chains of the library's operators.

A file's modules are compiled in their order: names of images and objects are
wired from one to the next and checked before anything runs; a module or a
setting that has no operator is refused by name. The result holds the images,
the objects (labelled pixels) and the measurements, all lazily where they can
be.

Images are given by the names that the file assigns: DataFrames of keys, y, x
and v, v from 0 to 1.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import flooding, images, report, segments
from ..sources.files import write_measurements
from ..sources.scratch import stored
from .pipelines import numbered_settings

#: Levels of intensity that objects are parted and grown by, bins of thresholds.
LEVELS, BINS, WINDOW_BINS = 1000, 256, 64


class PipelineError(ValueError):
    """A file that cannot be run as it stands."""


@dataclass
class Module:
    number: int
    name: str
    settings: dict[str, str]

    def get(self, key: str, default: str | None = None) -> str:
        value = self.settings.get(key, default)
        if value is None:
            raise PipelineError(f"module {self.number} {self.name}: no setting '{key}'")
        return value

    def one_of(self, key: str, *allowed: str, default: str | None = None) -> str:
        value = self.get(key, default)
        if value not in allowed:
            raise PipelineError(f"module {self.number} {self.name}: '{key}' is '{value}', of which only {', '.join(allowed)} can be run")
        return value

    def yes(self, key: str) -> bool:
        return self.one_of(key, "Yes", "No", default="No") == "Yes"

    def numbers(self, key: str, default: str | None = None) -> list[float]:
        return [float(x) for x in self.get(key, default).split(",")]


@dataclass
class Run:
    """What the modules have made so far."""

    keys: list[str]
    images: dict[str, DataFrame] = field(default_factory=dict)
    objects: dict[str, DataFrame] = field(default_factory=dict)
    measurements: dict[str, DataFrame] = field(default_factory=dict)
    exports: dict[str, DataFrame] = field(default_factory=dict)


def modules_of(spark: SparkSession, path: str) -> list[Module]:
    """The modules of one file, a small configuration; of settings told twice the first counts."""
    out: dict[int, Module] = {}
    for r in numbered_settings(spark, path).orderBy("at").collect():
        out.setdefault(r["module_num"], Module(r["module_num"], r["module"], {})).settings.setdefault(r["key"], r["value"])
    return list(out.values())


# --- modules ----------------------------------------------------------------------------------


def over(thresholds: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """Thresholds at the upper ends of their bins: what lies in a bin is not above it."""
    return thresholds.withColumns({c: F.col(c) + 1.0 / bins for c in columns})


def foreground(run: Run, module: Module, pixels: DataFrame) -> DataFrame:
    """keys, y, x, v of the pixels that reach the threshold that the settings tell."""
    keys, (low, high) = run.keys, module.numbers("Lower and upper bounds on threshold", "0.0,1.0")
    module.one_of("Thresholding method", "Otsu")
    three = module.one_of("Two-class or three-class thresholding?", "Two classes", "Three classes") == "Three classes"
    column = "low" if three and module.one_of("Assign pixels in the middle intensity class to the foreground or the background?", "Foreground", "Background") == "Foreground" else "high" if three else "threshold"
    module.one_of("Log transform before thresholding?", "No", default="No")
    factor, scale = float(module.get("Threshold correction factor", "1.0")), float(module.get("Threshold smoothing scale", "0.0"))
    if module.one_of("Threshold strategy", "Global", "Adaptive") == "Adaptive":
        if not three:
            raise PipelineError(f"module {module.number} {module.name}: adaptive thresholds of two classes have no operator")
        window = int(module.get("Size of adaptive window"))
        marks = images.window_thresholds(pixels, "v", window, WINDOW_BINS, 0.0, 1.0, 1.0, keys)
        marks = images.corrected(over(marks, ["low", "high"], WINDOW_BINS), ["low", "high"], factor)
        level = images.threshold_surface(pixels, images.corrected(marks, ["low", "high"], 1.0, low, high), window, keys)
        on = [*keys, "y", "x"]
    else:
        level, on = images.corrected(over(images.otsu(images.histogram(pixels, "v", keys, BINS), 3 if three else 2, keys), [column], BINS), [column], factor, low, high), keys
    # the scale is where a Gaussian has half its area within
    held = images.smoothed(pixels, scale / 0.6744 / 2, keys=keys) if scale > 0 else pixels.select(*keys, "y", "x", "v")
    level = level.select(*on, F.col(column).alias("_level"))
    met = held.hint("merge").join(level, on) if on else held.crossJoin(F.broadcast(level))  # one row without keys
    kept = met.filter("v >= _level").select(*keys, "y", "x", "v")
    if scale <= 0:
        return kept
    # a smoothed value decides, the image's own is kept
    return kept.drop("v").hint("merge").join(pixels.select(*keys, "y", "x", "v"), [*keys, "y", "x"])


def without_holes(run: Run, kept: DataFrame, pixels: DataFrame) -> DataFrame:
    """The foreground and what it encloses: components of the rest that reach no edge of their image."""
    keys = run.keys
    rest = pixels.select(*keys, "y", "x").hint("merge").join(kept.select(*keys, "y", "x"), [*keys, "y", "x"], "left_anti")
    parts = stored(segments.components(rest, keys))
    ends = pixels.groupBy(*keys).agg(F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.min("x").alias("_x0"), F.max("x").alias("_x1"))
    placed = parts.hint("merge").join(ends, keys) if keys else parts.crossJoin(F.broadcast(ends))  # one row without keys
    outer = placed.filter("y = _y0 or y = _y1 or x = _x0 or x = _x1").select(*keys, "object_id").distinct()
    holes = parts.hint("merge").join(outer, [*keys, "object_id"], "left_anti").select(*keys, "y", "x")
    return kept.unionByName(holes.hint("merge").join(pixels.select(*keys, "y", "x", "v"), [*keys, "y", "x"]))


def off_the_border(run: Run, objects: DataFrame, pixels: DataFrame) -> DataFrame:
    """keys, object_id of the objects that touch no edge of their image."""
    keys = run.keys
    ends = pixels.groupBy(*keys).agg(F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.min("x").alias("_x0"), F.max("x").alias("_x1"))
    boxes = objects.groupBy(*keys, "object_id").agg(F.min("y").alias("_a"), F.max("y").alias("_b"), F.min("x").alias("_c"), F.max("x").alias("_d"))
    placed = boxes.hint("merge").join(ends, keys) if keys else boxes.crossJoin(F.broadcast(ends))  # one row without keys
    return placed.filter("_a > _y0 and _b < _y1 and _c > _x0 and _d < _x1").select(*keys, "object_id")


def shapes(run: Run, objects: DataFrame) -> DataFrame:
    """Shape measurements by keys and object_id."""
    named = objects.withColumn("_object", F.struct(*run.keys, "object_id"))
    return images.shape_moments(named, "_object").select("_object.*", "*").drop("_object")


def invert(run: Run, module: Module) -> None:
    module.one_of("Operation", "Invert", "None")
    v = F.col("v") * float(module.get("Multiply the first image by", "1.0"))
    v = 1 - v if module.get("Operation") == "Invert" else v
    v = F.pow(v, F.lit(float(module.get("Raise the power of the result by", "1.0")))) * float(module.get("Multiply the result by", "1.0")) + float(module.get("Add to result", "0.0"))
    v = F.greatest(F.lit(0.0), v) if module.yes("Set values less than 0 equal to 0?") else v
    v = F.least(F.lit(1.0), v) if module.yes("Set values greater than 1 equal to 1?") else v
    run.images[module.get("Name the output image")] = run.images[module.get("Select the first image")].withColumn("v", v)


def primary(run: Run, module: Module) -> None:
    keys, pixels = run.keys, run.images[module.get("Select the input image")]
    least, most = module.numbers("Typical diameter of objects, in pixel units (Min,Max)")
    kept = foreground(run, module, pixels)
    if module.get("Fill holes in identified objects?", "Never") != "Never":
        kept = without_holes(run, kept, pixels)
    kept = stored(kept)
    if module.one_of("Method to distinguish clumped objects", "None", "Intensity") == "None":
        objects = segments.components(kept, keys, 8)
    else:
        module.one_of("Method to draw dividing lines between clumped objects", "Intensity")
        automatic = module.yes("Automatically calculate size of smoothing filter for declumping?")
        width = least / 3.5 if automatic else float(module.get("Size of smoothing filter"))
        near = least / 1.5 if module.yes("Automatically calculate minimum allowed distance between local maxima?") else float(module.get("Suppress local maxima that are closer than this minimum allowed distance"))
        smooth = images.smoothed(kept, width / 2.35, keys=keys) if width > 0 else kept.select(*keys, "y", "x", "v")
        levels = stored(smooth.withColumn("v", F.round(F.col("v") * LEVELS).cast("long")))
        # maxima that touch are one seed
        tops = segments.components(images.local_maxima(levels, max(1, int(near)), keys), keys, 8).withColumnRenamed("object_id", "seed")
        objects = flooding.declumped(levels.hint("merge").join(tops, [*keys, "y", "x"], "left"), keys=keys, most=LEVELS, connectivity=8)
    objects = stored(objects)
    if module.yes("Discard objects outside the diameter range?"):
        fit = images.well_sized(shapes(run, objects), "equivalent_diameter", least, most).select(*keys, "object_id")
        objects = objects.hint("merge").join(fit, [*keys, "object_id"], "left_semi")
    if module.yes("Discard objects touching the border of the image?"):
        objects = objects.hint("merge").join(off_the_border(run, objects, pixels), [*keys, "object_id"], "left_semi")
    run.objects[module.get("Name the primary objects to be identified")] = stored(objects)


def secondary(run: Run, module: Module) -> None:
    keys, pixels = run.keys, run.images[module.get("Select the input image")]
    parents = run.objects[module.get("Select the input objects")]
    seeds = parents.select(*keys, "y", "x", F.col("object_id").alias("seed"))
    method = module.one_of("Select the method to identify the secondary objects", "Propagation", "Distance - N")
    levels = pixels.select(*keys, "y", "x", F.round(F.col("v") * LEVELS).cast("long").alias("v"))
    if method == "Propagation":
        # primary pixels are always in
        mask = foreground(run, module, pixels).select(*keys, "y", "x").unionByName(seeds.select(*keys, "y", "x")).distinct()
        open_ = levels.hint("merge").join(mask, [*keys, "y", "x"], "left_semi").hint("merge").join(seeds, [*keys, "y", "x"], "left")
        grown = flooding.secondary_objects(open_, keys=keys, base=max(1, round(LEVELS * float(module.get("Regularization factor", "0.05")))), weight=1, connectivity=8)
    else:
        grown = flooding.secondary_objects(levels.hint("merge").join(seeds, [*keys, "y", "x"], "left"), keys=keys, base=1, weight=0, limit=int(float(module.get("Number of pixels by which to expand the primary objects"))))
    grown = stored(grown.select(*keys, "y", "x", "object_id"))
    if module.yes("Discard secondary objects touching the border of the image?"):
        grown = stored(grown.hint("merge").join(off_the_border(run, grown, pixels), [*keys, "object_id"], "left_semi"))
        if module.yes("Discard the associated primary objects?"):
            run.objects[module.get("Name the new primary objects")] = stored(report.surviving_parents(parents.hint("merge"), grown, [*keys, "object_id"]))
    run.objects[module.get("Name the objects to be identified")] = grown


def add_measurements(run: Run, name: str, table: DataFrame) -> None:
    held = run.measurements.get(name)
    run.measurements[name] = table if held is None else held.hint("merge").join(table, [*run.keys, "object_id"])


def size_shape(run: Run, module: Module) -> None:
    for name in names_in(module.get("Select object sets to measure")):
        add_measurements(run, name, shapes(run, run.objects[name]))


def intensity(run: Run, module: Module) -> None:
    for image in names_in(module.get("Select images to measure")):
        for name in names_in(module.get("Select objects to measure")):
            met = run.objects[name].hint("merge").join(run.images[image], [*run.keys, "y", "x"]).withColumn("_object", F.struct(*run.keys, "object_id"))
            stats = images.intensity_stats(met, "_object").select("_object.*", *[F.col(c).alias(f"{c}_{image}") for c in ("integrated", "mean", "std", "min", "max")])
            add_measurements(run, name, stats)


def export(run: Run, module: Module) -> None:
    prefix = module.get("Filename prefix", "") if module.yes("Add a prefix to file names?") else ""
    run.exports |= {f"{prefix}{name}": table for name, table in run.measurements.items()}


def names_in(text: str) -> list[str]:
    return [n.strip() for n in text.split(",") if n.strip()]


@dataclass
class Kind:
    """How a module runs, and the settings that name what it takes and makes."""

    work: Callable[[Run, Module], None]
    images: tuple[str, ...] = ()
    objects: tuple[str, ...] = ()
    new_images: tuple[str, ...] = ()
    new_objects: tuple[str, ...] = ()


def _nothing(run: Run, module: Module) -> None:
    return None


KINDS = {
    "Images": Kind(_nothing), "Metadata": Kind(_nothing), "Groups": Kind(_nothing),
    "NamesAndTypes": Kind(_nothing, new_images=("Name to assign these images",)),
    "ImageMath": Kind(invert, ("Select the first image",), new_images=("Name the output image",)),
    "IdentifyPrimaryObjects": Kind(primary, ("Select the input image",), new_objects=("Name the primary objects to be identified",)),
    "IdentifySecondaryObjects": Kind(secondary, ("Select the input image",), ("Select the input objects",), new_objects=("Name the objects to be identified", "Name the new primary objects")),
    "MeasureObjectSizeShape": Kind(size_shape, objects=("Select object sets to measure",)),
    "MeasureObjectIntensity": Kind(intensity, ("Select images to measure",), ("Select objects to measure",)),
    "ExportToSpreadsheet": Kind(export),
}


def checked(modules: list[Module], given: set[str]) -> None:
    """Refuse what cannot be run, and names that nothing before has made."""
    refused = [f"{m.number} {m.name}" for m in modules if m.name not in KINDS]
    if refused:
        raise PipelineError(f"no operator for module {', '.join(refused)}")
    there = {"image": set(), "object": set()}
    for m in modules:
        kind = KINDS[m.name]
        for what, asked in (("image", kind.images), ("object", kind.objects)):
            for name in (n for key in asked for n in names_in(m.get(key))):
                if name not in there[what]:
                    raise PipelineError(f"module {m.number} {m.name} asks for {what} '{name}', which no module before it makes")
        made = {n for key in kind.new_images for n in names_in(m.get(key))}
        if m.name == "NamesAndTypes" and made - given:
            raise PipelineError(f"no image is given for '{', '.join(sorted(made - given))}'")
        there["image"] |= made
        there["object"] |= {n for key in kind.new_objects for n in names_in(m.get(key, ""))}


def run_pipeline(spark: SparkSession, path: str, given: dict[str, DataFrame | Callable[[], DataFrame]], keys: list[str] = (), folder: str | None = None) -> Run:
    """Run a pipeline file over images, which may be given as functions that are called once the file has been checked; with ``folder``, its exports are written there, a file a set of objects."""
    modules = modules_of(spark, path)
    checked(modules, set(given))
    run = Run(list(keys), {name: image() if callable(image) else image for name, image in given.items()})
    for m in modules:
        KINDS[m.name].work(run, m)
    if folder is not None:
        for name, table in run.exports.items():
            write_measurements(table, f"{folder.rstrip('/')}/{name}.csv", [*run.keys, "object_id"], single_file=True)
    return run
