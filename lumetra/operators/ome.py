"""OME documents: parsing, validation, rendering.

``from_xml`` does the parsing: it keeps unnamed channels, takes prefixed and
versioned namespaces alike, and leaves malformed text as nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import xml_part
from ..functions.units import normalised_unit, pixels_per_cm, usable_size
from ..schemas import OME_XML

DEFAULT_UNIT = "µm"
#: Namespace of rendered documents (fixed value).
NAMESPACE = "http://www.openmicroscopy.org/Schemas/OME/2016-06"

ICONS = {"valid": "OK", "missing_metadata": "!", "file_not_found": "X", "cannot_read": "X", "tiff_only": "~"}


def parsed(text: Column) -> Column:
    return F.from_xml(xml_part(text), OME_XML, {"ignoreNamespace": "true"})


def parse(documents: DataFrame, text: str) -> DataFrame:
    """Add the fields of the first image of each document, and its warnings."""
    found = documents.withColumn("_ome", parsed(F.col(text)))
    pixels = F.get(F.col("_ome.Image"), F.lit(0)).getField("Pixels")
    # the first objective that tells its magnification, in whatever instrument
    none = F.array().cast("array<struct<_ID:string,_Model:string,_NominalMagnification:string>>")
    objectives = F.flatten(F.transform(F.col("_ome.Instrument"), lambda i: F.coalesce(i.getField("Objective"), none)))
    objective = F.get(F.filter(objectives, lambda o: o.getField("_NominalMagnification").isNotNull()), F.lit(0))
    size = lambda axis: pixels.getField(f"_PhysicalSize{axis}")
    unit = lambda axis: F.when(size(axis).isNotNull(), F.coalesce(pixels.getField(f"_PhysicalSize{axis}Unit"), F.lit(DEFAULT_UNIT)))
    malformed = F.col("_ome._corrupt_record").isNotNull() | F.col("_ome").isNull()
    usable = usable_size(size("X")) & usable_size(size("Y"))
    warnings = F.when(malformed, F.array(F.lit("XML parse error"))).when(~usable, F.array(F.lit("Missing or unusable physical pixel size"))).otherwise(F.array().cast("array<string>"))
    return found.select(
        *[F.col(f"`{c}`") for c in documents.columns],
        size("X").alias("physical_size_x"), size("Y").alias("physical_size_y"), size("Z").alias("physical_size_z"), unit("X").alias("unit_x"), unit("Y").alias("unit_y"),
        objective.getField("_Model").alias("objective"), objective.getField("_NominalMagnification").alias("magnification"),
        F.transform(F.coalesce(pixels.getField("Channel"), F.array().cast("array<struct<_ID:string,_Name:string>>")), lambda c: F.coalesce(c.getField("_Name"), F.lit("Unknown"))).alias("channels"),
        F.struct(*[pixels.getField(f).alias(n) for f, n in (("_SizeX", "width"), ("_SizeY", "height"), ("_SizeC", "channels"), ("_SizeZ", "z_slices"), ("_SizeT", "timepoints"), ("_Type", "type"))]).alias("dimensions"),
        (~malformed & usable).alias("valid_for_measurement"), warnings.alias("warnings"),
    )


def status(exists: Column, tiff_size_x: Column, tiff_size_y: Column, ome_size_x: Column, ome_size_y: Column, has_document: Column) -> Column:
    """One of valid, missing_metadata, file_not_found, cannot_read, tiff_only.

    The header's sizes decide where it has one; else the document's; else nothing could be read.
    """
    told = F.coalesce(tiff_size_x != "", F.lit(False))
    return (
        F.when(~exists, "file_not_found")
        .when(told, F.when(usable_size(tiff_size_x) & usable_size(tiff_size_y), "valid").otherwise("tiff_only"))
        .when(has_document, F.when(usable_size(ome_size_x) & usable_size(ome_size_y), "valid").otherwise("missing_metadata"))
        .otherwise("cannot_read")
    )


def status_icon(state: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ICONS.items() for x in pair])
    return F.coalesce(known[state], F.lit("?"))


#: What to tell of a status (fixed values, as reports have them).
MESSAGES = {"valid": "Ready for analysis", "missing_metadata": "Missing pixel size - measurements will be in pixels only"}


def status_message(state: Column) -> Column:
    """A line for the statuses that have one, else null."""
    return F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])[state]


def _attribute(name: str, value: Column) -> Column:
    escaped = F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    return F.when(value.isNotNull(), F.concat(F.lit(f' {name}="'), escaped, F.lit('"'))).otherwise(F.lit(""))


def rendered(width: Column, height: Column, dtype: Column, size_x: Column, size_y: Column, unit_x: Column, unit_y: Column, channel: Column, image: Column, model: Column | None = None, magnification: Column | None = None) -> Column:
    """A single-channel document. Each axis keeps its own unit, the channel its own name, and the objective stays."""
    none = F.lit(None).cast("string")
    model, magnification = none if model is None else model, none if magnification is None else magnification
    objective = F.when(model.isNotNull() | magnification.isNotNull(), F.concat(F.lit('<Instrument ID="Instrument:0"><Objective ID="Objective:0:0"'), _attribute("Model", model), _attribute("NominalMagnification", magnification), F.lit("/></Instrument>"))).otherwise(F.lit(""))
    return F.concat(
        F.lit(f'<?xml version="1.0" encoding="UTF-8"?><OME xmlns="{NAMESPACE}">'), objective, F.lit('<Image ID="Image:0"'), _attribute("Name", image),
        F.lit('><Pixels ID="Pixels:0" DimensionOrder="XYCZT"'), _attribute("Type", dtype), _attribute("SizeX", width.cast("string")), _attribute("SizeY", height.cast("string")),
        F.lit(' SizeC="1" SizeZ="1" SizeT="1"'), _attribute("PhysicalSizeX", size_x), _attribute("PhysicalSizeXUnit", F.when(size_x.isNotNull(), normalised_unit(unit_x))),
        _attribute("PhysicalSizeY", size_y), _attribute("PhysicalSizeYUnit", F.when(size_y.isNotNull(), normalised_unit(unit_y))),
        F.lit('><Channel ID="Channel:0:0"'), _attribute("Name", channel), F.lit(' SamplesPerPixel="1"/></Pixels></Image></OME>'),
    )


def resolution(size: Column, unit: Column) -> Column:
    return pixels_per_cm(size, unit)
