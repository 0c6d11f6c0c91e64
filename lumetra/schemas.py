"""Explicit schemas of the tables that operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

#: Measured nuclei as exported per object; the numbers arrive as text and are read as doubles.
NUCLEI = T.StructType(
    [
        T.StructField("ImageNumber", T.IntegerType()),
        T.StructField("ObjectNumber", T.StringType()),
        T.StructField("AreaShape_Center_X", T.DoubleType()),
        T.StructField("AreaShape_Center_Y", T.DoubleType()),
        T.StructField("AreaShape_Area", T.DoubleType()),
    ]
)

#: Long form of a small image: one row a pixel. Unsigned 8 bits need a short.
PIXELS = T.StructType([T.StructField("image_id", T.StringType()), T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), T.StructField("v", T.ShortType())])

#: Tiles of large images: one row a tile and channel, values row by row. ``page`` is a page's number in its file, z and t its place in a stack.
TILES = "image_id string, page int, z int, t int, channel int, y0 int, x0 int, h int, w int, dtype string, data array<int>"

#: What an OME document says of its first image; sizes stay text until they are validated.
OME_XML = (
    "Instrument array<struct<Objective array<struct<_ID string, _Model string, _NominalMagnification string>>>>, "
    "Image array<struct<_Name string, Pixels struct<_PhysicalSizeX string, _PhysicalSizeY string, _PhysicalSizeZ string, "
    "_PhysicalSizeXUnit string, _PhysicalSizeYUnit string, _SizeX string, _SizeY string, _SizeC string, _SizeZ string, _SizeT string, _Type string, "
    "Channel array<struct<_ID string, _Name string>>>>>, _corrupt_record string"
)

TASK_RESULT = T.StructType([T.StructField("path", T.StringType()), T.StructField("success", T.BooleanType()), T.StructField("message", T.StringType()), T.StructField("duration", T.DoubleType())])
