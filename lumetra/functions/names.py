"""File names: stems, output names, sample keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Channel names by index (fixed values).
CHANNELS = {0: "red", 1: "green", 2: "blue"}


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def stem(path: Column) -> Column:
    """Name without its last suffix; a leading dot begins no suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r".(\.[^.]*)$", 1))


def channel_name(index: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in CHANNELS.items() for x in pair])
    return F.coalesce(known[index.cast("int")], F.concat(F.lit("ch"), index.cast("string")))


def chosen_channel(channel: Column, red: Column, green: Column, blue: Column) -> Column:
    """Shortcut flags override the number; green before red before blue."""
    return F.when(green, F.lit(1)).when(red, F.lit(0)).when(blue, F.lit(2)).otherwise(channel)


def extracted_name(path: Column, channel: Column) -> Column:
    """Output of channel extraction from a raw stack: every '.ome' leaves the stem."""
    return F.concat(F.replace(stem(path), F.lit(".ome"), F.lit("")), F.lit("_"), channel_name(channel), F.lit(".ome.tiff"))


def extracted_tiff_name(path: Column, channel: Column) -> Column:
    """Output of channel extraction from a TIFF: the stem stays as it is."""
    return F.concat(stem(path), F.lit("_"), channel_name(channel), F.lit(".ome.tiff"))


def converted_name(path: Column) -> Column:
    """Output of conversion from a proprietary slide."""
    return F.concat(stem(path), F.lit(".ome.tiff"))


def script_stem(path: Column) -> Column:
    """Stem as batch scripts take it: only an ending '.btf' and then an ending '.ome' go."""
    return F.regexp_replace(base_name(path), r"(\.ome)?\.btf$", "")


def raw_sample_key(path: Column) -> Column:
    """Sample of a raw stack: '.ome' and '_raw' leave the stem."""
    return F.replace(F.replace(stem(path), F.lit(".ome"), F.lit("")), F.lit("_raw"), F.lit(""))


def output_sample_key(path: Column) -> Column:
    """Sample of an output: '_green.ome' and '_green' leave the stem."""
    return F.replace(F.replace(stem(path), F.lit("_green.ome"), F.lit("")), F.lit("_green"), F.lit(""))


def xml_part(text: Column) -> Column:
    """A document from its declaration, else from its root element; without either, as it is."""
    declared, root = F.locate("<?xml", text), F.locate("<OME", text)
    return F.when(declared > 0, F.substring(text, declared, F.length(text))).when(root > 0, F.substring(text, root, F.length(text))).otherwise(text)


def lines_without(text: Column, part: str) -> Column:
    """The lines that do not hold a text."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.contains(line, F.lit(part))), "\n")


def stamp(time: Column) -> Column:
    """A time as the log lines of a batch have it."""
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss")


def last_lines(text: Column, n: int) -> Column:
    lines = F.split(text, "\n")
    return F.array_join(F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), F.lit(n)), "\n")


#: Plate, well, site and channel out of a file name (fixed pattern).
PLATE = r"^(.*)_([A-P][0-9]{2})_s([0-9])_w([0-9])"


def plate_fields(name: Column) -> list[Column]:
    return [F.nullif(F.regexp_extract(name, PLATE, i), F.lit("")).alias(c) for i, c in enumerate(("plate", "well", "site", "channel_number"), 1)]


def folder_date(folder: Column) -> Column:
    """The date, as YYYY_MM_DD, that ends a folder's name (fixed pattern)."""
    return F.nullif(F.regexp_extract(folder, r"([0-9]{4}_[0-9]{2}_[0-9]{2})$", 1), F.lit(""))
