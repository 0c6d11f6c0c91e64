import pytest
from pyspark.sql import functions as F

from lumetra.functions import names, units
from lumetra.operators import ome

BODY = '<Image ID="0"><Pixels PhysicalSizeX="{x}" PhysicalSizeY="0.5" SizeX="10" SizeY="20" Type="uint8"><Channel Name="Red"/><Channel/></Pixels></Image><Image ID="1"><Pixels PhysicalSizeX="9"/></Image>'


@pytest.mark.parametrize("size,valid", [("0.25", True), ("0", False), ("-1", False), ("abc", False), ("NaN", False), ("Infinity", True)])
@pytest.mark.parametrize("form", ['<OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06">{}</OME>', '<OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2015-01">{}</OME>', "noise\n<OME>{}</OME>", '<?xml version="1.0"?><ome:OME xmlns:ome="x">{}</ome:OME>'])
def test_parse_first_image(spark, size, valid, form):
    row = ome.parse(spark.createDataFrame([(form.format(BODY.format(x=size)),)], "xml string"), "xml").first()
    if form.startswith("<?xml"):  # only the root is prefixed there
        assert row["physical_size_x"] == size
        return
    assert row["physical_size_x"] == size and row["unit_x"] == "µm" and row["channels"] == ["Red", "Unknown"]
    assert row["dimensions"]["width"] == "10" and row["valid_for_measurement"] is valid
    assert bool(row["warnings"]) is not valid


@pytest.mark.parametrize("xml", ["<OME><Image>", "", None, "plain"])
def test_what_is_no_document(spark, xml):
    row = ome.parse(spark.createDataFrame([(xml,)], "xml string"), "xml").first()
    assert row["physical_size_x"] is None and row["channels"] == [] and row["valid_for_measurement"] is False


def test_status_chain(spark):
    cases = [(False, "1", "1", "1", "1", True), (True, "1", "1", None, None, False), (True, "1", None, None, None, False), (True, None, None, "1", "1", True), (True, None, None, "0", "1", True), (True, None, None, None, None, False)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, e boolean, a string, b string, c string, d string, h boolean")
    got = [r[0] for r in rows.orderBy("i").select(ome.status(*[F.col(c) for c in "eabcdh"])).collect()]
    assert got == ["file_not_found", "valid", "tiff_only", "valid", "missing_metadata", "cannot_read"]
    assert spark.range(1).select(ome.status_icon(F.lit("what"))).first()[0] == "?"


def test_rendering_round_trip(spark):
    made = spark.range(1).select(ome.rendered(F.lit(5), F.lit(6), F.lit("uint16"), F.lit("0.5"), F.lit("0.25"), F.lit("micron"), F.lit("nm"), F.lit('a"<&'), F.lit("i"), F.lit("M"), F.lit("40")).alias("xml"))
    row = ome.parse(made, "xml").first()
    assert (row["unit_x"], row["unit_y"], row["objective"], row["channels"]) == ("um", "nm", "M", ['a"<&'])
    plain = ome.parse(spark.range(1).select(ome.rendered(F.lit(5), F.lit(6), F.lit("uint8"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("um"), F.lit("um"), F.lit("g"), F.lit("i")).alias("xml")), "xml").first()
    assert plain["physical_size_x"] is None and plain["objective"] is None


def test_names(spark):
    p = F.col("p")
    rows = spark.createDataFrame([("/a/x.ome.btf",), ("/a/a.omega.btf",), ("/b c/.hidden",), ("x_raw.BTF",), ("s_green.ome.tiff",)], "p string")
    got = rows.select(names.stem(p), names.extracted_name(p, F.lit(1)), names.extracted_tiff_name(p, F.lit(7)), names.script_stem(p), names.raw_sample_key(p), names.output_sample_key(p)).collect()
    assert list(got[0]) == ["x.ome", "x_green.ome.tiff", "x.ome_ch7.ome.tiff", "x", "x", "x.ome"]
    assert got[1][1] == "aga_green.ome.tiff" and got[2][0] == ".hidden" and got[3][4] == "x" and got[4][5] == "s"


def test_units(spark):
    row = spark.range(1).select(
        units.normalised_unit(F.lit("µm")), units.normalised_unit(F.lit("μm")), units.pixels_per_cm(F.lit(0.5), F.lit("um")), units.pixels_per_cm(F.lit(0.0), F.lit("um")), units.pixels_per_cm(F.lit(1.0), F.lit("nm")),
        units.size_text_mb(F.lit("8.8GB")), units.size_text_mb(F.lit("622MB")), units.rational(F.lit(3), F.lit(0)), units.number(F.lit("x")),
    ).first()
    assert list(row) == ["um", "μm", pytest.approx(20000.0), None, None, pytest.approx(9011.2), 622.0, 0.0, None]
