from pyspark.sql import functions as F

from lumetra.operators import planning, ranking, report
from lumetra.plans import pipelines
from lumetra.sources import files
from lumetra.streaming import incremental


def test_skip_existing_three_ways(spark):
    have = spark.createDataFrame([("/o/a_green.ome.tiff", 1000), ("/o/b_green.ome.tiff", 1001)], "path string, length long")
    want = spark.createDataFrame([("/i/a.btf",), ("/i/b.btf",), ("/i/c.btf",)], "path string")
    out = F.concat(F.lit("/o/"), F.regexp_extract("path", r"/i/(.)", 1), F.lit("_green.ome.tiff"))
    assert [r[0] for r in planning.missing_outputs(want, out, have).collect()] == ["/i/c.btf"]
    assert sorted(r[0] for r in planning.missing_outputs(want, out, have, least_bytes=1000).collect()) == ["/i/a.btf", "/i/c.btf"]
    mixed = planning.with_kind(spark.createDataFrame([("/i/p_raw.ome.btf",), ("/i/q.vsi",), ("/i/r.VSI",), ("/i/z.Btf",)], "path string"))
    done = spark.createDataFrame([("/o/p_raw_green.ome.tiff",), ("/o/q_green.ome.tiff",)], "path string")
    assert sorted(r["sample"] for r in planning.missing_samples(mixed, done).collect()) == ["r"]
    assert sorted(r["sample"] for r in planning.missing_samples(mixed, done, compat=True).collect()) == ["p", "r"]
    assert planning.only_kinds(mixed, True, True).count() == 0


def test_success_and_rates(spark):
    row = spark.range(1).select(planning.succeeded(F.lit(1), F.lit(1001)), planning.succeeded(F.lit(1), F.lit(1000)), planning.succeeded(F.lit(0), F.lit(None)), planning.succeeded(F.lit(1), F.lit(5000), by_output=False), planning.per_minute(F.lit(6), F.lit(0.0)), planning.compression_ratio(F.lit(8.0), F.lit(0.0))).first()
    assert list(row) == [True, False, True, False, 0.0, None]


def test_series_report(spark):
    text = ["junk", "Series #0 -- a", " Width = 10", " Height = 20", "Series #1", "Width = 7", "Height = x"]
    got = planning.series_of(spark.createDataFrame(list(enumerate(text)), "n int, line string"), "n", "line").orderBy("series").collect()
    assert [tuple(r) for r in got] == [(0, 10, 20), (1, 7, None)]
    assert planning.series_of(spark.createDataFrame([], "n int, line string"), "n", "line").count() == 0


def test_ranks_and_previews(spark):
    rows = spark.createDataFrame([(i * 7 % 101, "a" if i % 3 else "b") for i in range(101)], "v int, k string")
    ranked = {r["v"]: r["rank"] for r in ranking.global_rank(rows, ["v"]).collect()}
    assert ranked == {v: v + 1 for v in range(101)}
    shown = ranking.first_per_kind(rows, "k", ["v"], 10).collect()
    assert len(shown) == 20 and {r["more"] for r in shown} == {24, 57}
    assert ranking.global_rank(rows.filter("false"), ["v"]).count() == 0


def test_reports(spark):
    rows = spark.createDataFrame([("x", None), ("x", 1)], "c string, v int")
    assert {tuple(r) for r in report.category_counts(rows, "c").collect()} == {("x", 2), ("TOTAL", 2)}
    assert report.manifest(rows, rows.select("c")).count() == 4


def test_listing_and_csv(spark, tmp_path):
    for name in ("a.btf", "b.BTF", "c.Btf", "d e.vsi"):
        (tmp_path / name).write_bytes(b"x" * 5)
    (tmp_path / "_temp").mkdir()
    (tmp_path / "_temp" / "f.vsi").write_bytes(b"")
    found = files.listing(spark, [str(tmp_path), str(tmp_path / "_temp")], "*.{btf,BTF,vsi,VSI}")
    assert sorted((r["path"].rsplit("/", 1)[1], r["length"]) for r in found.collect()) == [("a.btf", 5), ("b.BTF", 5), ("d e.vsi", 5), ("f.vsi", 0)]
    csv = tmp_path / "n.csv"
    csv.write_text("ObjectNumber,AreaShape_Center_X,AreaShape_Center_Y,AreaShape_Area\n1,3.7,-0.5,30\n2,NaN,,x\n")
    rows = files.nuclei(spark, str(csv), "Intensity").orderBy("ObjectNumber").collect()
    assert rows[0]["AreaShape_Center_X"] == 3.7 and rows[0]["IntegratedIntensity"] == "N/A" and rows[1]["AreaShape_Area"] is None


def test_pipeline_settings(spark, tmp_path):
    path = tmp_path / "p.txt"
    path.write_text("Version:5\n\nImages:[module_num:1|enabled:True]\n    Filter?:Images only\n    Rule:and (x: y)\n\nMath:[module_num:2]\n    Operation:Invert\n")
    got = [tuple(r) for r in pipelines.settings(spark, str(path)).orderBy("module_num", "key").collect()]
    assert got == [(1, "Images", "Filter?", "Images only"), (1, "Images", "Rule", "and (x: y)"), (2, "Math", "Operation", "Invert")]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.btf").write_bytes(b"1")
    run = lambda: incremental.write_increments(incremental.new_files(files.stream_listing(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    (tmp_path / "in" / "b.vsi").write_bytes(b"2")
    run()
    assert sorted(r["kind"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["btf", "vsi"]
