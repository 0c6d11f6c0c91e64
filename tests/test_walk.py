import os

import pytest
from pyspark.sql import functions as F

from lumetra.sources import files, tiles
from lumetra.sources.walk import glob_matches


@pytest.fixture
def tree(tmp_path):
    for name in ("a.btf", "_x/b.BTF", "_x/.h/c.tif", "d e/é.vsi", "d e/empty.btf", "deep/1/2/3/4/5/f.tiff", ".top"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"" if "empty" in name else b"x" * len(name))
    os.symlink(tmp_path / "deep", tmp_path / "_x" / "loop")
    os.symlink(tmp_path / "a.btf", tmp_path / "link.btf")
    (tmp_path / "nothing").mkdir()
    return tmp_path


def walked(root):
    found = {}
    for folder, _, names in os.walk(root):
        found |= {os.path.join(folder, n): os.path.getsize(os.path.join(folder, n)) for n in names}
    return found


def test_every_file_of_a_tree(spark, tree):
    got = {r["path"]: r["length"] for r in files.listing(spark, str(tree)).collect()}
    assert got == walked(tree) and len(got) == 8
    flat = {os.path.basename(r["path"]) for r in files.listing(spark, str(tree), recursive=False).collect()}
    assert flat == {"a.btf", ".top", "link.btf"}
    some = {os.path.basename(r["path"]) for r in files.listing(spark, f"file://{tree}", "*.{btf,BTF}").collect()}
    assert some == {"a.btf", "b.BTF", "empty.btf", "link.btf"}


def test_roots(spark, tree):
    assert files.listing(spark, str(tree / "nothing")).count() == 0
    assert [r["length"] for r in files.listing(spark, str(tree / "a.btf")).collect()] == [5]
    twice = files.listing(spark, [str(tree), str(tree / "_x"), str(tree / "d*")])
    assert twice.count() == 8
    with pytest.raises(FileNotFoundError):
        files.listing(spark, str(tree / "none"))
    when = files.listing(spark, str(tree)).filter("modificationTime > current_timestamp() - interval 1 day").count()
    assert when == 8


def test_many_directories_take_many_tasks(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / f"{i}.tif").write_bytes(b"x")
    found = files.listing(spark, str(tmp_path))
    assert found.count() == 40
    headers = tiles.headers_of(found)
    assert headers.rdd.getNumPartitions() == 40 and headers.filter("error is not null").count() == 40


@pytest.mark.parametrize("pattern,yes,no", [("*.btf", ["a.btf", ".btf"], ["a.btf2", "a.BTF"]), ("s?[ab].{x,yy}", ["s1a.x", "s(b.yy"], ["s1c.x", "sa.x"]), ("[!a]*", ["b", "b\n"], ["a", ""]), ("a+(b)", ["a+(b)"], ["aab"])])
def test_patterns(spark, pattern, yes, no):
    df = spark.createDataFrame([(n, True) for n in yes] + [(n, False) for n in no], "name string, want boolean")
    assert df.filter(glob_matches(F.col("name"), pattern) != F.col("want")).count() == 0
