import json
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumetra.sources import zarr


def store(path, data, chunks, compressor="zlib", **more):
    """Write an array chunk by chunk; its path."""
    os.makedirs(path)
    told = {"zarr_format": 2, "shape": data.shape, "chunks": chunks, "dtype": data.dtype.str, "order": "C", "fill_value": 7, "filters": None, "compressor": {"id": compressor} if compressor else None} | more
    with open(os.path.join(path, ".zarray"), "w") as f:
        json.dump(told, f)
    for place in np.ndindex(*[-(-n // c) for n, c in zip(data.shape, chunks)]):
        block = np.zeros(chunks, data.dtype)
        part = data[tuple(slice(p * c, (p + 1) * c) for p, c in zip(place, chunks))]
        block[tuple(slice(0, n) for n in part.shape)] = part
        raw = block.tobytes(order=told["order"])
        with open(os.path.join(path, told.get("dimension_separator", ".").join(map(str, place))), "wb") as f:
            f.write(zlib.compress(raw) if compressor == "zlib" else raw)
    return path


def read(spark, path, channel=None, **options):
    zarr.register(spark)
    rows = spark.read.format("zarr_tiles").options(path=str(path), **options).load()
    rows = rows if channel is None else rows.filter(F.col("channel") == channel)
    out = {}
    for r in rows.collect():
        for i, v in enumerate(r["data"]):
            out[r["t"], r["z"], r["channel"], r["y0"] + i // r["w"], r["x0"] + i % r["w"]] = v
    return out


def test_windows_open_only_the_chunks_they_meet(spark, tmp_path):
    data = np.random.default_rng(1).integers(0, 255, (50, 41, 3), np.uint8)
    path = store(str(tmp_path / "g" / "0"), data, (16, 16, 1))
    want = {(0, 0, 1, y, x): data[y, x, 1] for y in range(20, 33) for x in range(5, 18)}
    # every other chunk is broken: opening one would be an error
    for name in os.listdir(path):
        if not name.startswith("."):
            y, x, c = map(int, name.split("."))
            if not (c == 1 and y in (1, 2) and x in (0, 1)):
                (tmp_path / "g" / "0" / name).write_bytes(b"broken")
    assert read(spark, tmp_path / "g", 1, rows="20:33", columns="5:18") == want
    reader = zarr.ZarrReader({"path": str(tmp_path / "g"), "rows": "20:33", "columns": "5:18"})
    list(reader.pushFilters([zarr.EqualTo(("channel",), 1)]))
    assert sum(p.last - p.first for p in reader.partitions()) == 4
    assert read(spark, tmp_path / "g", 1, rows="50:60") == {} and read(spark, tmp_path / "g", 9, rows="20:33") == {}


@pytest.mark.parametrize("shape,chunks,axes", [((9, 11), (4, 5), None), ((2, 9, 11, 3), (1, 4, 5, 3), None), ((2, 3, 2, 5, 6), (1, 1, 2, 4, 4), None), ((6, 5, 3), (4, 4, 2), "xyc")])
def test_axes(spark, tmp_path, shape, chunks, axes):
    data = np.random.default_rng(len(shape)).integers(0, 60000, shape).astype(np.uint16)
    store(str(tmp_path / "a"), data, chunks, None, order="F" if len(shape) == 2 else "C", **({"dimension_separator": "/"} if False else {}))
    names = axes or zarr.AXES[len(shape)]
    want = {}
    for place in np.ndindex(*shape):
        at = dict(zip(names, place))
        want[at.get("t", 0), at.get("z", 0), at.get("c", 0), at["y"], at["x"]] = data[place]
    assert read(spark, tmp_path / "a", **({"axes": axes} if axes else {})) == want


def test_stores(spark, tmp_path):
    data = np.ones((4, 4, 1), np.uint8)
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / ".zgroup").write_text("{}")
    store(str(tmp_path / "g" / "b"), data, (4, 4, 1))
    store(str(tmp_path / "g" / "a"), 2 * data, (4, 4, 1))
    assert set(read(spark, tmp_path / "g").values()) == {2}
    os.remove(tmp_path / "g" / "a" / "0.0.0")  # chunks that are not there
    assert set(read(spark, tmp_path / "g").values()) == {7}
    for odd in ({"compressor": {"id": "blosc"}}, {"filters": [{"id": "delta"}]}):
        with pytest.raises(zarr.ZarrError):
            zarr.Array(store(str(tmp_path / f"odd{len(str(odd))}"), data, (4, 4, 1), **odd))
    with pytest.raises(zarr.ZarrError):
        zarr.array_path(str(tmp_path))
