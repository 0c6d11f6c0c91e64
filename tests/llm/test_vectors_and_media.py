import hashlib
import struct
import zlib

import numpy as np
import pytest

from lumetra.llm import matroska, media, sharding, vector_file


def brute_top(rows, k, every):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in kept:
        if q % every == 0:
            scores = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in kept if i != q))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 0.2, (300, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in base[i % 120]]) for i in range(300)]  # many ties
    rows += [(400, None), (420, [1.0, None] + [0.0] * 6), (440, [float("nan")] + [0.0] * 7), (460, [float("inf")] + [0.0] * 7), (None, [0.1] * 8), (480, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "2 as `rank`")
    got = vector_file.top_k(df, k=5, every=20, block_rows=64, query_rows=4)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 5, 20)


def test_top_k_by_rectangles_with_a_third_of_copies(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 0.2, (400, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in (base[1] if i % 3 == 0 else base[i])]) for i in range(400)]
    rows += [(7, rows[7][1])] * 30  # one row many times, which are candidates each
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vector_file.top_k(df, k=4, every=20, block_rows=32, query_rows=3, rows_side=100, queries_side=5)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 4, 20)
    vectors = vector_file.integer_vectors(df).selectExpr("*", "monotonically_increasing_id() as row")
    kept = [r["vec_id"] for r in vector_file.candidates(vectors, 4).collect()]
    assert sorted(i for i in kept if i % 3 == 0 or i == 1) == [0, 1, 3, 6, 9]  # row 1 is a copy as well
    assert kept.count(7) == 4
    assert "WindowGroupLimit" in vector_file.candidates(vectors, 4)._jdf.queryExecution().executedPlan().toString()


def test_rectangles_are_of_bounded_sides():
    across, down = vector_file.scan_grid(10**8, 5 * 10**6, 12208, vector_file.ROWS_SIDE, vector_file.QUERIES_SIDE)
    assert across * vector_file.ROWS_SIDE >= 10**8 and down * vector_file.QUERIES_SIDE >= 5 * 10**6 and across * down < 10**6
    assert vector_file.scan_grid(500, 25, 1, 1 << 17, 1 << 12) == (1, 1)
    assert vector_file.scan_grid(10**6, 5000, 123, 1 << 17, 1 << 12) == (12, 2)


@pytest.mark.parametrize("held", [3, 1 << 18])
def test_survivors_hold_the_first_k(held):
    rng = np.random.default_rng(5)
    x, q = rng.integers(-40, 40, (900, 8)), rng.integers(-40, 40, (6, 8))
    queries = vector_file.Survivors(np.arange(6) + 1000, np.arange(6), q, 5, held)
    seen = []
    for begin in range(0, 900, 300):
        rows = np.arange(begin, begin + 300)
        cells, low, high = vector_file.quantised(x[rows], 4)
        at = np.arange(8)
        seen += list(queries.meet(rows, rows, low[at, cells].astype(float), high[at, cells].astype(float)))
    seen += list(queries.result())
    pairs = {(a - 1000, b) for t in seen for a, b in zip(t["query_row"].to_pylist(), t["row"].to_pylist(), strict=True)}
    for i in range(6):
        first = sorted((-int(q[i] @ x[j]), j) for j in range(900) if j != i)[:5]
        assert {(i, j) for _, j in first} <= pairs and (i, i) not in pairs
    assert len(seen) > 1 if held == 3 else len(pairs) < 6 * 300


def test_top_k_with_little_or_nothing(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in vector_file.top_k(few, k=5, every=20).collect()] == [(0, 1, 1, 64 * 64 + 128 * 32)]
    assert vector_file.top_k(few.filter("false")).count() == 0
    assert vector_file.top_k(few.filter("vec_id = 1")).count() == 0
    none = spark.createDataFrame([(i, []) for i in range(4)], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in vector_file.top_k(none, k=2).collect()) == [(0, 1, 1, 0), (0, 2, 2, 0)]
    twice = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [2.0]), (2, [3.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in vector_file.top_k(twice, k=3).collect()) == [(0, 1, 2, 64 * 192), (0, 2, 1, 64 * 128), (0, 3, 1, 64 * 128)]


def test_large_components_take_part_or_are_refused(spark):
    rows = [(i, [(i % 3) / 64, 1.0 * i]) for i in range(2, 40)] + [(0, [2.0**56, 0.0]), (1, [-(2.0**57), 0.0])]
    rows = [(i, [min(v[0], 1 / 64) if i > 1 else v[0], v[1]]) for i, v in rows]
    df = spark.createDataFrame([r for r in rows if r[0] != 1], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in vector_file.top_k(df, k=50, every=20).collect()) == brute_top([r for r in rows if r[0] != 1], 50, 20)
    df = spark.createDataFrame([r for r in rows if r[0]], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in vector_file.top_k(df, k=50, every=20).collect()) == brute_top([r for r in rows if r[0]], 50, 20)
    with pytest.raises(Exception, match="does not fit a long"):
        vector_file.top_k(spark.createDataFrame([(0, [2.0**57, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")).collect()


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(0)
    x, q = rng.integers(-40, 40, (2000, 16)), rng.integers(-40, 40, (5, 16))
    cells, low, high = vector_file.quantised(x)
    at = np.arange(16)
    lower, upper = vector_file.cell_bounds(q, low[at, cells].astype(float), high[at, cells].astype(float))
    exact = q @ x.T
    assert (lower <= exact).all() and (exact <= upper).all()
    assert ((upper >= np.sort(lower)[:, -20][:, None]).sum(1) < 200).all()


def test_large_scores_are_exact_or_refused():
    assert vector_file.exact_scores(np.array([[2**31, 1], [3, 4]]), np.array([[2**31 - 1, 1], [5, 6]])).tolist() == [2**31 * (2**31 - 1) + 1, 39]
    with pytest.raises(OverflowError):
        vector_file.exact_scores(np.array([[2**40]]), np.array([[2**40]]))


@pytest.mark.parametrize("n", [64, 512, 576, 4096, 4160, 16384, 16448, 50048])
def test_matroska_round_trip(n):
    data = np.random.default_rng(n).integers(0, 256, n, np.uint8).tobytes()
    made = matroska.mux(data)
    read = matroska.demux(made)
    assert media.track_bytes(made, read) == data and read.doc_type == "matroska"
    assert read.tracks == [{"number": 1, "type": 2, "codec": "A_PCM/INT/LIT", "rate": 8000.0, "channels": 1, "bits": 8}]
    assert [p[1] for p in read.packets] == [i * 64_000_000 for i in range(-(-n // 512))]
    assert [c[2] for c in read.cues] == [c[0] for c in read.clusters] and [c[0] for c in read.cues] == [c[1] for c in read.clusters]


@pytest.mark.parametrize("how,frames", [(matroska.XIPH, [b"a" * 300, b"b" * 255, b"c"]), (matroska.EBML_LACING, [b"a" * 800, b"b" * 500, b"c" * 999, b""]), (matroska.FIXED, [b"ab", b"cd"]), (matroska.NO_LACING, [b"whole"])])
def test_every_lacing(how, frames):
    body = b"\x81" + struct.pack(">hB", -3, how << 1) + matroska.laced(frames, how) + b"".join(frames)
    track, time, flags, spans = matroska.frames_of(body, 0, len(body))
    assert (track, time) == (1, -3) and [body[a : a + n] for a, n in spans] == frames


def test_unknown_sizes_and_groups():
    block = b"\x81\x00\x05\x00frame"
    cluster = matroska.CLUSTER.to_bytes(4, "big") + b"\xff" + matroska.uint(matroska.TIMESTAMP, 7) + matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, block))
    data = matroska.HEADER + matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster + cluster
    read = matroska.demux(data)
    assert [p[1] for p in read.packets] == [12_000_000] * 2 and len(read.clusters) == 2
    with pytest.raises(matroska.MatroskaError):
        matroska.demux(b"RIFF")


def test_media_rows(spark):
    texts = [None, "", "a" * 64, "é" * 40, "same", "same", "x" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'z' as feature", "1 as n_bytes")
    rows = {r["doc_id"]: r for r in media.media_table(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_sha256"] == hashlib.sha256(matroska.mux(payload)).hexdigest() and r["media_bytes"] == len(matroska.mux(payload))
    assert rows[4]["feature"] == rows[5]["feature"] and rows[0]["media_sha256"] == rows[1]["media_sha256"]
    assert media.media_table(df.filter("false")).count() == 0
    packets = media.packet_table(media.media_files(df))
    assert packets.filter("doc_id = 6").count() == 18 and packets.filter("track <> 1").count() == 0 and packets.filter("error is not null").count() == 0
    broken = spark.createDataFrame([(1, bytearray(b"RIFF")), (2, None), (3, bytearray(matroska.mux(b"x" * 64)))], "doc_id long, media binary")
    assert sorted((r["doc_id"], r["error"] is None) for r in media.packet_table(broken).collect()) == [(1, False), (3, True)]


def test_shards(spark):
    texts = [(i, "x" * (i * 37 % 400)) for i in range(500)] + [(None, None), (3, "x" * 5), (3, "x" * 5), (7, "y" * 3000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "0 as shard", "'q' as law")
    rows = sharding.shard_documents(df, 16).collect()
    assert len(rows) == len(texts)
    total = sum(r["size"] for r in rows)
    for s in range(16):
        own = sorted((r for r in rows if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 16) <= 3001
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert order[0] is None and order[1:] == sorted(order[1:])
    null = next(r for r in rows if r["doc_id"] is None)
    assert (null["size"], null["text_crc32"], null["law"], null["grown_shard"]) == (1, 0, "bytes", None)
    assert {r["text_crc32"] for r in rows if r["doc_id"] == 7} == {zlib.crc32(("x" * 259).encode()), zlib.crc32(b"y" * 3000)}
    assert sharding.shard_documents(df.filter("false"), 16).count() == 0


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * i, "keep") for i in range(60)], "doc_id long, text string, source string")
    sharding.write_shards(df, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 60 and back.select("shard").distinct().count() == 4 and set(back.columns) == {"doc_id", "text", "source", "shard"}


def test_written_shards_hold_every_row_once(spark, tmp_path):
    """Rows equal in all that orders them lie on both sides of cuts."""
    rows = [(i // 16, "same text", f"row {i}", {"k": i}) for i in range(48)] + [(None, None, "a", None), (7, "other", "b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, size map<string,int>")
    path = str(tmp_path / "s")
    sharding.write_shards(df, path, 5)
    got = spark.read.parquet(path)
    assert sorted(r["shard"] for r in got.collect()) == sorted(r[2] for r in rows)
    want = {(r["shard"]): 0 for r in sharding.shard_documents(df, 5).collect()}
    assert {r["_shard"] for r in got.select("_shard").distinct().collect()} == set(want)
    counts = sorted(r["count"] for r in got.groupBy("_shard").count().collect())
    assert counts == sorted(r["count"] for r in sharding.shard_documents(df, 5).groupBy("shard").count().collect())


def test_broken_files_say_why(spark):
    """Cut files, flipped bytes, and broken values: never an exception."""
    rng = np.random.default_rng(4)
    whole = matroska.mux(bytes(range(256)) * 8)
    files = [whole[: int(n)] for n in rng.integers(0, len(whole), 150)]
    for _ in range(400):
        data = bytearray(whole)
        for at in rng.integers(0, min(len(data), 400), rng.integers(1, 6)):
            data[at] = rng.integers(0, 256)
        files.append(bytes(data))
    xiph = bytes([0x81, 0, 0, 0x02, 3, 255])  # a laced block that ends inside a size
    files += [bytes([0x81, 0, 0, 0x02]), xiph]
    for data in files[-2:]:
        with pytest.raises(matroska.MatroskaError):
            matroska.frames_of(data, 0, len(data))
    with pytest.raises(matroska.MatroskaError):
        matroska.real(b"abc", 0, 3)
    with pytest.raises(matroska.MatroskaError):
        matroska.name("é".encode(), 0, 2)
    df = spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(files)], "doc_id long, media binary")
    got = media.packet_table(df).collect()
    assert {r["doc_id"] for r in got if r["error"]} and all(r["error"] is not None or r["size"] >= 0 for r in got)
