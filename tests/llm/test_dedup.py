import hashlib
import random
import re

import numpy as np
import pytest

from lumetra.llm import exchange, jaccard_join, suffix_array, suffix_dedup, window_dedup
from lumetra.llm.components import components

SPACE = r"[^\x20\x09-\x0D]+"


def brute_windows(docs, width):
    first = {}
    held = [(i, re.findall(SPACE, t or "")) for i, t in docs]
    for i, w in held:
        for j in range(len(w) - width + 1):
            key = tuple(w[j : j + width])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in held:
        gone = set()
        for j in range(len(w) - width + 1):
            if i is not None and first[tuple(w[j : j + width])] < i:
                gone.update(range(j, j + width))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(docs, width):
    first = {}
    held = [(i, (t or "").encode()) for i, t in docs]
    for i, b in held:
        for j in range(len(b) - width + 1):
            if i is not None:
                first[b[j : j + width]] = min(first.get(b[j : j + width], i), i)
    out = []
    for i, b in held:
        gone = bytearray(len(b))
        for j in range(len(b) - width + 1):
            if i is not None and first[b[j : j + width]] < i:
                gone[j : j + width] = b"\1" * width
        spans = sum(1 for j in range(len(b)) if gone[j] and (not j or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=120):
    """Copies, near copies, shared passages, long runs of one word, nulls, ties."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage = words(70)
    docs = []
    for i in range(n):
        kind = rng.randrange(8)
        if kind == 0 and docs:
            text = rng.choice(docs)[1]
        elif kind == 1 and docs:
            w = (rng.choice(docs)[1] or "").split()
            for _ in range(len(w) // 40 + 1):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            text = " ".join(w)
        elif kind == 2:
            text = " \n".join(words(20)) + "\t" + " ".join(passage) + " " + " ".join(words(20))
        elif kind == 3:
            text = "la " * rng.randrange(160)
        else:
            text = " ".join(words(rng.randrange(0, 200)))
        docs.append((i, text))
    docs += [(None, docs[3][1]), (None, None), (n + 1, None), (n + 2, ""), (n + 3, "\n \t"), (5, docs[5][1]), (5, " ".join(passage)), (-4, " ".join(passage)), (n + 4, "A b c d"), (n + 5, "a B c d")]
    rng.shuffle(docs)
    return docs


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_words", "2 as g", "'z' as component_id")


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_equal_brute_force(spark, seed):
    docs = corpus(seed)
    got = window_dedup.remove_repeated_windows(frame(spark, docs), width=50, with_text=True)
    rows = got.collect()
    assert sorted((tuple(r)[:4] for r in rows), key=str) == brute_windows(docs, 50)
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in rows)


@pytest.mark.parametrize("frequent", [2000, 2])
def test_bytes_equal_brute_force(spark, frequent):
    docs = corpus(3)
    got = suffix_dedup.remove_repeated_bytes(frame(spark, docs), 50, frequent=frequent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_bytes(docs, 50)


def test_cleaned_documents(spark):
    docs = [(1, "x" * 30 + "é" * 40), (2, "pre " + "x" * 30 + "é" * 40 + " post"), (3, None), (4, "own"), (2, "pre " + "x" * 30 + "é" * 40 + " post")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'s' as source", "length(text) as n_chars", "5 as _row2")
    out = suffix_dedup.cleaned_documents(df)
    assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in out.filter("doc_id <> 3").collect()) == [(1, docs[0][1], 70), (2, "pre  post", 9), (2, "pre  post", 9), (4, "own", 3)]
    assert out.filter("doc_id = 3").first()["text"] is None


def test_empty_tables(spark):
    none = frame(spark, [(1, "a")]).filter("false")
    assert window_dedup.remove_repeated_windows(none).count() == 0
    assert suffix_dedup.remove_repeated_bytes(none).count() == 0
    assert jaccard_join.near_duplicates(none).count() == 0


def brute_components(docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in docs:
        w = re.findall(SPACE, (t or "").translate(low))
        sets.append((i, frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            (a, p), (b, q) = sets[x], sets[y]
            if a is not None and b is not None and p and q and (100 * len(p & q) >= 75 * len(p | q) or a == b):
                parent[find(x)] = find(y)
    out = []
    for x, (i, p) in enumerate(sets):
        least = None if i is None else i if not p else min(sets[y][0] for y in range(len(sets)) if sets[y][0] is not None and find(y) == find(x))
        out.append((i, len(p), least))
    return sorted(out, key=str)


@pytest.mark.parametrize("small,tile,shingles", [(128, 8, 1 << 20), (2, 8, 1 << 20), (2, 2048, 300)])
def test_components_equal_brute_force(spark, small, tile, shingles, monkeypatch):
    docs = corpus(7, 150)
    assert sum(i == 5 for i, _ in docs) == 3  # several texts of one doc_id are one node
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "TILE_SHINGLES", shingles)
    monkeypatch.setattr(jaccard_join, "SKETCH_BITS", 1 << 12 if shingles == 300 else 1 << 26)
    got = jaccard_join.near_duplicates(frame(spark, docs))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_components(docs)


def test_three_shingles_in_four(spark):
    """Seven and eight words that differ by one at either end share three of four shingles."""
    docs = []
    for i in range(12):
        words = [f"w{i}x{j}" for j in range(9)]
        docs += [(10 * i + 5, " ".join(words[1:8])), (10 * i + 2, " ".join(words[:8])), (10 * i + 7, " ".join(words[1:9]))][: 2 + i % 2]
        docs += [(10 * i + 1, " ".join(words[:7])), (10 * i + 9, " ".join(words[2:8])), (10 * i + 8, " ".join(words[:6]))][: i % 4]
    got = jaccard_join.near_duplicates(frame(spark, docs))
    want = brute_components(docs)
    assert sum(n == 3 and c != i for i, n, c in want) >= 6
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    left = jaccard_join.first_of_each(frame(spark, docs))
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, _, c in want if i == c)


def test_one_of_each(spark):
    docs = [(1, "a b c d e f"), (2, "A b c d e f"), (3, "other words stand in here now"), (3, "other words stand in here now"), (4, None), (5, ""), (None, "a b c d e f")]
    left = jaccard_join.first_of_each(frame(spark, docs)).collect()
    assert sorted(str(r["doc_id"]) for r in left) == ["1", "3", "4", "5", "None"]


def test_pigeonhole_holds():
    """Linked sets agree in at least ``spare`` blocks of a slot they share."""
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(4, 400))
        a = np.unique(rng.integers(0, 2**63, n, np.uint64))
        drop = int(rng.integers(0, len(a) // 4 + 1))
        b = a[drop:]
        if not jaccard_join.linked(a, b):
            continue
        values, bounds = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
        keys, of, slot = jaccard_join.block_keys(values, bounds)
        shared = np.intersect1d(keys[of == 0], keys[of == 1])
        if len(a) == len(b):
            continue
        assert len(shared) >= min(jaccard_join.spare(int(d) >> 1) for d in slot[of == 0])
        assert jaccard_join.sketch_distance(jaccard_join.dense_sketch(a), jaccard_join.dense_sketch(b)) <= len(np.setxor1d(a, b))


def test_bands_cover_linked_sizes():
    edges = jaccard_join.bands()
    for a in range(1, 3000):
        band = np.searchsorted(edges, [a, a * 4 // 3], side="right")
        assert band[1] - band[0] <= 1


@pytest.mark.parametrize("trial", range(12))
def test_suffix_order(trial):
    rng = np.random.default_rng(trial)
    data = rng.integers(97, 97 + trial % 4 + 1, int(rng.integers(1, 2000))).astype(np.uint8)
    if trial % 3 == 0:
        data = np.concatenate([data, data, data[: len(data) // 2]])
    raw, n = data.tobytes(), len(data)
    order = np.concatenate(list(suffix_array.sorted_suffixes(data, most=int(rng.integers(1, 400)))))
    assert sorted(order.tolist()) == list(range(n))
    keys = [raw[i : i + 62].ljust(62, b"\0") for i in order]
    assert all(x <= y for x, y in zip(keys, keys[1:]))
    if n >= 50:
        at = np.arange(n - 49)
        classes = suffix_array.window_classes(data, at, 50, most=150)
        known: dict = {}
        assert all(known.setdefault(raw[i : i + 50], c) == c for i, c in zip(at, classes)) and len(set(known.values())) == len(known)


def test_cover_is_a_difference_cover():
    v, cover = suffix_array.MODULUS, suffix_array.COVER
    assert {(a - b) % v for a in cover for b in cover} == set(range(v))
    with pytest.raises(ValueError):
        suffix_array.shifts(31, (1, 2, 3))


@pytest.mark.parametrize("few,large", [(200_000, 0), (0, 2_000_000), (0, 0), (30, 0)])
def test_components_of_chains_and_stars(spark, few, large, monkeypatch):
    monkeypatch.setattr("lumetra.llm.components.FEW", few)
    monkeypatch.setattr("lumetra.llm.components.LARGE", large)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 160)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    odd = [(1, None), (None, None), (3, 2), (2, 3), (3, 2), (4, 4)]
    assert [tuple(r) for r in components(spark.createDataFrame(odd, "a long, b long")).collect()] == [(3, 2)]


def test_messages_stay_in_proportion_to_the_text():
    """At most one for every 2 KB, with groups that a task can hold."""
    for total in (0, 10**6, 10**9, 10**11, 10**13, 10**14):
        for partitions in (1, 12, 200, 100_000):
            n = exchange.group_count(total, partitions)
            assert 1 <= n and n * n <= max(1, total / exchange.MESSAGE_BYTES) and total / n <= 1 << 29


def test_blobs_round_trip():
    arrays = [np.arange(5), np.zeros(0, np.uint8), np.array([7], "<u4")]
    back = exchange.restored(exchange.compressed(*arrays), "<i8", "u1", "<u4")
    assert all((a == b).all() for a, b in zip(arrays, back))


def test_stages_take_columns_of_any_kind(spark):
    """Map columns, names in use inside, and rows that repeat."""
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, {"a": 1}, 1), (1, text, {"a": 2}, 2), (1, "another text of quite other words here", None, 3), (2, text + " eleven", {"b": 1}, 4), (None, text, None, 5), (None, text, None, 6), (3, None, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _kept map<string,int>, _row int")
    got = jaccard_join.first_of_each(df).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == sorted([(1, text), (1, rows[2][1]), (0, text), (0, text), (3, "")])
    cleaned = suffix_dedup.cleaned_documents(spark.createDataFrame([(i, "x" * 60 + str(i), {"a": i}, i) for i in (1, 2, 2)] + [(None, "x" * 60, None, 0)], df.schema)).collect()
    assert sorted((r["_row"], len(r["text"])) for r in cleaned) == [(0, 60), (1, 61), (2, 1), (2, 1)]
