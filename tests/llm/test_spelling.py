import random
import re
import zlib
from collections import Counter

from lumetra.llm import spelling

FOLD = str.maketrans(spelling.UPPER, spelling.LOWER)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, noise=199, least_length=6, least_count=5, ratio=5):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= least_length and n >= least_count}
    out, form = {}, {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
        out[w] = [form[w], None, n, len(others), words[form[w]] if form[w] else None]
    for w in words:
        at = w
        while form[at]:
            at = form[at]
        out[w][1] = at
    return sorted((w, *v) for w, v in out.items()), count


def held(spark, rows, **settings):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as word", "2 as n", "'x' as id", "3 as form")
    return sorted((tuple(r) for r in spelling.spelling_forms(df, **settings).collect()), key=lambda r: r[0])


def varied(seed, n_words, letters, n_docs):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(n_words)]

    def edit(w):
        i, c = rng.randrange(len(w) + 1), rng.choice(letters)
        return rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]])

    rows = []
    for d in range(n_docs):
        words = [w if rng.random() < 0.7 else edit(w) for w in (base[int(n_words * rng.random() ** 3)] for _ in range(200))]
        rows.append((d, rng.choice([" ", ", ", "1", "\n"]).join(w.title() if rng.random() < 0.2 else w for w in words)))
    return rows


def test_equals_brute_force(spark):
    rows = [*varied(1, 60, "abÉß", 40), (900, None), (901, ""), (None, "aaaaaaa " * 9), (902, "aaaaaa " * 50 + "A" * 40 + " ×÷×÷×÷ " * 6), (902, "repeated rows " * 5), (902, "repeated rows " * 5)]
    for settings in ({"noise": 7, "least_length": 4, "least_count": 2, "ratio": 2}, {"noise": 199}, {"noise": 0, "least_length": 1, "least_count": 1, "ratio": 3}):
        want, count = brute(rows, **settings)
        assert held(spark, rows, **settings) == want
        assert any(w[1] for w in want) and any(w[3] != w[1] for w in want)
    assert any(w[1] and w[2] != w[1] for w in want)  # a chain of forms


def test_paths_go_on_over_partitions(spark):
    words = [("a" * k) + c for k in range(1, 30) for c in ("", "b", "bé")] + ["a" * 40]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(sorted(words))], "id long, word string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        paths = {r["id"]: r["nodes"] for r in spelling.trie_paths(df, "word").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    node = {}
    for i, w in enumerate(sorted(words)):
        assert len(paths[i]) == len(w)
        for k in range(1, len(w) + 1):
            assert node.setdefault(w[:k], paths[i][k - 1]) == paths[i][k - 1]
    assert len(set(node.values())) == len(node)
    assert len({x >> spelling.NODE_BITS for x in node.values()}) > 1


def test_long_words_and_nothing(spark):
    assert held(spark, []) == [] and held(spark, [(1, None), (2, "12 34")]) == []
    long = "ab" * 4000
    rows = [(1, (long + " ") * 30 + (long + "c ") * 6)]
    assert [(len(w), len(f or ""), n, k) for w, f, _, n, k, _ in held(spark, rows, noise=0)] == [(8000, 0, 30, 1), (8001, 8000, 6, 1)]
