import numpy as np
import pytest

from lumetra.llm import hard_negatives
from lumetra.llm.hard_negatives import bit_planes, block_scores, subset_sums


def brute(rows, every, k, m, low=80, high=100, scale=256):
    kept = [(i, label, [int(np.floor(scale * float(x))) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, own, x in kept:
        if a % every:
            continue
        scored = [(sum(p * q for p, q in zip(x, y)), i, label) for i, label, y in kept if i != a]
        near = sorted((-s, i) for s, i, label in scored if label == own)[:k]
        for s, p in near:
            hard = sorted((-t, i) for t, i, label in scored if label != own and low * -s <= high * t <= high * -s)[:m]
            out += [(a, p, r, i, -s, -t) for r, (t, i) in enumerate(hard, 1)]
    return sorted(out)


def test_tables_and_planes_give_inner_products():
    rng = np.random.default_rng(1)
    a = rng.integers(-300, 300, (7, 24))
    for most in (1, 3, 256, 2**20, 2**40):
        x = rng.integers(-most, most, (50, 24))
        assert (block_scores(a, x) == x @ a.T).all()
    assert subset_sums(a[:1], np.int64)[0, 0b10000101, 0] == a[0, 0] + a[0, 2] + a[0, 7]
    assert bit_planes(np.zeros((3, 8), np.int64)).shape == (1, 1, 3)
    assert block_scores(np.array([[2**61] + [0] * 7]), np.array([[3] + [0] * 7])).tolist() == [[3 * 2**61]]
    with pytest.raises(OverflowError):
        block_scores(np.array([[2**62] + [0] * 7]), np.array([[3] + [0] * 7]))


def test_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(0, 0.3, (260, 11)).astype(np.float32) + np.float32(0.2)
    rows = [(i, int(rng.integers(0, 4)), [float(x) for x in base[i % 90]]) for i in range(260)]  # many ties, across labels
    rows += [(i, i % 3, [0.5] * 11) for i in range(300, 420)]  # a common vector
    rows += [(1000, None, [0.1] * 11), (1010, 1, None), (1020, 1, [None] * 11), (1030, 2, [float("nan")] * 11), (1040, 2, [float("-inf")] * 11), (None, 1, [0.1] * 11)]
    rows += [(20, 1, [0.4] * 11), (21, 1, [0.3] * 11), (21, 1, [0.3] * 11)]  # identifiers repeated
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "1 as row", "2 as score", "3 as `rank`", "4 as vector")
    for sides in ({"rows_side": 64, "anchors_side": 7}, {}):
        got = hard_negatives.hard_negatives(df, every=10, positives=3, negatives=4, **sides)
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, 10, 3, 4)


def test_little_or_nothing(spark):
    schema = "vec_id long, label long, embedding array<double>"
    assert hard_negatives.hard_negatives(spark.createDataFrame([], schema)).count() == 0
    assert hard_negatives.hard_negatives(spark.createDataFrame([(1, 1, [1.0])], schema)).count() == 0
    assert hard_negatives.hard_negatives(spark.createDataFrame([(100, 1, [1.0]), (2, 2, [1.0])], schema)).count() == 0
    empty = spark.createDataFrame([(100, 1, []), (3, 1, []), (2, 2, [])], schema)
    assert [tuple(r) for r in hard_negatives.hard_negatives(empty).collect()] == [(100, 3, 1, 2, 0, 0)]
    with pytest.raises(Exception, match="does not fit a long"):
        hard_negatives.hard_negatives(spark.createDataFrame([(100, 1, [1e300]), (2, 2, [1.0])], schema)).collect()
