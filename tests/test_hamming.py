import numpy as np
import pytest

from loamsift.operators.hamming import CHECK, near_bits, near_codes, plan


def vectors(spark, x, ids):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id long, v array<double>")


def clusters(seed, n, d=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 4, d))
    x = centres[rng.integers(0, len(centres), n)] + 0.15 * rng.standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def above(x, y, least):
    return {(i, j) for i, j in zip(*np.nonzero(x @ y.T >= least))}


@pytest.mark.parametrize("group_rows", [400_000, 60])
def test_pairs_within_one_table(spark, group_rows):
    x = clusters(1, 300)
    bits, bands = plan(len(x), 0.9, 0.99999)
    planes = np.random.default_rng(2).standard_normal((16, CHECK + bits * bands))
    got = {(r.a, r.b) for r in near_codes(vectors(spark, x, range(300)), None, "id", "v", planes, len(x), bits, bands, near_bits(0.9), group_rows).collect()}
    true = {(i, j) for i, j in above(x, x, 0.9) if i < j}
    assert true and true <= got and all(a < b for a, b in got)


def test_pairs_of_two_tables_and_a_hot_cluster(spark):
    rng = np.random.default_rng(3)
    one = rng.standard_normal(16)
    x = np.concatenate([clusters(4, 80), one + 0.01 * rng.standard_normal((40, 16))])
    y = np.concatenate([x[:20] + 0.01, one + 0.01 * rng.standard_normal((30, 16))])
    x, y = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
    bits, bands = plan(170, 0.95, 0.99999)
    planes = np.random.default_rng(5).standard_normal((16, CHECK + bits * bands))
    for group_rows in (400_000, 20):
        got = {(r.a, r.b) for r in near_codes(vectors(spark, x, range(120)), vectors(spark, y, range(1000, 1050)), "id", "v", planes, 170, bits, bands, near_bits(0.95), group_rows).collect()}
        assert {(i, j + 1000) for i, j in above(x, y, 0.95)} <= got and all(a < 1000 <= b for a, b in got)


def test_substrings_grow_with_the_rows():
    assert [plan(1 << k, 0.9, 0.98)[0] for k in (10, 13, 20)] == [10, 13, 20]
    assert plan(1 << 20, 0.9, 0.98)[1] > plan(1 << 10, 0.9, 0.98)[1]
