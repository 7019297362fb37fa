import numpy as np
import pytest

from loamsift.llm import knn


def rows_of(x, start=0):
    return [(start + i, [float(e) for e in v]) for i, v in enumerate(np.asarray(x, dtype=np.float32))]


def brute(rows, k, least):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 64 and all(e is not None and np.isfinite(e) for e in v) and any(v):
            ok[i] = np.array(v, dtype=np.float64) / np.linalg.norm(v)
    out = set()
    for i, a in ok.items():
        near = sorted(((-round(float(a @ b), 9), j) for j, b in ok.items() if j != i))[:k]
        out |= {(i, j) for s, j in near if -s >= least}
    return out


def clustered(seed, n=300, noise=0.035):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, 64))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return centres[rng.integers(0, 40, n)] + noise * rng.standard_normal((n, 64))


SCHEMA = "id long, v array<float>"


def test_neighbours_within_the_radius_are_those_of_brute_force(spark):
    rows = rows_of(clustered(1))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.id, r.other) for r in knn.nearest_vectors(df, "id", "v").collect()}
    want = brute(rows, 5, 0.9)
    assert len(got & want) >= 0.995 * len(want) and len(got - want) <= 0.005 * len(want)


def test_a_dense_cluster_is_searched_in_blocks(spark, monkeypatch):
    from loamsift.operators import hamming

    rows = rows_of(np.concatenate([clustered(2, 120), clustered(7, 1, 0) + 0.02 * np.random.default_rng(8).standard_normal((90, 64))]))
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(hamming.near_codes, "__defaults__", (25,))
    got = {(r.id, r.other) for r in knn.nearest_vectors(df, "id", "v").collect()}
    want = brute(rows, 5, 0.9)
    assert len(got & want) >= 0.995 * len(want) and len(got - want) <= 0.005 * len(want)


def test_nulls_zeros_repeats_equal_vectors_and_clashing_columns(spark):
    x = clustered(3, 3, 0)
    base = rows_of(x)
    copies = [(10 + i, base[0][1]) for i in range(9)]
    odd = [(50, None), (51, [0.0] * 64), (52, [1.0] * 3), (53, [float("nan")] * 64), (54, [None] * 64), (0, base[0][1])]
    df = spark.createDataFrame([(*r, 1, "k") for r in base + copies + odd], SCHEMA + ", other int, key string")
    got = sorted((r.id, r["rank"], r.other) for r in knn.nearest_vectors(df, "id", "v").collect() if r.id in (0, 12, 18))
    assert [o for i, _, o in got if i == 0] == [10, 11, 12, 13, 14]
    assert [o for i, _, o in got if i == 12] == [0, 10, 11, 13, 14]
    assert [o for i, _, o in got if i == 18] == [0, 10, 11, 12, 13]
    assert knn.nearest_vectors(df.limit(0), "id", "v").count() == 0


@pytest.mark.parametrize("noise", [0.03, 0.2])
def test_queries_are_answered_at_any_cosine(spark, noise):
    rows = rows_of(clustered(4, 200, noise))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.id, r.other) for r in knn.nearest_of_queries(df, df.where("id % 20 = 0"), "id", "v").collect()}
    want = {p for p in brute(rows, 5, -2) if p[0] % 20 == 0}
    assert len(got) == len(want) == 50 and len(got & want) >= 45


def test_learned_rotations_are_orthogonal_and_stable():
    x = clustered(5)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = knn.learn_rotations(x, 2)
    assert np.allclose(r[:, :64].T @ r[:, :64], np.eye(64)) and np.array_equal(r, knn.learn_rotations(x, 2))
