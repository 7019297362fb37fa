import random

import numpy as np

from loamsift.operators import dedup, index


def vectors(seed, n=80, dims=16):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((10, dims))
    return [(i, (base[rng.integers(0, 10)] + 0.08 * rng.standard_normal(dims)).tolist()) for i in range(n)]


def greedy(rows, threshold):
    kept, out = [], {}
    for i, v in rows:
        a = np.array(v)
        best = [(round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 4), j) for j, b in kept]
        best = [x for x in best if x[0] > threshold]
        out[i] = not best
        if not best:
            kept.append((i, a))
    return out


def test_greedy_removal_is_that_of_one_by_one_in_any_partitioning(spark):
    rows = vectors(3)
    want = greedy(rows, 0.97)
    for seed in (1, 2):
        shuffled = rows[:]
        random.Random(seed).shuffle(shuffled)
        df = spark.createDataFrame([(i, i, v) for i, v in shuffled], "id int, ord int, v array<double>").repartition(3)
        got = {r.id: r.kept for r in dedup.greedy_duplicates(df, "id", "ord", "v", 16, 0.97).collect()}
        assert got == want
    assert sum(want.values()) < len(want)


def test_a_batch_is_compared_with_the_store_only(spark):
    store = spark.createDataFrame([("s", [1.0, 0.0])], "id string, v array<double>")
    batch = spark.createDataFrame([("a", [1.0, 0.01]), ("b", [0.8, 0.6]), ("c", [0.8, 0.6]), ("n", None)], "id string, v array<double>")
    got = [tuple(r) for r in dedup.filter_duplicates(batch, store, "id", "v", 2).collect()]
    assert got == [("a", "s", 1.0)]


def test_exact_duplicates_and_the_store(spark, tmp_path):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", None), ("d", None)], "id string, t string")
    assert sorted(tuple(r) for r in dedup.exact_duplicates(df, "id", "t").collect()) == [("a", "a", 2), ("b", "a", 2)]
    c = spark.createDataFrame([("d1::chunk::0", "d1", "f.md", "fixed", "t"), ("d1::chunk::1", "d1", "f.md", "semantic", "t"), ("d2::chunk::0", None, "g.md", "fixed", "t")], "chunk_id string, doc_id string, source_file string, chunking_strategy string, content string")
    assert [tuple(r) for r in index.list_documents(c).collect()] == [("d1", "f.md", 2, "fixed,semantic"), ("unknown", "g.md", 1, "fixed")]
    s = index.ChunkStore(spark, str(tmp_path), c.schema)
    assert s.add(c) == 3 and s.add(c) == 0
    assert s.delete("d1") == 2 and s.read().count() == 1 and index.has(s.read(), "chunk_id", "d2::chunk::0")
    s.reset()
    assert s.read().count() == 0
    assert index.sync_status(c, c.limit(0), "chunk_id").first().in_sync is False


def test_a_crash_while_deleting_leaves_one_version(spark, tmp_path):
    c = spark.createDataFrame([("d1::chunk::0", "d1"), ("d2::chunk::0", "d2")], "chunk_id string, doc_id string")
    s = index.ChunkStore(spark, str(tmp_path), c.schema)
    s.add(c)
    # The next version was begun and not written to its end.
    (tmp_path / "chunks-1").mkdir()
    assert s.read().count() == 2
    assert s.delete("d1") == 1 and [r.doc_id for r in s.read().collect()] == ["d2"] and index.count(s.read()) == 1
    assert s.add(c) == 1 and s.read().count() == 2


def test_only_scalars_are_kept(spark):
    df = spark.createDataFrame([("a", None, 1, [1], None)], "id string, t string, n int, l array<int>, b boolean")
    assert [tuple(r) for r in index.sanitize(df).collect()] == [("a", "", 1, None)] and index.sanitize(df).columns == ["id", "t", "n", "b"]


def test_equal_vectors_are_one_in_the_search(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(40)] + [(100, [0.0, 1.0, 0.0]), (101, None), (102, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, i, v) for i, v in rows], "id int, ord int, v array<double>")
    got = {r.id: (r.kept, r.duplicate_of) for r in dedup.greedy_duplicates(df, "id", "ord", "v", 3).collect()}
    assert got[0] == (True, None) and all(got[i] == (False, 0) for i in range(1, 40)) and all(got[i][0] for i in (100, 101, 102))
    assert dedup.similar_pairs(df, df, "id", "v", 3).where("a < b").count() == 40 * 39 // 2
