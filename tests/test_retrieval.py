import math

import pytest
from pyspark.sql import functions as F

from loamsift.functions.vectors import Embedder, cosine, create_embedder, hash_embedding
from loamsift.operators import bm25, dense, fusion, rerank

DOCS = [(1, "The API requires a bearer token"), (2, "Rate limits apply to the API"), (3, "Backups run nightly"), (4, None), (5, "")]


def okapi(docs, query):
    import re

    tok = lambda t: re.sub(r"[^a-z0-9\s]", " ", (t or "").lower()).split()
    d = {k: tok(t) for k, t in docs}
    n, avg = len(d), sum(map(len, d.values())) / len(d)
    df = {}
    for w in d.values():
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in raw.items()}
    return {k: sum(idf.get(t, 0) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in tok(query)) for k, w in d.items()}


def test_bm25_is_okapi_with_zero_scores_filling_up(spark):
    q = spark.createDataFrame([("a", "bearer token API token"), ("b", "nightly"), ("c", "???"), ("d", "unseen")], "qid string, q string")
    got = bm25.topk(spark.createDataFrame(DOCS, "id int, text string"), "id", "text", q, "qid", "q", 4).collect()
    for name, text in (("a", "bearer token API token"), ("b", "nightly"), ("d", "unseen")):
        want = okapi(DOCS, text)
        order = sorted(want, key=lambda k: (-round(want[k], 9), k))[:4]
        rows = sorted((r for r in got if r.qid == name), key=lambda r: r["rank"])
        assert [r.id for r in rows] == order
        assert all(abs(r.score - want[r.id]) < 1e-9 for r in rows)
    assert not [r for r in got if r.qid == "c"]


def test_dense_topk_orders_by_cosine_and_filters(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [0.9, 0.1], "x"), (3, [0.0, 1.0], "y"), (4, None, "x"), (5, [1.0], "x"), (6, [2.0, 0.0], "y"), (7, [0.0, 0.0], "x")], "id int, v array<double>, k string")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "q int, qv array<double>")
    got = [(r.id, r.score) for r in dense.topk(v, "id", "v", q, "q", "qv", 3).orderBy("rank").collect()]
    assert got == [(1, 1.0), (6, 1.0), (2, 0.9939)]
    assert [r.id for r in dense.topk(v, "id", "v", q, "q", "qv", 3, {"k": "y"}).orderBy("rank").collect()] == [6, 3]
    assert dense.topk(v.limit(0), "id", "v", q, "q", "qv", 3).count() == 0


def lists(spark, dense_ids, sparse_ids):
    f = lambda ids: spark.createDataFrame([("q", k, 1.0, i + 1) for i, k in enumerate(ids)], "q string, id string, score double, rank int")
    return f(dense_ids), f(sparse_ids)


def test_fusion_by_rank(spark):
    d, s = lists(spark, "ABC", "BDE")
    got = fusion.rrf(d, s, "q", "id").orderBy("rank").collect()
    assert got[0].id == "B" and abs(got[0].rrf_score - (0.7 / 62 + 0.3 / 61)) < 1e-6
    assert {r.id for r in got} == set("ABCDE")
    assert fusion.rrf(*lists(spark, "AB", "BA"), "q", "id", weight_dense=1, weight_sparse=0).orderBy("rank").first().id == "A"
    assert fusion.rrf(*lists(spark, "AB", "BA"), "q", "id", weight_dense=0, weight_sparse=1).orderBy("rank").first().id == "B"
    with pytest.raises(ValueError):
        fusion.rrf(d, s, "q", "id", k=0)


def candidates(spark, query):
    texts = ["Nothing of it here", "Every upload has a size limit", "Bananas are yellow", "Archives may exceed the limit"]
    return spark.createDataFrame([("q", f"c{i + 1}", query, t, i + 1) for i, t in enumerate(texts)], "q string, id string, question string, content string, rank int")


def test_lexical_reranking(spark):
    rows = rerank.lexical(candidates(spark, "which upload size limit"), "q", "question", "content").orderBy("rank").collect()
    assert rows[0].id in ("c2", "c4") and [r.rerank_score for r in rows][-1] == 0
    # upload, size, limit of four tokens, each once
    assert abs(next(r for r in rows if r.id == "c2").rerank_score - (0.75 + 0.3)) < 1e-9
    blank = rerank.lexical(candidates(spark, " "), "q", "question", "content").orderBy("rank").collect()
    assert [r.id for r in blank] == ["c1", "c2", "c3", "c4"] and all(r.rerank_score == 0 for r in blank)


def test_model_and_judge_reranking_and_the_factory(spark):
    rows = candidates(spark, "x").where("rank <= 3")
    by = rerank.create_reranker("auto", predict=lambda pairs: [{"Nothing of it here": 0.1, "Every upload has a size limit": 0.9, "Bananas are yellow": 0.5}[c] for _, c in pairs])
    assert [r.id for r in by(rows, "q", "question", "content").orderBy("rank").collect()] == ["c2", "c3", "c1"]
    judge = rerank.create_reranker("llm", judge=lambda q, c: "score 7" if c.startswith("Ban") else "none")
    assert [r.id for r in judge(rows, "q", "question", "content").orderBy("rank").collect()] == ["c3", "c1", "c2"]
    assert rerank.create_reranker("cross_encoder") is rerank.lexical
    with pytest.raises(ValueError):
        rerank.create_reranker("other")


def test_embeddings(spark):
    v = hash_embedding("text", 16)
    assert len(v) == 16 and abs(sum(x * x for x in v) - 1) < 1e-9 and v == hash_embedding("text", 16)
    e = Embedder("mock", lambda texts: [[float(len(t)), 1.0] for t in texts], 2)
    df = spark.createDataFrame([("ab",), (None,)], "t string").withColumn("v", e.column("t"))
    assert [r.v for r in df.collect()] == [[2.0, 1.0], None]
    assert create_embedder({"LOCAL_EMBEDDINGS": "false"}).name == "mock"
    assert create_embedder({}).name == "local"
    assert create_embedder({"OPENAI_API_KEY": "sk-abc"}, remote=lambda t: t).name == "remote"
    assert create_embedder({"OPENAI_API_KEY": "sk-or-abc"}, remote=lambda t: t).name == "local"
    c = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(F.round(cosine("a", "b"), 4).alias("c")).collect()
    assert [r.c for r in c] == [0.7071, 0.0, 0.0, 0.0]


def test_reranking_is_limited_or_not(spark):
    rows = candidates(spark, "which upload size limit")
    for k, n in ((2, 2), (0, 4), (None, 4)):
        assert rerank.limited(rerank.lexical, rows, "q", "question", "content", k).count() == n


def test_remote_vectors_come_in_the_order_of_the_texts():
    from loamsift.functions.vectors import by_request

    sizes = []

    def request(texts):
        sizes.append(len(texts))
        return [(i, [float(t)]) for i, t in reversed(list(enumerate(texts)))]

    assert by_request(request, 3, 0)([str(i) for i in range(7)]) == [[float(i)] for i in range(7)] and sizes == [3, 3, 1]


def test_an_index_can_be_stored_and_opened(spark, tmp_path):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["red fox", "blue fox fox", None, "green"])], "id int, t string")
    bm25.SparseIndex.build(df, "id", "t", str(tmp_path / "index"))
    index = bm25.SparseIndex(spark, str(tmp_path / "index"))
    q = spark.createDataFrame([("a", "fox"), ("b", "green")], "qid string, q string")
    got = {(r.qid, r["rank"]): r.id for r in bm25.search(index, "id", q, "qid", "q", 2).collect()}
    assert (index.n, index.avgdl) == (4, 1.5) and got["a", 1] in (0, 1) and got["b", 1] == 3 and len(got) == 4


def test_copies_do_not_crowd_the_best(spark):
    df = spark.createDataFrame([(i, "same text") for i in range(3000)] + [(9000, "same text text")], "id int, t string").repartition(4)
    q = spark.createDataFrame([("a", "text")], "qid string, q string")
    ids = [r.id for r in bm25.topk(df, "id", "t", q, "qid", "q", 3).orderBy("rank").collect()]
    assert set(ids) <= {9000, 0, 1, 2} and len(ids) == 3
