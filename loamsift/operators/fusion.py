"""Weighted reciprocal rank fusion, and hybrid retrieval made of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rerank import lexical


def rrf(dense: DataFrame, sparse: DataFrame, query_key: str, key: str, k: int = 60, weight_dense: float = 0.7, weight_sparse: float = 0.3) -> DataFrame:
    """(query_key, key, dense_score, sparse_score, rrf_score, rank) of two ranked lists (query_key, key, score, rank).

    Ties keep the order of the dense list, then that of the sparse one. ``k`` must be positive.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    d = dense.select(query_key, key, F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    s = sparse.select(query_key, key, F.col("score").alias("sparse_score"), F.col("rank").alias("sparse_rank"))
    part = lambda w, r: F.coalesce(F.lit(float(w)) / (F.lit(k) + F.col(r)), F.lit(0.0))
    both = d.join(s, [query_key, key], "full_outer").withColumn("raw", part(weight_dense, "dense_rank") + part(weight_sparse, "sparse_rank"))
    w = Window.partitionBy(query_key).orderBy(F.desc("raw"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"))
    return both.withColumn("rank", F.row_number().over(w)).select(query_key, key, "dense_score", "sparse_score", F.round("raw", 6).alias("rrf_score"), "rank")


def hybrid(dense: DataFrame, sparse: DataFrame, chunks: DataFrame, queries: DataFrame, query_key: str, query: str, key: str, content: str, top_k: int = 10, candidate_k: int = 20, rerank: bool = True, **weights: float) -> DataFrame:
    """The best ``top_k`` of each query after fusion of the two lists and, if asked for, lexical reranking of the first ``candidate_k``."""
    fused = rrf(dense.where(F.col("rank") <= candidate_k), sparse.where(F.col("rank") <= candidate_k), query_key, key, **weights)
    if rerank:
        few = fused.where(F.col("rank") <= candidate_k).join(chunks.select(key, content), key).join(queries.select(query_key, query), query_key)
        fused = lexical(few, query_key, query, content)
    return fused.where(F.col("rank") <= top_k)
