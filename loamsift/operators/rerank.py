"""Rerankers. A reranker takes rows with a query, a content and a ``rank`` and gives them a ``rerank_score`` and a new ``rank``."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rerank_tokens


def lexical_score(query_tokens: str, content_tokens: str) -> Column:
    """Share of the query's tokens found in the content, plus a tenth of how often they stand there; 0 where one has no tokens. Takes columns of tokens."""
    q, c = F.col(query_tokens), F.col(content_tokens)
    covered = F.size(F.filter(q, lambda t: F.array_contains(c, t)))
    often = F.aggregate(q, F.lit(0), lambda n, t: n + F.size(F.filter(c, lambda x: x == t)))
    return F.when((F.size(q) > 0) & (F.size(c) > 0), covered / F.size(q) + 0.1 * often).otherwise(0.0)


def reordered(rows: DataFrame, query_key: str, score: Column) -> DataFrame:
    """Ranks by the score; ties keep the order they came in."""
    w = Window.partitionBy(query_key).orderBy(F.desc("rerank_score"), "before")
    return rows.withColumn("rerank_score", score).withColumnRenamed("rank", "before").withColumn("rank", F.row_number().over(w)).drop("before")


def lexical(rows: DataFrame, query_key: str, query: str, content: str) -> DataFrame:
    # As columns, the tokens are made once a row and not once for each token compared.
    t = rows.withColumn("q__", rerank_tokens(query)).withColumn("c__", rerank_tokens(content))
    return reordered(t, query_key, lexical_score("q__", "c__")).drop("q__", "c__")


def by_model(rows: DataFrame, query_key: str, query: str, content: str, predict: Callable[[list[tuple[str, str]]], list[float]], batch: int = 32) -> DataFrame:
    """A cross-encoder: ``predict`` scores pairs of query and content, a batch at a time."""

    @F.pandas_udf("double")
    def run(q: pd.Series, c: pd.Series) -> pd.Series:
        pairs = list(zip(q.fillna(""), c.fillna("")))
        return pd.Series([float(x) for i in range(0, len(pairs), batch) for x in predict(pairs[i : i + batch])], dtype=float)

    return reordered(rows, query_key, run(query, content))


def by_judge(rows: DataFrame, query_key: str, query: str, content: str, judge: Callable[[str, str], str], most: int = 1500) -> DataFrame:
    """A judge's reply is read as its first whole number; content is cut to ``most`` characters for it."""

    @F.pandas_udf("string")
    def run(q: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([judge(x, y) for x, y in zip(q.fillna(""), c.fillna(""))], dtype=object)

    reply = run(query, F.substring(content, 1, most))
    score = F.coalesce(F.regexp_extract("reply__", r"(\d+)", 1).try_cast("double"), F.lit(0.0))
    return reordered(rows.withColumn("reply__", reply), query_key, score).drop("reply__")


def limited(reranker: Callable[[DataFrame, str, str, str], DataFrame], rows: DataFrame, query_key: str, query: str, content: str, top_k: int | None = 10) -> DataFrame:
    """The best ``top_k`` of each query after reranking; all of them for 0 or None."""
    ranked = reranker(rows, query_key, query, content)
    return ranked.where(F.col("rank") <= top_k) if top_k else ranked


def create_reranker(kind: str = "auto", predict: Callable | None = None, judge: Callable | None = None) -> Callable[[DataFrame, str, str, str], DataFrame]:
    """lexical, cross_encoder, llm, or auto: the cross-encoder where there is one, else lexical. What is missing falls back to lexical."""
    if kind not in ("auto", "lexical", "cross_encoder", "llm"):
        raise ValueError(f"unknown reranker: {kind}")
    if kind in ("auto", "cross_encoder") and predict is not None:
        return lambda rows, query_key, query, content: by_model(rows, query_key, query, content, predict)
    if kind == "llm" and judge is not None:
        return lambda rows, query_key, query, content: by_judge(rows, query_key, query, content, judge)
    return lexical
