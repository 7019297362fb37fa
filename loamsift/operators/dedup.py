"""Near-duplicate removal by embedding: sequential and greedy, in the order of arrival, as a fixpoint over the similarity graph."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.layout import spread
from ..functions.tables import written
from ..functions.vectors import cosine
from .hamming import CHECK, near_bits, near_codes, plan

#: The share of the pairs at the threshold that the candidate search must find.
RECALL = 0.99999


def exact_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, first_key, copies): each row with the smallest key of the rows of the same text; NULL texts are nobody's copies."""
    h = df.where(F.col(text).isNotNull()).select(key, F.sha2(F.col(text), 256).alias("h"))
    first = h.groupBy("h").agg(F.min(key).alias("first_key"), F.count("*").alias("copies"))
    return h.join(first, "h").select(key, "first_key", "copies")


def usable(vector: str, dims: int) -> Column:
    return (F.size(vector) == dims) & F.exists(vector, lambda e: e != 0) & ~F.exists(vector, lambda e: e.isNull())


def _classes(df: DataFrame, key: str, vector: str, dims: int, order: str) -> tuple[DataFrame, DataFrame]:
    """Equal vectors as one: (cls, v), and the members (cls, key, ord). Neither NULL nor all-zero vectors are in a class."""
    rows = written(spread(df.where(usable(vector, dims)).select(F.col(key).alias("key"), F.col(order).alias("ord"), F.col(vector).cast("array<double>").alias("v"))).withColumn("cls", F.xxhash64("v")), "vectors")
    return rows.groupBy("cls").agg(F.first("v").alias("v")), rows.select("cls", "key", "ord")


def _close(left: DataFrame, right: DataFrame | None, dims: int, threshold: float, digits: int) -> DataFrame:
    """(a, b, similarity) of classes (cls, v), within ``left`` or of ``left`` with ``right``."""
    n = left.count() + (right.count() if right is not None else 0)
    lowest = max(-1.0, threshold - 0.5 * 10.0**-digits)
    bits, bands = plan(n, lowest, RECALL)
    planes = np.random.default_rng(17).standard_normal((dims, CHECK + bits * bands))
    pairs = near_codes(left, right, "cls", "v", planes, n, bits, bands, near_bits(lowest))
    other = left if right is None else right
    both = pairs.join(left.toDF("a", "va"), "a").join(other.toDF("b", "vb"), "b")
    return both.withColumn("similarity", F.round(cosine("va", "vb"), digits)).where(F.col("similarity") > threshold).select("a", "b", "similarity")


def similar_pairs(left: DataFrame, right: DataFrame, key: str, vector: str, dims: int, threshold: float = 0.95, digits: int = 4) -> DataFrame:
    """(a, b, similarity): pairs of different keys of ``left`` and ``right`` of which the rounded cosine exceeds the threshold.

    Candidates agree in a substring of their sign codes up to one bit; a pair at the threshold is missed with a probability of 1e-5. Equal vectors are searched as one. All pairs come
    out, so the rows are as many as the pairs. NULL, all-zero and other-length vectors are in no pair.
    """
    x, mx = _classes(left, key, vector, dims, key)
    y, my = (x, mx) if left is right else _classes(right, key, vector, dims, key)
    x = written(x, "left")
    if left is right:
        found = written(_close(x, None, dims, threshold, digits), "pairs")
        found = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
        same = x.select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    else:
        y = written(y, "right")
        found = _close(x, y, dims, threshold, digits).where("a <> b")
        same = x.join(y.select("cls"), "cls").select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    every = found.unionByName(same.withColumn("similarity", F.lit(1.0)).where(F.lit(threshold < 1.0)))
    out = every.join(mx.select(F.col("cls").alias("a"), F.col("key").alias("ka")), "a").join(my.select(F.col("cls").alias("b"), F.col("key").alias("kb")), "b")
    return out.where(F.col("ka") != F.col("kb")).select(F.col("ka").alias("a"), F.col("kb").alias("b"), "similarity")


def filter_duplicates(batch: DataFrame, store: DataFrame, key: str, vector: str, dims: int, threshold: float = 0.95) -> DataFrame:
    """(key, duplicate_of, duplicate_similarity) of the batch's rows like one of the store; the batch's rows aren't compared with each other."""
    pairs = similar_pairs(batch, store, key, vector, dims, threshold)
    return pairs.groupBy(F.col("a").alias(key)).agg(F.min_by("b", F.struct(-F.col("similarity"), "b")).alias("duplicate_of"), F.max("similarity").alias("duplicate_similarity"))


def greedy_duplicates(df: DataFrame, key: str, order: str, vector: str, dims: int, threshold: float = 0.95) -> DataFrame:
    """(key, kept, duplicate_of, duplicate_similarity): a row is kept unless a kept row before it is like it.

    Rows are decided in the order of ``order``, which must be unique. Of equal vectors only the first can be kept, so classes are decided; each round decides all classes whose earlier neighbours are decided,
    and is written to the shared folder. Rows that have no usable vector are kept.
    """
    rows = written(df.select(F.col(key).alias("key"), F.col(order).alias("ord"), F.col(vector).alias("v")), "rows")
    classes, members = _classes(rows, "key", "v", dims, "ord")
    classes = written(classes, "classes")
    heads = written(members.groupBy("cls").agg(F.min("ord").alias("ord"), F.min_by("key", "ord").alias("key")), "heads")
    o = heads.select("cls", "ord")
    found = _close(classes, None, dims, threshold, 4).join(o.toDF("a", "oa"), "a").join(o.toDF("b", "ob"), "b")
    first = F.col("oa") < F.col("ob")
    edges = written(found.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("early"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("late"), "similarity"), "edges")
    late = edges.select(F.col("late").alias("cls")).distinct()
    firsts = edges.select(F.col("early").alias("cls")).distinct().join(late, "cls", "left_anti")
    state = written(firsts.withColumn("kept", F.lit(True)).unionByName(late.withColumn("kept", F.lit(None).cast("boolean"))), "state")
    while not state.where(F.col("kept").isNull()).isEmpty():
        s = state.select(F.col("cls").alias("early"), F.col("kept").alias("early_kept"))
        seen = edges.join(s, "early").groupBy(F.col("late").alias("cls")).agg(F.max(F.coalesce("early_kept", F.lit(False))).alias("hit"), F.max(F.col("early_kept").isNull()).alias("open"))
        verdict = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("hit"), False).when(~F.col("open"), True)
        state = written(state.join(seen, "cls", "left").select("cls", verdict.alias("kept")), "state")
    # A member is a duplicate of the most similar kept class that began before it, its own class included.
    kept = heads.join(state, "cls", "left").where(F.coalesce("kept", F.lit(True))).select("cls", "ord", F.col("key").alias("head"))
    ways = edges.select(F.col("early").alias("cls"), F.col("late").alias("other"), "similarity").unionByName(edges.select(F.col("late").alias("cls"), F.col("early").alias("other"), "similarity"))
    near = ways.join(kept.select(F.col("cls").alias("other"), "ord", "head"), "other").select("cls", "ord", "head", "similarity")
    near = near.unionByName(kept.select("cls", "ord", "head", F.lit(1.0).alias("similarity")).where(F.lit(threshold < 1.0)))
    of = members.withColumnRenamed("ord", "mine").join(near, "cls").where(F.col("ord") < F.col("mine")).groupBy("key").agg(F.min_by("head", F.struct(-F.col("similarity"), "ord")).alias("duplicate_of"), F.max("similarity").alias("duplicate_similarity"))
    return rows.select("key").join(of, "key", "left").select(F.col("key").alias(key), F.col("duplicate_of").isNull().alias("kept"), "duplicate_of", "duplicate_similarity")
