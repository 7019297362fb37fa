"""The most similar vectors of every vector, by multi-index hashing.

Vectors are turned by learned rotations (iterative quantization: the rotation that brings a sample's
coordinates closest to their signs) and reduced to the signs, one bit per dimension and rotation. The code is cut into substrings, each with an index of its own, of as many bits as
the number of vectors has binary digits. Each index is probed with the substring and all its one-bit neighbours: with m substrings that retrieves every code within a
Hamming distance of 2m - 1 (pigeonhole), and beyond it with the probability from which m follows. What is retrieved is checked on 384 further bits, signs of random rotations, and reranked with the floats. ``operators.hamming`` holds the search.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.hamming import CHECK, near_bits, near_codes, plan
from .common import Scratch, written

SAMPLE = 4096
BLOCK = 1024
#: Rows that a task holds while it looks for the first members of classes.
HELD = 1_000_000
#: The share of pairs at the lowest cosine that the indexes must find.
RECALL = 0.99


def learn_rotations(sample: np.ndarray, count: int, steps: int = 20, seed: int = 5) -> np.ndarray:
    """``count`` orthogonal matrices, dims x (count * dims), each learned from another random start by iterative quantization."""
    d = sample.shape[1] if sample.ndim == 2 else 0
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(steps if len(sample) >= d else 0):
            u, _, vt = np.linalg.svd(sample.T @ np.where(sample @ r >= 0, 1.0, -1.0))
            r = u @ vt
        out.append(r)
    return np.hstack(out)


def unit_vectors(df: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """(key, v): one row per key whose vector has ``dims`` finite entries and is not all zero."""
    e = F.col("v")
    one = df.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<float>").alias("v")).where((F.size(e) == dims) & F.exists(e, lambda x: x != 0) & F.forall(e, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
    return one.dropDuplicates([key])


def cosine(x: str, y: str):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        if len(a) == 0:
            return pd.Series([], dtype=float)
        p, q = np.stack(a.to_list()).astype(np.float64), np.stack(b.to_list()).astype(np.float64)
        return pd.Series(np.einsum("ij,ij->i", p, q) / np.sqrt(np.einsum("ij,ij->i", p, p) * np.einsum("ij,ij->i", q, q)))

    return run(x, y)


def _nearest(df: DataFrame, by: str, k: int) -> DataFrame:
    """The k rows of each ``by`` with the highest cosine, ties to the smaller ``other``."""
    w = Window.partitionBy(by).orderBy(F.desc("cosine"), "other")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _block_search(query: DataFrame, data: DataFrame, dims: int, k: int, least: float) -> DataFrame:
    """(id, other, cosine): for each (cell, id, v) of ``query`` the k nearest rows (cell, d_id, d_v) of ``data`` in the same cell.

    A cell holds one block of queries and one of data, both of bounded size, and is one matrix product.
    """

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"id": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "cosine": np.zeros(0)})
        if left.empty or right.empty:
            return none
        a, b = np.stack(left["v"].to_list()).astype(np.float64), np.stack(right["d_v"].to_list()).astype(np.float64)
        ids, others = left["id"].to_numpy(), right["d_id"].to_numpy()
        order = np.argsort(others)
        b, others = b[order], others[order]
        s = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
        s[ids[:, None] == others[None, :]] = -2
        s[s < least] = -2
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        c = np.take_along_axis(s, top, axis=1)
        i, j = np.nonzero(c > -2)
        return pd.DataFrame({"id": ids[i], "other": others[top[i, j]], "cosine": c[i, j]})

    return query.groupBy("cell").cogroup(data.groupBy("cell")).applyInPandas(search, "id long, other long, cosine double")


def random_rotations(dims: int, columns: int, seed: int = 6) -> np.ndarray:
    """``columns`` unit projections, orthogonal within each rotation. Their signs differ as the angle says, which those of learned rotations don't."""
    rng = np.random.default_rng(seed)
    return np.hstack([np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(-(-columns // dims))])[:, :columns]


def candidate_pairs(vectors: DataFrame, rotations: np.ndarray, rows: int, bits: int, bands: int, least: float) -> DataFrame:
    """(id, other, cosine), both ways: pairs retrieved by the indexes with a cosine of at least ``least``. The vectors differ from each other."""
    planes = np.hstack([random_rotations(rotations.shape[0], CHECK), rotations[:, : bits * bands]])
    pairs = near_codes(vectors, None, "id", "v", planes, rows, bits, bands, near_bits(least))
    v = vectors.select("id", "v")
    both = pairs.join(v.toDF("a", "va"), "a").join(v.toDF("b", "vb"), "b").withColumn("cosine", cosine("va", "vb")).where(F.col("cosine") >= least)
    return both.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other"), "cosine"), F.struct(F.col("b").alias("id"), F.col("a").alias("other"), "cosine"))).alias("p")).select("p.*")


def classes_of(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Equal vectors as one: (id, v) of the first of each class, all members (rep, id), and the first k + 1 (rep, id) of each class.

    A class is named by the hash of its vector, and its first members are found by an aggregation that starts in each partition, so a large class costs a row for each member and
    no more.
    """
    hashed = vectors.withColumn("h", F.xxhash64("v"))
    # Of each partition only the first members of a class can be among the first of all.
    rows = hashed.select("h", "id")
    few = rows.mapInArrow(_first_of_each(k + 1), "h long, id long").groupBy("h").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"))
    heads = few.select("h", F.col("ids")[0].alias("rep"), "ids")
    reps = hashed.join(heads.select(F.col("h"), F.col("rep").alias("id")), ["h", "id"]).select("id", "v")
    return reps, rows.join(heads.select("h", "rep"), "h").select("rep", "id"), heads.select("rep", F.explode("ids").alias("id"))


def _first_of_each(most: int):
    """The ``most`` smallest ids of each h of a partition."""

    def run(batches):
        kept = np.zeros((0, 2), dtype=np.int64)
        for b in batches:
            x = np.concatenate([kept, np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1)])
            x = x[np.lexsort((x[:, 1], x[:, 0]))]
            new = np.ones(len(x), dtype=bool)
            new[1:] = x[1:, 0] != x[:-1, 0]
            begin = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
            kept = x[np.arange(len(x)) - begin < most]
            if len(kept) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(kept[:, 0]), pa.array(kept[:, 1])], names=["h", "id"])
                kept = kept[:0]
        if len(kept):
            yield pa.RecordBatch.from_arrays([pa.array(kept[:, 0]), pa.array(kept[:, 1])], names=["h", "id"])

    return run


def _expand(near: DataFrame, members: DataFrame, heads: DataFrame, k: int) -> DataFrame:
    """From the nearest classes of each class to the k nearest vectors of each vector."""
    classes = _nearest(near, "id", k).select("id", "other", "cosine")
    other = _nearest(classes.join(heads.select(F.col("rep").alias("other"), F.col("id").alias("o")), "other").select(F.col("id").alias("rep"), F.col("o").alias("other"), "cosine"), "rep", k).drop("rank")
    alike = heads.select("rep", F.col("id").alias("other"), F.lit(1.0).alias("cosine"))
    each = members.join(other.unionByName(alike), "rep").where(F.col("id") != F.col("other")).select("id", "other", "cosine")
    return _nearest(each, "id", k).select("id", "other", "cosine", "rank")


def sample_of(vectors: DataFrame, dims: int, size: int = SAMPLE) -> np.ndarray:
    """At most ``size`` unit vectors, the same ones for the same rows; only the rotations are learned from them."""
    got = vectors.orderBy(F.xxhash64("id"), "id").select("v").limit(size).toPandas()["v"].to_list()
    x = np.stack(got).astype(np.float64) if got else np.zeros((0, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def nearest_vectors(df: DataFrame, key: str, vector: str, k: int = 5, least: float = 0.9, dims: int = 64, recall: float = RECALL) -> DataFrame:
    """(id, other, cosine, rank): of each vector the k nearest others with a cosine of at least ``least``; ties go to the smaller key.

    A pair at ``least`` is retrieved with the probability ``recall``, one above it with a higher one; the check on 384 bits lets it pass but for four and a half standard deviations (3e-6). Keys are whole
    numbers. Vectors that are NULL, all zero, not finite or of another length than ``dims`` count for nothing, rows that repeat a key once, an empty table
    gives an empty result, extra columns are ignored. Equal vectors are searched as one, so a large group of them costs one row.
    """
    tables = Scratch(df.sparkSession)
    vectors = tables.write(unit_vectors(df.withColumnRenamed(key, "id"), "id", vector, dims), "unit")
    reps, members, heads = classes_of(vectors, k)
    reps, heads = tables.write(reps, "reps"), tables.write(heads, "heads")
    members = tables.write(members, "members")
    rows = reps.count()
    bits, bands = plan(rows, least, recall)
    rotations = learn_rotations(sample_of(reps, dims), -(-bits * bands // dims))
    near = candidate_pairs(reps, rotations, rows, bits, bands, least)
    found = written(_expand(near, members, heads, k), "near")
    tables.drop_all()
    return found


def nearest_of_queries(df: DataFrame, query: DataFrame, key: str, vector: str, k: int = 5, dims: int = 64, least: float = 0.9) -> DataFrame:
    """(id, other, cosine, rank): the k nearest others of each vector whose key is in ``query``, at any cosine.

    A vector that has k neighbours of at least ``least`` is answered by the index. The others' radius takes in the whole collection, so
    they are compared with all vectors, in blocks of bounded size. Edge cases as in ``nearest_vectors``.
    """
    vectors = written(unit_vectors(df.withColumnRenamed(key, "id"), "id", vector, dims), "unit")
    asked = query.select(F.col(key).cast("long").alias("id")).distinct()
    done = nearest_vectors(vectors, "id", "v", k, least, dims).join(asked, "id", "left_semi")
    full = done.groupBy("id").agg(F.count("*").alias("c")).where(F.col("c") >= k).select("id")
    rest = written(vectors.join(asked, "id", "left_semi").join(full, "id", "left_anti"), "rest")
    n, m = rest.count(), vectors.count()
    p, q = max(1, -(-n // BLOCK)), max(1, -(-m // (4 * BLOCK)))
    one = lambda blocks: F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    query_cells = rest.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(q - 1)))).select(F.concat_ws("/", one(p), "o").alias("cell"), "id", "v")
    data_cells = vectors.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(p - 1)))).select(F.concat_ws("/", "o", one(q)).alias("cell"), F.col("id").alias("d_id"), F.col("v").alias("d_v"))
    wide = _nearest(_block_search(query_cells, data_cells, dims, k, -1.5), "id", k).select("id", "other", "cosine", "rank")
    return done.join(full, "id", "left_semi").unionByName(wide)
