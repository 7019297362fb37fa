"""Near-duplicate records with small edits, by covering locality-sensitive hashing.

A record is the set of its word shingles. Its MinHash values are symbols of a vector, so that two
records of Jaccard similarity s differ in each coordinate with probability 1 - s. The coordinates
are cut into parts of seven. In a part, the masks are the lines of the
projective plane over GF(2), structured masks that cover radius two: wherever the two coordinates lie in which
two vectors differ, some line of three coordinates avoids both,
so they collide in that mask's table for certain. Over ``parts`` parts every pair within Hamming
distance ``3 * parts - 1`` (20 of 49) collides (pigeonhole: some part holds at most two differences). What
collides is verified on the full shingle sets, so that no pair below the threshold comes out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, WordHash, list_column, minhashes, mix64, set_prints, shingle_sets, slices

COORDS = 7
#: Parts, of seven masks each.
PARTS = 7
#: So many prints of sets a task remembers, then it begins anew.
SEEN = 1_000_000


def fano_masks() -> list[list[int]]:
    """For each non-zero v of GF(2)^3 the coordinates i (as vectors 1..7) with <i, v> = 0: seven lines of three points."""
    return [[i - 1 for i in range(1, 8) if bin(i & v).count("1") % 2 == 0] for v in range(1, 8)]


def signatures(df: DataFrame, key: str, text: str, width: int = 3) -> DataFrame:
    """(key, cls, n, shingles): the shingle set of each record, its print ``cls`` and its size ``n``.

    A task puts out a set with the first record that has it only (NULL with the others), so that copies cost little from here on.
    Records with NULL key, NULL text or fewer words than ``width`` have no set and no row. Other columns are not carried.
    """
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("cls", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("shingles", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHash()
        known: set[int] = set()
        for b in slices(batches, "text__"):
            sets, starts = shingle_sets(b.column(1).to_pylist(), hasher, width)
            n = np.diff(starts)
            keep = np.nonzero(n)[0]
            if len(keep) == 0:
                continue
            prints = set_prints(sets, starts)[keep].view(np.int64)
            if len(known) > SEEN:
                known.clear()
            new = np.zeros(len(keep), dtype=bool)
            for i, p in enumerate(prints.tolist()):
                if p not in known:
                    known.add(p)
                    new[i] = True
            at = np.concatenate([[0], np.cumsum(n[keep])])
            lists = list_column(sets.astype(np.uint32).view(np.int32), at, pa.int32())
            lists = lists.take(pa.array(np.arange(len(keep)), mask=~new))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array(prints), pa.array(n[keep].astype(np.int32)), lists], names=[key, "cls", "n", "shingles"])

    return df.where(F.col(key).isNotNull()).select(F.col(key), F.col(text).alias("text__")).mapInArrow(run, schema)


def classes(sigs: DataFrame) -> DataFrame:
    """(cls, n, shingles): one row per distinct shingle set."""
    return sigs.where(F.col("shingles").isNotNull()).groupBy("cls").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))


def flat_sets(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a column of sets one after another, and where each set begins."""
    starts = col.offsets.to_numpy().astype(np.int64)
    return col.flatten().to_numpy().view(np.uint32).astype(np.uint64), starts - starts[0]


def covering_keys(cls: DataFrame, parts: int) -> DataFrame:
    """(cls, key): 7 * parts table keys of each class."""
    masks = fano_masks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                b = batch.slice(at, 2000)
                m = minhashes(*flat_sets(b.column(1)), COORDS * parts).astype(np.uint64)
                keys = np.empty((b.num_rows, 7 * parts), dtype=np.uint64)
                for p in range(parts):
                    for v, mask in enumerate(masks):
                        k = np.full(b.num_rows, p * 7 + v + 1, dtype=np.uint64)
                        for c in mask:
                            k = mix64(k * np.uint64(0x9E3779B97F4A7C15) + m[:, p * COORDS + c])
                        keys[:, p * 7 + v] = k
                w = 7 * parts
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), w)), pa.array(keys.reshape(-1).view(np.int64))], names=["cls", "key"])

    return cls.select("cls", "shingles").mapInArrow(run, "cls long, key long")


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of those pairs (a, b) of classes whose shingle sets have at least the threshold's Jaccard similarity."""
    x = left.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    y = right.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(x, "a")
        .join(y, "b")
        .withColumn("both", both)
        .withColumn("similarity", F.col("both") / (F.size("sa") + F.size("sb") - F.col("both")))
        .where(F.col("similarity") >= F.lit(threshold))
        .select("a", "b", "similarity")
    )


def class_pairs(cls: DataFrame, threshold: float = 0.6, parts: int = PARTS) -> DataFrame:
    """(a, b, similarity), a < b: the pairs of distinct shingle sets that reach the threshold.

    ``parts`` 7 makes 49 tables; a pair of similarity exactly 0.6 is missed with probability 0.309 ** 7 = 0.0003,
    one of 0.7 with 2e-6. A table's bucket is never gathered: the self-join is a sort-merge join, whose skewed
    partitions are split at run time.
    """
    keys = covering_keys(cls, parts)
    x, y = keys.select(F.col("cls").alias("a"), "key"), keys.select(F.col("cls").alias("b"), "key")
    found = x.hint("merge").join(y, "key").where("a < b").select("a", "b").distinct()
    return verified(found, cls, cls, threshold)


def near_duplicate_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.6, width: int = 3, parts: int = PARTS) -> DataFrame:
    """(``key``_a, ``key``_b, similarity), a < b: all records whose texts reach the threshold.

    Records of one shingle set form a class, and classes are compared, so a group of copies costs one row in the search however
    large it is. In the result every member of a class stands with every other one and with all of the classes like it, so the rows are as many as the
    pairs; ``near_duplicate_groups`` and ``near_duplicate_classes`` tell the same in a row per record and per pair of classes.

    NULL, empty and too short texts pair with nothing; rows that repeat a key count once; an empty table gives an empty
    result; a text of any length is one set; columns other than the two named are ignored.
    """
    tables = Scratch(df.sparkSession)
    sigs = tables.write(signatures(df, key, text, width), "signatures")
    cls = tables.write(classes(sigs), "classes")
    pairs = tables.write(class_pairs(cls, threshold, parts), "pairs")
    members = tables.write(sigs.select("cls", F.col(key).alias("key")).distinct(), "members")
    tables.drop("signatures", "classes")
    across = pairs.join(members.toDF("a", "x"), "a").join(members.toDF("b", "y"), "b").select("x", "y", "similarity")
    several = members.groupBy("cls").agg(F.count("*").alias("copies")).where("copies > 1").select("cls")
    some = members.join(several, "cls")
    inside = some.toDF("cls", "x").join(some.toDF("cls", "y"), "cls").where(F.col("x") < F.col("y")).select("x", "y", F.lit(1.0).alias("similarity"))
    return across.unionByName(inside).select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"), "similarity")


def near_duplicate_classes(df: DataFrame, key: str, text: str, threshold: float = 0.6, width: int = 3, parts: int = PARTS) -> tuple[DataFrame, DataFrame]:
    """(class_a, class_b, similarity) of the classes within the threshold, and the membership (key, class_id, copies); a class is named by its first record.

    Nulls, repeats, empty tables and other columns as in ``near_duplicate_pairs``.
    """
    tables = Scratch(df.sparkSession)
    sigs = tables.write(signatures(df, key, text, width), "signatures")
    cls = tables.write(classes(sigs), "classes")
    pairs = tables.write(class_pairs(cls, threshold, parts), "pairs")
    members = tables.write(sigs.select("cls", F.col(key).alias("key")).distinct(), "members")
    tables.drop("signatures", "classes")
    top = tables.write(members.groupBy("cls").agg(F.min("key").alias("rep"), F.count("*").alias("copies")), "top")
    named = pairs.join(top.select(F.col("cls").alias("a"), F.col("rep").alias("x")), "a").join(top.select(F.col("cls").alias("b"), F.col("rep").alias("y")), "b")
    return named.select(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b"), "similarity"), members.join(top, "cls").select(F.col("key").alias(key), F.col("rep").alias("class_id"), "copies")


def near_duplicate_groups(df: DataFrame, key: str, text: str, threshold: float = 0.6, width: int = 3, parts: int = PARTS) -> DataFrame:
    """(key, class_id, copies, links): one row per record with a shingle set; ``class_id`` is the first record of its
    set, ``copies`` the size of the class and ``links`` the number of other classes within the threshold.

    Nulls, repeats, empty tables and other columns as in ``near_duplicate_pairs``.
    """
    pairs, members = near_duplicate_classes(df, key, text, threshold, width, parts)
    ends = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return members.join(ends, "class_id", "left").select(key, "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
