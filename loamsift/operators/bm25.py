"""Okapi BM25 for a batch of queries at once, over a stored index.

The index holds, for each document, its length and its distinct tokens with their frequencies, and for each token how many documents hold it: the texts are read and tokenised once.
The scores of a batch of documents for a block of queries are one matrix product, term weights by query weights; each partition keeps its k best of each query, so no more than partitions x queries x k rows are shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.best import RunningBest
from ..functions.layout import spread
from ..functions.tables import scratch_dir
from ..functions.text import tokens

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Queries are scored in blocks of so many; every block is a pass over the index.
QUERY_BLOCK = 1000
DOC_BATCH = 1000
_TOKEN = re.compile("[a-z0-9]+")


class SparseIndex:
    """A stored index below a folder: ``docs`` (key, dl, terms, tfs) and ``terms`` (token, df)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.docs = spark.read.parquet(f"{self.path}/docs")
        self.terms = spark.read.schema("token string, df long").parquet(f"{self.path}/terms")
        row = self.docs.agg(F.count("*").alias("n"), F.sum("dl").alias("total")).first()
        self.n, self.avgdl = row.n, (row.total or 0) / row.n if row.n else 0.0

    @classmethod
    def build(cls, df: DataFrame, key: str, text: str, path: str | None = None) -> SparseIndex:
        """Indexes every row; NULL texts count as documents without tokens."""
        path = path or scratch_dir(df.sparkSession)
        kind = df.schema[key].dataType
        schema = T.StructType([T.StructField("key", kind), T.StructField("dl", T.IntegerType()), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, DOC_BATCH):
                    b = batch.slice(at, DOC_BATCH)
                    counts = [Counter(_TOKEN.findall(t)) if t else {} for t in b.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sum(c.values()) for c in counts], pa.int32()), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))], names=schema.names)

        spread(df.select(F.col(key), F.lower(text))).mapInArrow(run, schema).write.mode("overwrite").parquet(f"{path}/docs")
        docs = df.sparkSession.read.schema(schema).parquet(f"{path}/docs")
        docs.select(F.explode("terms").alias("token")).groupBy("token").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
        return cls(df.sparkSession, path)

    def raw(self) -> Column:
        return F.log(F.lit(self.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)

    def idf(self) -> DataFrame:
        """(token, df, idf): negative idf becomes a quarter of the vocabulary's mean raw idf."""
        mean = self.terms.agg(F.avg(self.raw())).first()[0]
        return self.terms.select("token", "df", F.when(self.raw() < 0, F.lit(mean) * EPSILON).otherwise(self.raw()).alias("idf"))


def term_stats(df: DataFrame, text: str) -> DataFrame:
    """(token, df, idf) of the texts of ``df``."""
    return SparseIndex.build(df.select(F.lit(0).alias("k"), text), "k", text).idf()


def _scores(index: SparseIndex, block: list[tuple[object, list[str]]], idf: dict[str, float], query_key: str, k: int, schema: T.StructType) -> DataFrame:
    """The k best documents of each partition for each query of the block, of those that share a token with it."""
    vocabulary = sorted(idf)
    place = {t: i for i, t in enumerate(vocabulary)}
    weight = np.zeros((len(place), len(block)))
    for j, (_, words) in enumerate(block):
        for t in words:
            if t in place:
                weight[place[t], j] += idf[t]
    ids = pa.array([q for q, _ in block], type=to_arrow_type(schema[query_key].dataType))
    asked = (weight != 0).astype(np.float32)
    known = pa.array(vocabulary, pa.string())
    kind = to_arrow_type(schema.fields[1].dataType)
    avgdl = index.avgdl

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = RunningBest(len(ids), k, kind)
        for batch in batches:
            for at in range(0, batch.num_rows, DOC_BATCH):
                b = batch.slice(at, DOC_BATCH)
                dl = b.column(1).to_numpy().astype(np.float64)
                code = pc.fill_null(pc.index_in(b.column(2).flatten(), known), -1).to_numpy()
                row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(2)).to_numpy())
                use = code >= 0
                tf = np.zeros((b.num_rows, len(known)))
                tf[row[use], code[use]] = b.column(3).flatten().to_numpy()[use]
                s = (tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[:, None] / avgdl))) @ weight
                order = np.round(s, 9)
                order[(tf > 0).astype(np.float32) @ asked == 0] = -np.inf
                best.offer(b.column(0), order, s)
        t = best.result()
        if t is not None:
            yield pa.RecordBatch.from_arrays([ids.take(t.column("query").combine_chunks()), t.column("key").combine_chunks(), t.column("score").combine_chunks()], names=schema.names)

    return index.docs.where("dl > 0").select("key", "dl", "terms", "tfs").mapInArrow(run, schema)


def search(index: SparseIndex, key: str, queries: DataFrame, query_key: str, query: str, k: int = 10) -> DataFrame:
    """(query_key, key, score, rank): the k best documents of the index for each query; scores equal to nine digits tie, and ties go to the smaller key.

    Repeated query tokens count repeatedly. Documents without any of the tokens score 0 and fill up the k. Queries without tokens have no
    rows. NULL texts score 0; ``key`` must be unique in the index.
    """
    spark = queries.sparkSession
    schema = T.StructType([T.StructField(query_key, queries.schema[query_key].dataType), T.StructField(key, index.docs.schema["key"].dataType), T.StructField("score", T.DoubleType())])
    asked = queries.select(query_key, tokens(query).alias("t")).where(F.size("t") > 0)
    parts, block = [], []

    def flush() -> None:
        used = spark.createDataFrame([(t,) for t in {t for _, w in block for t in w}], "token string")
        idf = {r[0]: r[1] for r in index.idf().join(F.broadcast(used), "token", "left_semi").select("token", "idf").collect()}
        if idf:
            parts.append(_scores(index, list(block), idf, query_key, k, schema))
        block.clear()

    for r in asked.toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) >= QUERY_BLOCK:
            flush()
    if block:
        flush()
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    # At most k of the first 2k documents are needed to fill up, as at most k of them are among the best; each query gets them as marked rows, which lose to all that were found.
    first = index.docs.select(F.col("key").alias(key)).orderBy("key").limit(2 * k)
    fill = asked.select(query_key).crossJoin(F.broadcast(first)).select(query_key, key, F.lit(0.0).alias("score"), F.lit(1).alias("fill"))
    every = found.withColumn("fill", F.lit(0)).unionByName(fill)
    one = every.groupBy(query_key, key).agg(F.min_by("score", "fill").alias("score"), F.min("fill").alias("fill"))
    w = Window.partitionBy(query_key).orderBy("fill", F.desc(F.round("score", 9)), key)
    ranked = one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    # What fills up scores 0 and may stand before documents of negative scores.
    w = Window.partitionBy(query_key).orderBy(F.desc(F.round("score", 9)), key)
    return ranked.withColumn("rank", F.row_number().over(w)).select(query_key, key, "score", "rank")


def topk(df: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query: str, k: int = 10) -> DataFrame:
    """``search`` over an index of ``df`` built for this call."""
    return search(SparseIndex.build(df, key, text), key, queries, query_key, query, k)
