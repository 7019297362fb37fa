"""Exact cosine search for a batch of queries: each partition keeps its own k best, then those are merged."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.best import RunningBest
from ..functions.layout import spread

#: Queries are compared in blocks of so many; every block is a pass over the vectors.
QUERY_BLOCK = 4000


def _search(vectors: DataFrame, key: str, vector: str, ids: list, matrix: np.ndarray, query_key: str, k: int, schema: T.StructType) -> DataFrame:
    dims = matrix.shape[1]
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    unit = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)
    kind = pa.array(ids, type=to_arrow_type(schema[query_key].dataType))

    key_kind = to_arrow_type(schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = RunningBest(len(kind), k, key_kind)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
                n = np.linalg.norm(x, axis=1, keepdims=True)
                s = np.divide(x, n, out=np.zeros_like(x), where=n > 0) @ unit.T
                best.offer(b.column(0), s, s)
        t = best.result()
        if t is not None:
            yield pa.RecordBatch.from_arrays([kind.take(t.column("query").combine_chunks()), t.column("key").combine_chunks(), t.column("score").combine_chunks()], names=schema.names)

    usable = (F.size(vector) == dims) & ~F.exists(vector, lambda e: e.isNull())
    return vectors.where(usable).select(key, F.col(vector).cast("array<double>")).mapInArrow(run, schema)


def topk(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query: str, k: int = 10, where: dict | None = None) -> DataFrame:
    """(query_key, key, score, rank): the k vectors nearest to each query by cosine, ties to the smaller key.

    ``where`` filters the vectors by equality before they are compared. The score is rounded to four digits, the order is that of the exact values.
    NULL vectors and those of another length than the query's are left out; an all-zero vector has cosine 0.
    """
    for c, v in (where or {}).items():
        vectors = vectors.where(F.col(c) == F.lit(v))
    vectors = spread(vectors)
    schema = T.StructType([T.StructField(query_key, queries.schema[query_key].dataType), T.StructField(key, vectors.schema[key].dataType), T.StructField("cosine", T.DoubleType())])
    parts, ids, rows = [], [], []

    def flush() -> None:
        for d in {len(r) for r in rows}:
            at = [i for i, r in enumerate(rows) if len(r) == d]
            parts.append(_search(vectors, key, vector, [ids[i] for i in at], np.array([rows[i] for i in at], dtype=np.float64), query_key, k, schema))
        ids.clear()
        rows.clear()

    for r in queries.where(F.col(query).isNotNull() & (F.size(query) > 0)).select(query_key, query).toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) >= QUERY_BLOCK:
            flush()
    if ids:
        flush()
    found = reduce(DataFrame.unionByName, parts) if parts else queries.sparkSession.createDataFrame([], schema)
    w = Window.partitionBy(query_key).orderBy(F.desc("cosine"), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(query_key, key, F.round("cosine", 4).alias("score"), "rank")
