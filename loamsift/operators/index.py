"""The chunk store: insert if absent, delete, list, existence, state of the derived index, saving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sanitize(df: DataFrame) -> DataFrame:
    """Only scalar columns stay; NULL text becomes empty."""
    scalar = (T.StringType, T.BooleanType, T.NumericType)
    return df.select(*(F.coalesce(F.col(f.name), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields if isinstance(f.dataType, scalar)))


def insert_if_absent(new: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """The new rows, one per key, whose key the store doesn't hold."""
    return new.where(F.col(key).isNotNull()).dropDuplicates([key]).join(store.select(key), key, "left_anti")


def delete_document(store: DataFrame, doc_id: str, column: str = "doc_id") -> DataFrame:
    """The store without a document's rows."""
    return store.where(~F.col(column).eqNullSafe(F.lit(doc_id)))


def has(store: DataFrame, key: str, value: object) -> bool:
    return not store.where(F.col(key) == F.lit(value)).limit(1).isEmpty()


def list_documents(store: DataFrame, order: str = "chunk_id") -> DataFrame:
    """(doc_id, source_file, chunk_count, strategies) per document: its first source file, how many chunks, its strategies in order."""
    doc = F.coalesce(F.col("doc_id"), F.lit("unknown"))
    return store.groupBy(doc.alias("doc_id")).agg(F.min_by("source_file", order).alias("source_file"), F.count("*").alias("chunk_count"), F.array_join(F.sort_array(F.collect_set("chunking_strategy")), ",").alias("strategies")).orderBy("doc_id")


def sync_status(dense: DataFrame, sparse: DataFrame, key: str) -> DataFrame:
    """(dense_count, sparse_count, in_sync): the counts of the two indexes and whether they are equal."""
    d = dense.select(F.col(key)).distinct().agg(F.count("*").alias("dense_count"))
    s = sparse.select(F.col(key)).distinct().agg(F.count("*").alias("sparse_count"))
    return d.crossJoin(s).select("dense_count", "sparse_count", (F.col("dense_count") == F.col("sparse_count")).alias("in_sync"))


def count(store: DataFrame, key: str = "chunk_id") -> int:
    """How many chunks the store holds."""
    return store.select(key).distinct().count()


class ChunkStore:
    """Chunks as Parquet parts below a folder. What is derived from them is rebuilt, so it can't fall out of step.

    The rows are in the folder of the newest version that was written to its end. Deleting writes the next version and then removes the old ones, so that a crash leaves one or the other.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self):
        return self._path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)

    def _versions(self) -> list[int]:
        """The versions that are there, ascending; those that weren't written to the end are left out."""
        fs = self._fs()
        there = fs.globStatus(self._path(f"{self.path}/chunks-*")) or []
        names = [(int(s.getPath().getName()[7:]), s.getPath()) for s in there]
        return sorted(n for n, p in names if fs.exists(self._path(f"{p.toString()}/_SUCCESS")))

    def _folder(self, version: int) -> str:
        return f"{self.path}/chunks-{version}"

    def read(self) -> DataFrame:
        v = self._versions()
        return self.spark.read.schema(self.schema).parquet(self._folder(v[-1])) if v else self.spark.createDataFrame([], self.schema)

    def add(self, new: DataFrame, key: str = "chunk_id") -> int:
        """Appends the rows with new keys; their number."""
        rows = insert_if_absent(new.select(*self.schema.names), self.read(), key).persist()
        try:
            n = rows.count()
            if n:
                rows.write.mode("append").parquet(self._folder((self._versions() or [0])[-1]))
            return n
        finally:
            rows.unpersist()

    def delete(self, doc_id: str) -> int:
        """Removes a document's rows; their number."""
        old = self.read()
        n = old.where(F.col("doc_id") == doc_id).count()
        if n:
            before = self._versions()
            delete_document(old, doc_id).write.mode("overwrite").parquet(self._folder(before[-1] + 1))
            for v in before:
                self._fs().delete(self._path(self._folder(v)), True)
        return n

    def reset(self) -> None:
        for s in self._fs().globStatus(self._path(f"{self.path}/chunks-*")) or []:
            self._fs().delete(s.getPath(), True)
