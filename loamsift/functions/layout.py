"""Partition layout."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Over all cores where ``df`` reads fewer files than there are, as one small file; a table of enough files is left as it is, without a shuffle.

    Only file names are asked for; nothing of ``df`` is run.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
