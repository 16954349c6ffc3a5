"""Tables of documents, and those that are cut from their lineage."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from ..store import new_path, shared_dir, written

__all__ = ["documents", "drop", "new_path", "shared_dir", "small_batches", "written"]

#: Most bytes and rows that pass between Spark and Python workers at once; one row always fits.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": "4194304b", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def small_batches(spark: SparkSession) -> None:
    """Bounds what a worker and its executor hold of a table of texts, each on both ways."""
    for key, value in BATCH.items():
        spark.conf.set(key, value)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def drop(spark: SparkSession, path: str) -> None:
    """Removes a table that nothing reads any more, and lets Spark clear the shuffles of jobs that have ended."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    gc.collect()
    jvm.System.gc()
