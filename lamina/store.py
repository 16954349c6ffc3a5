"""Tables cut from their lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all tasks run in this process, as in tests, a folder of its own."""
    sc = spark.sparkContext
    set_ = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not set_:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        set_ = "file://" + tempfile.mkdtemp(prefix="lamina-")
        sc.setCheckpointDir(set_)
    return set_.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/lamina/{name}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(clean)
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read back: a lost executor costs no recomputation of what is before."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean() -> None:
    """Removes what this process has written, if the session still runs."""
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended; the folder's owner cleans up
            return
    _made.clear()
