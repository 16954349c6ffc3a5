"""Work that arrives: new source files are planned as they land, against what has been made already."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, pattern: str = "*.tif*") -> DataFrame:
    """A stream of the files that land in a folder."""
    return spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def process(stream: DataFrame, done: Callable[[], DataFrame], work: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Runs work on each batch of files whose path isn't in done() (path) yet. A batch that is repeated after a failure is filtered by
    done() again, so each file is worked on once as long as work records it."""

    def batch(df: DataFrame, _: int) -> None:
        work(df.join(done().select("path").distinct(), "path", "left_anti"))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each type and window of time, from a stream or a table (ts, event_type, value)."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
