"""Incremental ingest: new files become segments of a published store, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import segments, store


def merge_batch(root: str, key: str = "id", keep: int = 3):
    """A ``foreachBatch`` function: each batch is one segment more (:mod:`segments`), so a batch writes its own rows and no others,
    and now and then the last segments are merged. The last row of each key (by ``ts`` if there is one) wins, a batch that comes
    again changes nothing, and segments that none of the last ``keep`` lists names are removed."""

    def run(batch: DataFrame, epoch: int) -> None:
        held = segments.Store(batch.sparkSession, root, batch.schema, key)
        name = f"batch-{epoch:09d}"
        if held.tag() == name:
            return
        held.write(store.last_of_each(batch, key, "ts" if "ts" in batch.columns else None), tag=name)
        held.compact()
        held.retain(keep)

    return run


def current(spark: SparkSession, root: str, schema, key: str = "id") -> DataFrame:
    """What has been ingested below ``root``: rows of ``schema`` (as of :func:`ingest`)."""
    made = spark.createDataFrame([], schema).schema
    return segments.Store(spark, root, made, key).rows()


def ingest(spark: SparkSession, source: str, schema: str, root: str, checkpoint: str, key: str = "id", per_batch: int = 1000) -> StreamingQuery:
    """Start ingesting Parquet files that appear in ``source``; it ends when what is there now has been merged."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(source)
    return stream.writeStream.foreachBatch(merge_batch(root, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by event time and type, for a stream or a table; rows later than ``late`` are dropped from a stream."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", s).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")
