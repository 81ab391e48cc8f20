"""What a session needs for right results."""

from __future__ import annotations

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Turn off the guess that a union of children that are partitioned alike is so itself: repeated rows passed a later
    distinct() or join with it."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark
