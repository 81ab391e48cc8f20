"""Streaming ingest, and event-time counts as an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import exports
from ..staging import scratch, staged
from ..streaming import ingest, sessions
from .base import ORACLES, Data, query
from .corpus_queries import _session_logs


@query("stream_ingest", "SELECT event_id, user_id, event_type FROM events")
def _(d: Data) -> DataFrame:
    spark = d.spark
    root = scratch(spark, "ingest")
    rows = d.table("events").select(F.col("event_id").alias("id"), "ts", "user_id", "event_type")
    rows.write.parquet(f"{root}/in")
    schema = "id long, ts timestamp, user_id long, event_type string"
    q = ingest.ingest(spark, f"{root}/in", schema, f"{root}/store", f"{root}/checkpoint")
    q.awaitTermination()
    return ingest.current(spark, f"{root}/store", schema).select(F.col("id").alias("event_id"), "user_id", "event_type")


@query("tumbling_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(d: Data) -> DataFrame:
    return ingest.windowed_counts(d.table("events")).withColumn("total", F.round("total", 4))


@query("session_windows", """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (
 SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, k""")
def _(d: Data) -> DataFrame:
    return ingest.sessions(d.table("events"))


@query("session_stream", ORACLES["session_pages"])
def _(d: Data) -> DataFrame:
    """The session logs' lines as a stream, half of them first, then the others and some twice; a last line far in the future closes all sessions."""
    spark, root = d.spark, scratch(d.spark, "session-stream")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("path", "place"), F.lit(300)))
    lines = staged(exports.read_session_lines(spark, _session_logs(d)).select("path", "place.block", "place.n", at.alias("at"), *sessions._FIELDS), "lines")
    odd = F.pmod(F.xxhash64("path", "n"), F.lit(2)) == 1
    repeated = lines.where((F.pmod("n", F.lit(3)) == 0) | (F.pmod("n", F.lit(7)) == 0))
    last = spark.range(1).select(F.lit("end").alias("path"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("n"), F.timestamp_seconds(F.lit(1_800_000_000)).alias("at"), *(F.lit(None).cast("array<string>" if f == "tools" else "string").alias(f) for f in sessions._FIELDS))
    for rows in (lines.where(~odd), lines.where(odd).unionByName(repeated), last):
        rows.write.mode("append").parquet(f"{root}/in")
        sessions.replay(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint")  # from where it was
    return spark.read.schema(sessions.PAGE).parquet(f"{root}/out").select("session_id", "markdown")
