"""Streamed session logs against the reader of whole logs."""

import json
import random

from pyspark.sql import functions as F

from tessera.sources import exports
from tessera.streaming import sessions


def logs(folder):
    """Lines of all kinds: titles, folders, tools with and without words, blocks and strings, junk."""
    rng = random.Random(3)
    folder.mkdir()
    for s in range(6):
        lines = []
        for i in range(rng.randint(0, 14)):
            tool = {"type": "tool_use", "name": rng.choice(["Bash", "Bash", "Read", ""])}
            text = rng.choice(["salom", " two\n\n\n\n\nlines ", "", "x  y"])
            lines.append(rng.choice([
                {"type": "user", "sessionId": f"s{s}", "timestamp": f"2026-01-0{1 + i % 9}T00:00:00Z", "cwd": rng.choice(["/a", "/b", ""]), "message": {"content": text}},
                {"type": "user", "message": {"content": [{"type": "text", "text": text}, "plain", tool]}},
                {"type": "assistant", "message": {"content": [tool] * rng.randint(1, 3)}},
                {"type": "assistant", "message": {"content": [{"type": "text", "text": text}, tool]}},
                {"type": "assistant", "message": {"content": [{"type": "text", "text": text}]}, "created_at": "2026-02-02T00:00:00Z"},
                {"type": "custom-title", "customTitle": rng.choice([" Own ", ""])}, {"type": "ai-title", "aiTitle": "Made"}, {"type": "note"},
            ]))
        (folder / f"log{s}.jsonl").write_text("\n".join([*map(json.dumps, lines), "{broken", ""]))
    return str(folder)


def test_stream_equals_batch_after_restarts(spark, tmp_path):
    path, root = logs(tmp_path / "logs"), str(tmp_path)
    want = {r.path: tuple(r) for r in exports.read_sessions(spark, path).select(*(c.split()[0] for c in sessions.PAGE.split(", "))).collect()}
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("path", "place"), F.lit(300)))
    lines = exports.read_session_lines(spark, path).select("path", "place.block", "place.n", at.alias("at"), *sessions._FIELDS)
    end = spark.createDataFrame([("end", 0, 0)], "path string, block long, n long").withColumn("at", F.timestamp_seconds(F.lit(1_800_000_000)))
    end = end.select("*", *(F.lit(None).cast("array<string>" if f == "tools" else "string").alias(f) for f in sessions._FIELDS))

    def run():
        stream = spark.readStream.schema(sessions.LINE).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        sessions.pages(stream).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return [tuple(r) for r in spark.read.schema(sessions.PAGE).parquet(f"{root}/out").collect()]

    rows = lines.collect()
    random.Random(1).shuffle(rows)  # out of order, over batches
    for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :] + rows[:9]):
        spark.createDataFrame(part, sessions.LINE).coalesce(1).write.mode("append").parquet(f"{root}/in")
        assert run() == []  # nothing has closed
    end.coalesce(1).write.mode("append").parquet(f"{root}/in")
    got = run()
    assert len(got) == len(want) and {g[0]: g for g in got} == want
    spark.createDataFrame(rows[:3], sessions.LINE).coalesce(1).write.mode("append").parquet(f"{root}/in")
    assert sorted(run()) == sorted(got)  # too late


def test_many_small_files_are_few_batches(spark, tmp_path):
    import os

    root = str(tmp_path)
    fields = {"session_id": F.concat(F.lit("s"), "path"), "text": F.concat(F.lit("said "), F.col("n").cast("string")), "type": F.lit("user")}
    rows = spark.range(120).select((F.col("id") % 12).cast("string").alias("path"), F.lit(0).cast("long").alias("block"), F.col("id").alias("n"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("at"))
    rows = rows.select("*", *(fields.get(f, F.lit(None).cast("array<string>" if f == "tools" else "string")).alias(f) for f in sessions._FIELDS))
    rows.repartition(40, "n").write.parquet(f"{root}/in")
    assert sum(f.endswith(".parquet") for f in os.listdir(f"{root}/in")) > 25
    sessions.replay(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint")
    last = rows.where("n = 0").withColumns({"path": F.lit("end"), "at": F.timestamp_seconds(F.lit(1_800_000_000))})
    last.write.mode("append").parquet(f"{root}/in")
    sessions.replay(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint")
    assert sum(not f.startswith(".") for f in os.listdir(f"{root}/checkpoint/commits")) <= 5
    pages = {r.path: r.n_messages for r in spark.read.schema(sessions.PAGE).parquet(f"{root}/out").collect()}
    assert pages == {str(k): 10 for k in range(12)}
