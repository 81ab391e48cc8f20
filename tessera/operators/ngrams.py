"""Substring search by an n-gram index: the rarest grams of a string name candidates, the text confirms them.

Texts and strings are compared in lower case. A posting is a gram and the texts of one batch that have it, dealt out to folders by
gram, and a search opens those of the grams it has chosen. Postings are made where the texts are read, in one pass over their signs, so
building moves nothing between tasks but the number of each gram's texts. A string shorter than a gram has none, so it is looked for in
every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import staged

SIZE, PARTS = 3, 64
#: Texts whose postings are put together.
STRIDE = 1024
#: Grams of a string that its candidates must have; all others are left to the text.
RAREST = 3
#: Pairs of a text and a string that are sent to every task; more are joined by a shuffle.
SENT = 500_000
#: Signs of strings that are sent likewise.
SENT_SIGNS = 2_000_000


@dataclass
class Grams:
    """``postings`` (part, gram, texts), ``sizes`` (gram, n) and ``texts`` (n, id, low); a text's ``n`` stands for it in postings."""

    postings: DataFrame
    sizes: DataFrame
    texts: DataFrame


def codes(text: str) -> np.ndarray:
    """The distinct grams of a text, each as one number of its three signs; short texts have none."""
    signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique((signs[:-2] << 42) | (signs[1:-1] << 21) | signs[2:]) if len(signs) >= SIZE else np.zeros(0, np.int64)


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, texts) of batches of (n, low): each gram of a batch once, with the texts that have it."""
    for batch in (whole.slice(at, STRIDE) for whole in batches for at in range(0, whole.num_rows, STRIDE)):
        found = [codes(t or "") for t in batch.column(1).to_pylist()]
        sizes = [len(c) for c in found]
        if not sum(sizes):
            continue
        gram, n = np.concatenate(found), np.repeat(np.array(batch.column(0).to_pylist(), np.int64), sizes)
        order = np.argsort(gram, kind="stable")
        gram, n = gram[order], n[order]
        starts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(gram)].astype(np.int32)), pa.array(n))
        yield pa.RecordBatch.from_arrays([pa.array(gram[starts]), lists], names=["gram", "texts"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(needle, grams) of batches of (needle)."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codes(t).tolist() for t in batch.column(0).to_pylist()], pa.list_(pa.int64()))], names=["needle", "grams"])


def build(texts: DataFrame, path: str) -> Grams:
    """The index of ``texts`` (id, text), written below ``path``. A null text holds nothing."""
    spark = texts.sparkSession
    texts.select(F.monotonically_increasing_id().alias("n"), "id", F.lower("text").alias("low")).write.parquet(f"{path}/texts")
    posts = spark.read.parquet(f"{path}/texts").select("n", "low").mapInArrow(_posted, "gram long, texts array<long>")
    posts.withColumn("part", _part("gram")).write.partitionBy("part").parquet(f"{path}/postings")
    made = _postings(spark, path)
    made.groupBy("gram").agg(F.sum(F.size("texts")).alias("n")).write.parquet(f"{path}/sizes")
    return read(spark, path)


def _postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("gram long, texts array<long>, part int").parquet(f"{path}/postings")


def read(spark: SparkSession, path: str) -> Grams:
    return Grams(_postings(spark, path), spark.read.parquet(f"{path}/sizes"), spark.read.parquet(f"{path}/texts"))


def _part(gram: str) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")


def _sent(df: DataFrame, strings: DataFrame) -> DataFrame:
    """``df``, to be sent to every task where the strings that it follows from are few."""
    (size,) = strings.agg(F.coalesce(F.sum(F.length("needle") + 1), F.lit(0))).first()
    return F.broadcast(df) if size <= SENT_SIGNS else df


def _met(needles: DataFrame, index: Grams) -> DataFrame:
    """(needle, n): the texts that have the rarest grams of each of distinct strings (needle)."""
    asked = staged(needles.mapInArrow(_asked, "needle string, grams array<long>").select("needle", F.explode("grams").alias("gram")), "asked")
    sizes = index.sizes.join(_sent(asked.select("gram").distinct(), needles), "gram", "left_semi")
    sized = asked.join(sizes, "gram", "left").withColumn("size", F.coalesce("n", F.lit(0)))
    rare = sized.withColumn("k", F.row_number().over(Window.partitionBy("needle").orderBy("size", "gram"))).where(F.col("k") <= RAREST)
    chosen = staged(rare.withColumn("needed", F.count("*").over(Window.partitionBy("needle"))).where("size > 0").select("needle", "gram", "needed"), "grams")
    parts = [r.part for r in chosen.select(_part("gram").alias("part")).distinct().collect()]  # PARTS numbers at most
    met = index.postings.where(F.col("part").isin(parts)).select("gram", "texts").join(_sent(chosen, needles), "gram").select("needle", "needed", F.explode("texts").alias("n"))
    return met.groupBy("needle", "n").agg(F.count("*").alias("have"), F.first("needed").alias("needed")).where("have = needed").select("needle", "n")


def candidates(strings: DataFrame, index: Grams) -> DataFrame:
    """(sid, needle, n): the texts that have the rarest grams of each string (sid, needle in lower case) of ``SIZE`` signs or more.
    A string with a gram that no text has gets none."""
    return _met(strings.select("needle").distinct(), index).join(strings.select("sid", "needle"), "needle").select("sid", "needle", "n")


def containing(strings: DataFrame, index: Grams) -> DataFrame:
    """(sid, id): every text that holds the string (sid, text), in lower case. An empty string is in every text that isn't null, a null
    one in none."""
    low = staged(strings.select("sid", F.lower("text").alias("needle")).where(F.col("needle").isNotNull()), "strings")
    # a text is read once for all the strings that it may hold
    needles = low.where(F.length("needle") >= SIZE).select("needle").distinct()
    named = staged(_met(needles, index).groupBy("n").agg(F.collect_list("needle").alias("needles")), "candidates")
    pairs = named.agg(F.coalesce(F.sum(F.size("needles")), F.lit(0))).first()[0]
    met = index.texts.join(F.broadcast(named) if pairs <= SENT else named, "n")
    held = met.select("id", F.explode(F.filter("needles", lambda x: F.contains(F.col("low"), x))).alias("needle"))
    long, short = held.join(_sent(low, low), "needle").select("sid", "id"), low.where(F.length("needle") < SIZE)
    if not short.limit(1).count():
        return long
    return long.unionByName(index.texts.join(short, F.contains("low", F.col("needle"))).select("sid", "id"))
