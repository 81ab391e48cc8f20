"""Two-pass external shuffle, in DataFrame functions alone.

Pass one scatters records uniformly into memory-sized buckets by a seeded hash. Pass two puts each bucket into its
canonical order (by that hash), shuffles it by Fisher-Yates, whose draws are hashes of the seed, the bucket and the place,
and lays the buckets end to end; the stream so made is cut into shards whose row counts are at most one apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import drop_at_exit, shared_path

#: A bucket's records are held in memory together: so many bytes and rows of them on average.
BUCKET_BYTES, BUCKET_ROWS = 64 << 20, 512
#: Rows that one chunk of a repeated row makes, and buckets whose sizes add up in one task.
COPY_CHUNK, GROUP = 4096, 4096


def bucket_count(total_bytes: int, n_rows: int, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> int:
    return max(1, -(-int(total_bytes) // bucket_bytes), -(-int(n_rows) // bucket_rows))


def fisher_yates(n: Column, draw) -> Column:
    """A permutation of 0 to ``n`` - 1 as an array: each ``i`` in turn takes the place ``draw(i)`` (0 to ``i``), and what stood
    there moves to the end. Arrays are copied at each step, so ``n`` should be some hundreds."""

    def put(a: Column, i: Column) -> Column:
        j = draw(i)
        return F.when(j == i, F.concat(a, F.array(i))).otherwise(F.concat(F.slice(a, F.lit(1), j), F.array(i), F.slice(a, j + 2, i - j - 1), F.array(F.element_at(a, j + 1))))

    empty = F.slice(F.sequence(F.lit(0), F.lit(0)), 1, 0)
    return F.aggregate(F.sequence(F.lit(0), n - 1), empty, put)


def running_offsets(sizes: DataFrame) -> DataFrame:
    """__bucket and __offset (rows in earlier buckets) of ``sizes`` (__bucket, __n); sums by group first, so no task gets all buckets."""
    group = F.expr(f"__bucket div {GROUP}").alias("__group")
    sizes = sizes.select("*", group)
    earlier = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sizes.groupBy("__group").agg(F.sum("__n").alias("__n")).select("__group", earlier(Window.orderBy("__group")).alias("__before"))
    inside = sizes.select("__group", "__bucket", earlier(Window.partitionBy("__group").orderBy("__bucket")).alias("__in"))
    return inside.join(groups, "__group").select("__bucket", (F.col("__before") + F.col("__in")).alias("__offset"))


def scatter_and_shuffle(rows: DataFrame, hash_cols: list[Column], n_rows: int, n_buckets: int, n_shards: int, seed: int) -> DataFrame:
    """``rows`` with ``shard`` (int) and ``slot`` (long, from 0 without gaps in each shard).

    ``hash_cols`` tell rows apart: rows that agree in all of them meet in one bucket, so callers number repeated rows
    first (:func:`numbered_copies`). Columns of ``rows`` may have any names but ``__h``, ``__bucket``, ``__rec``.
    No rows give no rows. Shards and slots follow from the rows, the seed and the counts alone.
    """
    h = F.xxhash64(F.lit(seed), *hash_cols)
    keyed = rows.select(h.alias("__h"), F.pmod(F.xxhash64(F.lit(seed + 1), h), F.lit(n_buckets)).cast("int").alias("__bucket"), F.struct("*").alias("__rec"))
    offsets = running_offsets(keyed.groupBy("__bucket").agg(F.count("*").alias("__n")))
    buckets = keyed.repartition(F.col("__bucket")).groupBy("__bucket").agg(F.sort_array(F.collect_list(F.struct("__h", "__rec"))).alias("__recs"))
    draw = lambda i: F.pmod(F.xxhash64(F.lit(seed + 2), F.col("__bucket"), i), (i + 1).cast("long")).cast("int")
    order = fisher_yates(F.size("__recs"), draw)
    placed = buckets.join(offsets, "__bucket").select("__offset", "__recs", order.alias("__order"))
    mixed = placed.select("__offset", F.posexplode(F.transform("__order", lambda i: F.element_at(F.col("__recs"), i + 1))).alias("__pos", "__x"))
    rank = (F.col("__offset") + F.col("__pos")).cast("long")
    shard = F.expr(f"cast((__rank * {n_shards}L) div {max(n_rows, 1)}L as int)")
    first = F.expr(f"(shard * {n_rows}L + {n_shards - 1}L) div {n_shards}L")
    return mixed.select(rank.alias("__rank"), F.col("__x.__rec").alias("__rec")).withColumn("shard", shard).select("__rec.*", "shard", (F.col("__rank") - first).alias("slot"))


def numbered_copies(rows: DataFrame, cols: list[str], name: str = "copy") -> DataFrame:
    """The distinct rows over ``cols``, each as often as it came, with the copy's number in the column ``name``.

    Counting combines on the map side and large counts are dealt out in chunks, so one row that makes up a third of
    the table doesn't gather in one task.
    """
    counted = rows.groupBy(*cols).agg(F.count("*").alias("__c"))
    chunks = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__c - 1) div {COPY_CHUNK}"))).alias("__chunk")).repartition(*cols, "__chunk")
    end = F.least(F.col("__c"), (F.col("__chunk") + 1) * COPY_CHUNK) - 1
    return chunks.select(*cols, F.explode(F.sequence(F.col("__chunk") * COPY_CHUNK, end)).alias(name))


def digests(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes + 8) and CRC-32 of each row, and the columns ``more``; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(*more, F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def assign_shards(digest_rows: DataFrame, n_shards: int = 24, seed: int = 17) -> DataFrame:
    """Shard and slot of every row of :func:`digests`, under the law ``rows``.

    Null ids, repeated rows and empty texts are rows like others; an empty table gives an empty result. The result
    depends on the rows and the seed, not on how they are partitioned.
    """
    n_rows, total = digest_rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    copies = numbered_copies(digest_rows, ["doc_id", "size", "text_crc32"])
    cols = [F.col(c) for c in ("doc_id", "size", "text_crc32", "copy")]
    out = scatter_and_shuffle(copies, cols, n_rows, bucket_count(total, n_rows), n_shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(df: DataFrame, path: str, n_shards: int, key_cols: list[str], size_col: Column, seed: int = 17) -> None:
    """Write whole records, shuffled, as ``path/shard=N/part-*.parquet``; ``slot`` orders a shard's rows.

    ``key_cols`` should tell rows apart; if some rows agree in them, all columns do, and the numbers of equal rows' copies.
    The files depend on the rows and the seed, not on how the rows are partitioned. Records keep their own columns; ones
    called ``shard`` or ``slot`` must be renamed first. An empty table leaves a folder without records.
    """
    n_rows, total = df.agg(F.count("*"), F.coalesce(F.sum(size_col), F.lit(0))).first()
    cols = [F.col(c) for c in key_cols]
    if df.groupBy(*key_cols).count().where("count > 1").limit(1).count():
        df = numbered_copies(df, df.columns, "__copy")
        cols = [F.col(c) for c in df.columns]
    out = scatter_and_shuffle(df, cols, n_rows, bucket_count(total, n_rows), n_shards, seed).drop("__copy")
    out.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, n_shards: int = 24, seed: int = 17) -> DataFrame:
    """Write the records of ``docs`` (doc_id, text, more) into the shared folder by :func:`write_shards`; give the digests,
    shard and slot of every row of those files, under the law ``rows``.

    Null ids, repeated rows and empty texts are rows like others; an empty table gives an empty result. A record's own
    ``shard`` and ``slot`` are written as ``own_shard`` and ``own_slot``.
    """
    docs = docs.withColumnsRenamed({c: f"own_{c}" for c in ("shard", "slot") if c in docs.columns})
    path = shared_path(docs.sparkSession, "shards")
    write_shards(docs, path, n_shards, ["doc_id"], F.octet_length(F.coalesce("text", F.lit(""))) + 8, seed)
    drop_at_exit(docs.sparkSession, path)
    files = docs.sparkSession.read.schema(StructType([*docs.schema, StructField("slot", LongType()), StructField("shard", IntegerType())])).parquet(path)
    return digests(files, "shard", "slot").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
