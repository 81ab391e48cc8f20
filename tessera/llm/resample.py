"""Target-distribution importance resampling by hashed words, in two passes over the texts.

The first pass counts hashed features: each task makes one vector of bucket counts with ``np.bincount``, and ``treeReduce``
adds the vectors up, so that neither the driver nor any task holds more than a few of them. A bucket's gain is the log ratio of
its share in the target and in the documents. The second pass gathers the broadcast gains of each document's buckets and sums
them by document, again by ``np.bincount``. Gumbel noise that depends on the document's id alone turns the draw without
replacement into taking the highest scores.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, staged

#: A word in UTF-8, after A-Z are lower-cased: digits, letters and every byte beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xFF]+")
#: Features whose bucket a task remembers.
MEMO = 200_000
#: Ranges of score into which the drawn part is searched.
BINS = 4096


class Buckets:
    """The buckets of a text's features: all runs of 1 to ``run`` consecutive words."""

    def __init__(self, buckets: int, run: int):
        self.n, self.run, self.memo = buckets, run, {}

    def of(self, text: str | None) -> tuple[int, list[int]]:
        """How many words the text has, and its features' buckets."""
        words = WORD.findall(text.encode().lower()) if text else []  # bytes.lower() changes A-Z alone
        memo, out = self.memo, []
        if len(memo) > MEMO:
            memo.clear()
        for size in range(1, self.run + 1):
            for f in words if size == 1 else [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]:
                b = memo.get(f)
                if b is None:
                    b = memo[f] = zlib.crc32(f) % self.n
                out.append(b)
        return len(words), out


def bucket_counts(texts: DataFrame, buckets: int, run: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    settled(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = Buckets(buckets, run), np.zeros(buckets, np.int64)
        for batch in batches:
            found = [b for t in batch.column(0).to_pylist() for b in of.of(t)[1]]
            total += np.bincount(np.array(found, np.int64), minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    vectors = texts.select("text").mapInArrow(count, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    n = vectors.getNumPartitions()
    # a level of the tree for each factor of about 32 tasks, so no task adds up more vectors than that
    return vectors.treeReduce(lambda a, b: a + b, depth=max(2, 1 + int(np.log2(n) // 5))) if n else np.zeros(buckets, np.int64)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio of shares) of each bucket."""
    n = len(source)
    s, t = source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, run: int) -> DataFrame:
    """doc_id, n_words, n_features, weight of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value.astype(np.float64)  # sums of whole numbers, exact below 2^53
        of = Buckets(len(g), run)
        for batch in batches:
            n, words, sizes, found = batch.num_rows, [], [], []
            for t in batch.column("text").to_pylist():
                k, b = of.of(t)
                words.append(k)
                sizes.append(len(b))
                found.append(np.array(b, np.int64))
            at = np.repeat(np.arange(n), sizes)
            b = np.concatenate(found) if found else np.zeros(0, np.int64)
            w = np.bincount(at, weights=g[b], minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(w)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, seed: int = 2024, percent: int = 10, buckets: int = 10_000, run: int = 1, least_words: int = 20) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null for those not drawn.

    Of the documents with at least ``least_words`` words, ``percent`` in a hundred (rounded down) are drawn, by score and then
    by smaller doc_id. A null or empty text has no features and weight 0. A null doc_id has no noise, so its score is null and
    it is never drawn, but counts among those drawn from. Repeated rows are drawn each; between rows that agree in all columns
    it doesn't matter which gets the earlier rank, between rows of one doc_id the greater weight goes first, then more features.
    An empty target or an empty table are as good as any. Other columns are ignored.
    """
    gain = gains(bucket_counts(docs, buckets, run), bucket_counts(target, buckets, run))
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), F.lit(8)), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = staged(weights(docs, gain, run).select("*", (F.col("weight") + noise).alias("score"), F.monotonically_increasing_id().alias("row")), "scores")
    may = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    facts = scored.agg(F.count_if(F.col("n_words") >= least_words).alias("n"), F.count_if(may).alias("may"), F.min(F.when(may, F.col("score"))).alias("low"), F.max(F.when(may, F.col("score"))).alias("high")).first()
    drawn = min(percent * facts.n // 100, facts.may)
    none = F.lit(None).cast("long").alias("rank")
    out = ["doc_id", "n_features", "weight", "score"]
    if not drawn:
        return scored.select(*out, none)
    # the ranges of score from the top that together hold the drawn ones; only their rows are sorted
    width = (facts.high - facts.low) // BINS + 1
    held, edge = 0, facts.high
    for r in sorted(scored.where(may).groupBy(F.expr(f"(score - {facts.low}L) div {width}L").alias("bin")).count().collect(), key=lambda r: -r.bin):
        held, edge = held + r["count"], facts.low + r.bin * width
        if held >= drawn:
            break
    among = may & (F.col("score") >= edge)
    by = [F.desc("score"), F.asc("doc_id"), F.desc("weight"), F.desc("n_features"), F.asc("row")]  # row: rows alike in all else may be split, too
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = staged(scored.where(among).repartitionByRange(parts, *by).sortWithinPartitions(*by).select(*out, F.monotonically_increasing_id().alias("place")), "ranked")
    part = F.shiftright("place", 33)
    before, starts = 0, []
    for r in sorted(ordered.groupBy(part.alias("part")).count().collect(), key=lambda r: r.part):  # a row for each sorted partition
        starts.append((r.part, before))
        before += r["count"]
    offsets = F.broadcast(spark.createDataFrame(starts, "part long, before long"))
    ranked = ordered.withColumn("part", part).join(offsets, "part").withColumn("rank", F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    ranked = ranked.select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return scored.where(~F.coalesce(among, F.lit(False))).select(*out, none).unionAll(ranked)


_SQL_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_WORDS = f"regexp_extract_all({_SQL_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: CRC-32 in SQL: the table of 256 remainders by eight steps of its polynomial, then one look-up a byte of each distinct word.
ORACLE = f"""
WITH RECURSIVE steps(b, c, i) AS (SELECT b, b, 0 FROM (SELECT CAST(unnest(range(0, 256)) AS BIGINT) AS b) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i + 1 FROM steps WHERE i < 8
), tab AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM steps WHERE i = 8
), dw AS MATERIALIZED (SELECT doc_id, rowid AS r, unnest(w) AS word FROM (SELECT doc_id, row_number() OVER () AS rowid, {_SQL_WORDS} AS w FROM documents)
), docs AS MATERIALIZED (SELECT doc_id, r, len(w) AS n FROM (SELECT doc_id, row_number() OVER () AS r, {_SQL_WORDS} AS w FROM documents)
), bw AS MATERIALIZED (SELECT unnest({_SQL_WORDS}) AS word FROM benchmark
), hexed AS MATERIALIZED (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)
), bytes AS MATERIALIZED (SELECT word, list_transform(range(0, length(h) // 2), lambda j: CAST(('0x' || substring(h, CAST(2 * j + 1 AS INTEGER), 2)) AS BIGINT)) AS bs FROM hexed
), hashed AS MATERIALIZED (SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bs), lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS INTEGER)])), 4294967295) % 10000 AS bucket FROM bytes, tab
), s AS MATERIALIZED (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (word) GROUP BY bucket
), t AS MATERIALIZED (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (word) GROUP BY bucket
), sizes AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS sn, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS tn
), gain AS MATERIALIZED (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (sn + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (tn + 10000)))) AS BIGINT) AS g FROM s FULL JOIN t USING (bucket), sizes
), w AS MATERIALIZED (SELECT r, CAST(sum(g) AS BIGINT) AS weight FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY r
), scored AS (SELECT doc_id, r, n, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('2024:' || doc_id), 8) AS BIGINT)::DOUBLE + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM docs LEFT JOIN w USING (r)
), ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, weight DESC, n DESC) AS rank FROM scored WHERE n >= 20 AND score IS NOT NULL)
SELECT doc_id, n AS n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM docs WHERE n >= 20) THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)
"""
