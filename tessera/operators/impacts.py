"""Exact BM25 top-k that skips postings which can't matter.

A term's postings are stored by impact, the part of the score that doesn't depend on the question, in blocks of ``BLOCK`` with
their largest impact. For a question

1. the best blocks of its rarest terms give ``k`` documents, whose whole scores are worked out: the least of them, theta, is
   a score that the k-th best document has at least;
2. the commonest terms are left unread, as many as can add up to ``LEFT`` of theta at their best. Of another term a block is read
   if its largest impact can reach theta with all other terms at their best; a document with a posting below can't;
3. documents that could still reach theta with all that was left unread get what those terms add, from their own words.

A long list is dealt out into lists of about ``LIST`` postings, so no task orders a common term alone. Nothing is dropped: the
result is that of :func:`lexical.keyword_topk`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import BM25_B, BM25_K1, KEYWORD_CANDIDATES
from ..staging import staged
from .index import Index
from .lexical import query_terms, top

BLOCK, LIST = 128, 100_000
#: Folders that blocks are dealt out to by their term; a search opens those of its terms.
PARTS = 64
#: Scores are rounded to six places before they are ranked, so a bound must be missed by more than that to count.
CLOSE = 2e-6
#: More leaves more unread, but more documents to look up.
LEFT = 0.6
#: Postings of the rarest terms that are read first, and documents scored to get theta, times ``k``.
FIRST, TRIED = 60, 2


@dataclass
class Impacts:
    """``blocks`` (part, term, piece, block, best, n, posts of (id, impact)), ``heads`` (term, df, best), ``forward`` (id, words of (term,
    impact)) and ``stats`` (n_docs, ...)."""

    blocks: DataFrame
    heads: DataFrame
    forward: DataFrame
    stats: DataFrame


def _impact() -> Column:
    return F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * (F.col("token_count") / F.col("avgdl"))))


def build(index: Index, path: str) -> Impacts:
    """The tables for a stored index, written below ``path``."""
    spark = index.postings.sparkSession
    posts = index.postings.crossJoin(F.broadcast(index.stats)).select("term", "id", _impact().alias("impact"))
    piece = F.pmod(F.xxhash64("id"), F.floor(F.col("df") / LIST).cast("long") + 1).cast("int")
    order = F.row_number().over(Window.partitionBy("term", "piece").orderBy(F.desc("impact"), "id"))
    placed = posts.join(index.terms.select("term", "df"), "term").withColumn("piece", piece).withColumn("block", F.floor((order - 1) / BLOCK).cast("int"))
    blocks = placed.groupBy("term", "piece", "block").agg(F.max("impact").alias("best"), F.count("*").cast("int").alias("n"), F.collect_list(F.struct("id", "impact")).alias("posts"))
    part = F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int")
    blocks.withColumn("part", part).repartition("part", F.pmod(F.xxhash64("term", "piece"), F.lit(4))).sortWithinPartitions("part", "term", "piece", "block").write.partitionBy("part").parquet(f"{path}/blocks")
    stored = _blocks(spark, path)
    stored.groupBy("term").agg(F.sum("n").alias("df"), F.max("best").alias("best")).write.parquet(f"{path}/heads")
    posts.groupBy("id").agg(F.collect_list(F.struct("term", "impact")).alias("words")).write.parquet(f"{path}/forward")  # a group is one document
    index.stats.write.parquet(f"{path}/stats")
    return read(spark, path)


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, piece int, block int, best double, n int, posts array<struct<id: string, impact: double>>, part int").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> Impacts:
    return Impacts(_blocks(spark, path), *(spark.read.parquet(f"{path}/{name}") for name in ("heads", "forward", "stats")))


def _scores(pairs: DataFrame, asked: DataFrame, forward: DataFrame) -> DataFrame:
    """(qid, id, added, looked_up): what the terms ``asked`` (qid, term, idf) add to the score of (qid, id), from the documents' own words."""
    words = pairs.join(forward, "id").select("qid", "id", F.explode("words").alias("w")).select("qid", "id", F.col("w.term").alias("term"), F.col("w.impact").alias("impact"))
    return words.join(asked.select("qid", "term", "idf"), ["qid", "term"]).groupBy("qid", "id").agg(F.sum(F.col("idf") * F.col("impact")).alias("added"), F.count("*").alias("looked_up"))


@dataclass
class Search:
    """The steps of a search, staged, and what each of them read."""

    asked: DataFrame
    first: DataFrame
    known: DataFrame
    met: DataFrame
    scored: DataFrame
    k: int

    def result(self) -> DataFrame:
        """(qid, id, score, rank)."""
        return top(self.scored.select("qid", "id", F.round(-F.col("total"), 6).alias("score")), [F.col("score"), F.col("id")], self.k)

    def read(self) -> DataFrame:
        """(qid, n_postings, n_read): postings of the question's terms, and how many of them were read or looked up."""
        every = self.asked.groupBy("qid").agg(F.sum("df").alias("n_postings"))
        parts = [self.first.select("qid", F.col("n_posts").alias("n")), self.met.select("qid", F.col("n_posts").alias("n")), self.known.select("qid", F.col("looked_up").alias("n")), self.scored.select("qid", F.col("looked_up").alias("n"))]
        return every.join(parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]).groupBy("qid").agg(F.sum("n").alias("n_read")), "qid", "left")


def search(queries: DataFrame, index: Impacts, k: int = KEYWORD_CANDIDATES, allowed: DataFrame | None = None) -> Search:
    """The ``k`` best documents for each question (qid, text). ``allowed`` (id) restricts documents, never statistics."""
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    terms = query_terms(queries).join(index.heads, "term").crossJoin(F.broadcast(index.stats.select("n_docs")))
    asked = staged(terms.select("qid", "term", "df", idf.alias("idf"), (idf * F.col("best")).alias("bound")), "asked")
    parts = [r.part for r in asked.select(F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int").alias("part")).distinct().collect()]  # PARTS numbers at most
    blocks = index.blocks.where(F.col("part").isin(parts))
    only = (lambda df: df) if allowed is None else (lambda df: df.join(allowed.select("id"), "id", "left_semi"))

    def met_by(chosen: DataFrame) -> DataFrame:
        """(qid, id, part, n_posts) of the postings in ``chosen`` (qid, idf, posts)."""
        rows = chosen.select("qid", "idf", F.explode("posts").alias("p")).select("qid", F.col("p.id").alias("id"), (F.col("idf") * F.col("p.impact")).alias("part"))
        return only(rows.groupBy("qid", "id").agg(F.sum("part").alias("part"), F.count("*").alias("n_posts")))

    # 1: the rarest terms until there is enough to choose from
    before = F.coalesce(F.sum("df").over(Window.partitionBy("qid").orderBy(F.desc("idf"), "term").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rare = asked.withColumn("before", before).where(F.col("before") < FIRST * k).select("qid", "term", "idf")
    first = staged(met_by(rare.join(blocks.where("block < 8"), "term")), "first")
    known = staged(_scores(top(first, [F.desc("part"), F.col("id")], TRIED * k).select("qid", "id"), asked, index.forward), "known")
    theta = top(known, [F.desc("added"), F.col("id")], k).where(F.col("rank") == k).select("qid", F.col("added").alias("theta"))

    # 2: bounds of terms and blocks
    up = Window.partitionBy("qid").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    edge = F.coalesce("theta", F.lit(0.0)) - CLOSE
    bounded = asked.join(theta, "qid", "left").select("*", edge.alias("edge"), F.sum("bound").over(up).alias("upto"), (F.sum("bound").over(Window.partitionBy("qid")) - F.col("bound")).alias("others"))
    bounded = staged(bounded.withColumn("unread", F.col("upto") < LEFT * F.col("edge")), "bounds")
    met = staged(met_by(bounded.where(~F.col("unread")).join(blocks, "term").where(F.col("idf") * F.col("best") + F.col("others") >= F.col("edge"))), "met")

    # 3: what the terms left unread add to what can still get there
    edges = bounded.groupBy("qid").agg(F.first("edge").alias("edge"), F.sum(F.when(F.col("unread"), F.col("bound")).otherwise(0.0)).alias("spare"))
    able = met.join(edges, "qid").where(F.col("part") + F.col("spare") >= F.col("edge")).select("qid", "id", "part")
    rest = _scores(able.select("qid", "id"), bounded.where("unread"), index.forward)
    scored = able.join(rest, ["qid", "id"], "left").select("qid", "id", (F.col("part") + F.coalesce("added", F.lit(0.0))).alias("total"), F.coalesce("looked_up", F.lit(0)).alias("looked_up"))
    return Search(asked, first, known, met, staged(scored, "scored"), k)


def keyword_topk(queries: DataFrame, index: Impacts, k: int = KEYWORD_CANDIDATES, allowed: DataFrame | None = None) -> DataFrame:
    """(qid, id, score, rank), equal to :func:`lexical.keyword_topk`."""
    return search(queries, index, k, allowed).result()
