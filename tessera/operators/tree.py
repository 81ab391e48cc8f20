"""Hash trees of corpora: two of them are compared from the root down, into branches that differ only.

A row's place is the hash of its key, its line the hash of what it says. A node stands for the rows whose places share their
first digits; what it knows of them are sums of parts of their lines' hashes, so nodes are made by sums that combine before
they are shuffled, whatever a branch's size or the order of rows, and a parent's are the sums of its children's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a leaf has at most on average, digits from one level to the next, and of the deepest level.
LEAF, STEP, DEEPEST = 64, 2, 8
_SUMS = ["s0", "s1", "s2", "s3"]
_WIDE = "decimal(38,0)"


@dataclass
class Tree:
    """``rows`` (branch, id, place, line) and ``nodes`` (digits, place, n, hash, ...), as written."""

    rows: DataFrame
    nodes: DataFrame
    depth: int


def line(key: Column, *says: Column) -> Column:
    """The hash of a row; null and the word for it differ."""
    return F.sha2(F.to_json(F.struct(key.alias("k"), *(c.alias(f"c{i}") for i, c in enumerate(says))), {"ignoreNullFields": "false"}), 256)


def build(rows: DataFrame, path: str, key: str = "id", says: tuple[str, ...] = ("doc_sha256", "meta_sha256")) -> Tree:
    """The tree of ``rows`` (key, says ...), one row a key, written below ``path``."""
    spark = rows.sparkSession
    placed = rows.select(F.col(key).alias("id"), F.left(F.sha2(F.col(key).cast("string"), 256), F.lit(16)).alias("place"), line(F.col(key), *map(F.col, says)).alias("line"))
    branch = F.left("place", F.lit(STEP))
    placed.withColumn("branch", branch).repartition("branch").sortWithinPartitions("branch", "place").write.partitionBy("branch").parquet(f"{path}/rows")
    stored = _rows(spark, path, dict(rows.dtypes)[key])
    n, depth = stored.count(), STEP
    while depth < DEEPEST and n > LEAF * 16**depth:
        depth += STEP
    sums = [F.sum(F.conv(F.substring("line", 1 + 15 * i, 15), 16, 10).cast(_WIDE)).cast(_WIDE).alias(s) for i, s in enumerate(_SUMS)]
    level = stored.groupBy(F.left("place", F.lit(depth)).alias("place")).agg(F.count("*").alias("n"), *sums)
    for digits in range(depth, -1, -STEP):
        if digits < depth:
            level = spark.read.parquet(f"{path}/nodes/digits={digits + STEP}").groupBy(F.left("place", F.lit(digits)).alias("place")).agg(F.sum("n").alias("n"), *(F.sum(s).cast(_WIDE).alias(s) for s in _SUMS))
        level.withColumn("hash", F.sha2(F.concat_ws(":", F.col("n").cast("string"), *(F.col(s).cast("string") for s in _SUMS)), 256)).write.parquet(f"{path}/nodes/digits={digits}")
    return read(spark, path, dict(rows.dtypes)[key])


def _rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(f"id {kind}, place string, line string, branch string").parquet(f"{path}/rows")


def read(spark: SparkSession, path: str, key_type: str = "bigint") -> Tree:
    nodes = spark.read.option("basePath", f"{path}/nodes").parquet(f"{path}/nodes")
    return Tree(_rows(spark, path, key_type), nodes, nodes.agg(F.coalesce(F.max("digits"), F.lit(STEP))).first()[0])


def root(tree: Tree) -> str | None:
    """The hash of the whole corpus; None for an empty one."""
    found = tree.nodes.where("digits = 0").select("hash").head()
    return found and found.hash


def differing(old: Tree, new: Tree) -> tuple[list[DataFrame], int]:
    """For each side the rows (id, line) in leaves that differ, and the number of digits of a leaf. Levels are read from the top, each
    only below nodes that differ."""
    depth, below = min(old.depth, new.depth), None
    branches: list[str] = []
    for digits in range(0, depth + 1, STEP):
        sides = [t.nodes.where(F.col("digits") == digits).select("place", "hash") for t in (old, new)]
        if below is not None:
            sides = [s.join(below.withColumnRenamed("place", "up"), F.left("place", F.lit(digits - STEP)) == F.col("up"), "left_semi") for s in sides]
        a, b = sides[0], sides[1].withColumnRenamed("hash", "other")
        below = a.join(b, "place", "full_outer").where(~F.col("hash").eqNullSafe(F.col("other"))).select("place")
        if digits == STEP:
            branches = [r.place for r in below.collect()]  # 256 at most; folders of other rows aren't opened
    leaf = below.withColumnRenamed("place", "leaf")
    rows = [t.rows.where(F.col("branch").isin(branches)).join(leaf, F.left("place", F.lit(depth)) == F.col("leaf"), "left_semi").select("id", "line") for t in (old, new)]
    return rows, depth


def changes(old: Tree, new: Tree) -> DataFrame:
    """(id, action): ``upsert`` or ``delete`` of every key that isn't the same in both; as :func:`store.sync_plan` without what is
    unchanged."""
    (a, b), _ = differing(old, new)
    both = a.join(b.withColumnRenamed("line", "now"), "id", "full_outer").where(~F.col("line").eqNullSafe(F.col("now")))
    return both.select("id", F.when(F.col("now").isNull(), "delete").otherwise("upsert").alias("action"))


def compared(old: Tree, new: Tree) -> int:
    """How many rows :func:`changes` compares, of both sides together."""
    (a, b), _ = differing(old, new)
    return a.count() + b.count()


def index_state(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """(id, meta, token_count, words): what an index knows of each document: its metadata, its number of words, and its postings as
    sums of their hashes. docs (id, project, kind, parent_id, token_count), postings (id, term, tf)."""
    parts = [F.sum(F.xxhash64("term", F.col("tf").cast("long"), F.lit(seed)).cast(_WIDE)).cast("string").alias(f"w{seed}") for seed in (1, 2)]
    words = postings.groupBy("id").agg(*parts)
    known = docs.select("id", line(F.col("id"), F.col("project"), F.col("kind"), F.col("parent_id")).alias("meta"), "token_count")
    return known.join(words, "id", "left").select("id", "meta", "token_count", F.concat_ws(":", "w1", "w2").alias("words"))
