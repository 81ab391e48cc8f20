"""k nearest neighbours of all vectors by neighbour descent: a neighbour of a neighbour is likely one, too.

Every vector starts with the nearest of a few rows that lie beside it in the lists of a vector index, and of a few at random, which
lead out of its list. In a round each vector is
a centre whose neighbours, and the vectors whose neighbour it is, are compared with each other, if one of the two is new to its
list; what is nearer than a vector's worst neighbour is passed on, and the best ``width`` are kept. Rounds end when few lists
change. A round compares about n x width^2 pairs, is joins and grouping by id throughout, and collects two numbers.

A hub is the neighbour of many. Its own centre takes its ``width`` best of those, which Spark cuts down before the shuffle
(a limit for each group), and the rows that need its vector are a join that may be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import staged
from .ivf import VectorIndex
from .lexical import top

#: Rows beside each other among which a vector's first neighbours are sought.
SEEDS = 64

_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _units(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    return x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n)


def _as_batch(a: list, b: list, s: list, pairs: int, kind: pa.DataType) -> pa.RecordBatch:
    """Found pairs, and a row without ids for the number of pairs that were compared."""
    return pa.RecordBatch.from_arrays([pa.array([*a, None], kind), pa.array([*b, None], kind), pa.array([*s, float(pairs)], pa.float64())], names=["id", "nid", "similarity"])


def _pairs(ids: list, x: np.ndarray, met: np.ndarray, least: np.ndarray, out: tuple[list, list, list]) -> int:
    """Compare the rows of ``x`` where ``met``; a pair goes to those of its two that it is good enough for. How many were compared."""
    s = np.round(x @ x.T, 6)
    both = np.triu(met, 1)
    for rows, cols in (np.nonzero(both & (s > least[:, None])), np.nonzero(both.T & (s > least[:, None]))):
        out[0].extend([ids[i] for i in rows.tolist()])
        out[1].extend([ids[j] for j in cols.tolist()])
        out[2].extend(s[rows, cols].tolist())
    return int(both.sum())


def _seeds(index: VectorIndex, width: int, order: list) -> DataFrame:
    """(id, nid, similarity): the best ``width`` of the rows beside each vector in an order."""
    kind = dict(index.vectors.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        rows: list = []

        def found() -> pa.RecordBatch:
            x = _units(rows)
            s = np.round(x @ x.T, 6)
            np.fill_diagonal(s, -np.inf)
            near = np.argsort(-s, axis=1, kind="stable")[:, : min(width, len(ids) - 1)]
            n = near.shape[1]
            at = near.reshape(-1).tolist()
            return _as_batch([i for i in ids for _ in range(n)], [ids[j] for j in at], np.take_along_axis(s, near, 1).reshape(-1).tolist(), len(ids) * (len(ids) - 1) // 2, _ARROW[kind])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                rows.append(v)
                if len(ids) == 2 * SEEDS:  # so that the last group isn't a small one
                    later, late = ids[SEEDS:], rows[SEEDS:]
                    del ids[SEEDS:], rows[SEEDS:]
                    yield found()
                    ids, rows = later, late
        if len(ids) > 1:
            yield found()

    spark = index.vectors.sparkSession
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), index.vectors.count() // (8 * SEEDS) + 1)
    beside = index.vectors.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "vector")
    return beside.mapInArrow(run, f"id {kind}, nid {kind}, similarity double")


def _local(members: DataFrame, kind: str) -> DataFrame:
    """Pairs of the members of each centre (center, id, fresh, least, vector), sorted by center within partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, n, out = None, [], 0, ([], [], [])

        def compared() -> int:
            ids, fresh, least, rows = zip(*group)
            f = np.array(fresh)
            return _pairs(list(ids), _units(rows), f[:, None] | f[None, :], np.array(least), out) if f.any() and len(ids) > 1 else 0

        for b in batches:
            for center, *row in zip(*(c.to_pylist() for c in b.columns)):
                if center != now and group:
                    n += compared()
                    group = []
                now = center
                group.append(row)
            if len(out[0]) > 100_000:
                yield _as_batch(*out, n, _ARROW[kind])
                n, out = 0, ([], [], [])
        if group:
            n += compared()
        if n:
            yield _as_batch(*out, n, _ARROW[kind])

    return members.mapInArrow(run, f"id {kind}, nid {kind}, similarity double")


def descend(index: VectorIndex, k: int = 6, width: int = 24, rounds: int = 12, settled: float = 0.002) -> tuple[DataFrame, dict[str, int]]:
    """(id, neighbour, similarity, rank) and what it took: rounds, and pairs that were compared.

    Ids are unique, as in a store. Rounds end when less than ``settled`` of all list entries are new. A single vector has no
    neighbour. Vectors that the index leaves out (null, zero) have none and are nobody's.
    """
    kind = dict(index.vectors.dtypes)["id"]
    width = max(k, width)
    best = [F.col("similarity").desc(), F.col("nid")]
    pairs = 0
    half = -(-width // 2)
    seeds = _seeds(index, half, ["list", F.xxhash64("id")]).unionAll(_seeds(index, half, [F.xxhash64("id", F.lit(1))]))
    found = staged(seeds, "descent-seeds")
    count = lambda df: int(df.where("id IS NULL").agg(F.coalesce(F.sum("similarity"), F.lit(0.0))).first()[0])
    pairs += count(found)
    first = found.where("id IS NOT NULL").groupBy("id", "nid").agg(F.max("similarity").alias("similarity")).withColumn("fresh", F.lit(True))
    edges = staged(first, "descent-edges")
    done = 0
    for done in range(1, rounds + 1):
        back = top(edges.select(F.col("nid").alias("center"), F.col("id").alias("member"), "fresh", "similarity"), [F.col("similarity").desc(), F.col("member")], width, "center")
        around = edges.select(F.col("id").alias("center"), F.col("nid").alias("member"), "fresh").unionByName(back.select("center", "member", "fresh"))
        around = around.groupBy("center", "member").agg(F.bool_or("fresh").alias("fresh"))
        worst = edges.groupBy("id").agg(F.when(F.count("*") >= width, F.min("similarity")).otherwise(F.lit(-2.0)).alias("least"))
        nodes = index.vectors.select("id", "vector").join(worst, "id", "left").select("id", F.coalesce("least", F.lit(-2.0)).alias("least"), "vector")
        members = around.join(nodes, around.member == nodes.id).select("center", "id", "fresh", "least", "vector")
        found = staged(_local(members.repartition("center").sortWithinPartitions("center", "id"), kind), "descent-found")
        pairs += count(found)
        both = edges.select("id", "nid", "similarity", F.lit(False).alias("fresh")).unionByName(found.where("id IS NOT NULL").withColumn("fresh", F.lit(True)))
        merged = both.groupBy("id", "nid").agg(F.max("similarity").alias("similarity"), F.bool_and("fresh").alias("fresh"))
        edges = staged(top(merged, best, width, "id").drop("rank"), "descent-edges")
        new, total = edges.agg(F.count_if("fresh"), F.count("*")).first()
        if new <= settled * total:
            break
    near = top(edges, best, k, "id").select("id", F.col("nid").alias("neighbour"), "similarity", "rank")
    return near, {"rounds": done, "pairs": pairs}
