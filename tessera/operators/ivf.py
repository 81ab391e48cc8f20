"""An inverted-file vector index: k-means lists, product-quantised codes, exact scores for the best.

* Fitting: Lloyd's rounds as Spark jobs over a bounded sample (``Fit.sample`` vectors of least hash of their ids); every task adds
  up its own vectors, so only sums are shuffled. The codes' books are fitted in the same way on what the lists' centroids leave.
* The index has every vector: ``vectors`` (list, id, code, vector) and ``blocks`` (list, ids, codes), both partitioned by list. A
  block packs the codes of at most ``BLOCK`` rows of a list, so a large list is many rows like any other.
* A search packs the questions that probe a list likewise and joins packs with blocks by list: a joined row scores up to
  ``PACK`` x ``BLOCK`` pairs from a few kilobytes, neither side goes through the driver, and Spark may split a hot list. The
  ``refine`` best by code of each question are scored exactly, and only their vectors are read.

Sums are of whole numbers (components times 2^20), so the same vectors give the same index whatever the partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import MIN_SIMILARITY, VECTOR_CANDIDATES
from ..functions import vectors as vx
from ..staging import staged
from .lexical import top

BLOCK, PACK = 1024, 128
#: Best rows that a task holds before it passes them on.
HELD = 2_000_000
_ONE = 1 << 20
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


@dataclass(frozen=True)
class Fit:
    """``lists``: of a list, None for about the square root of the rows, 4,096 at most. ``sample``: bound of the vectors that
    are fitted. ``parts`` must divide the vectors' length; a code is one byte for each part."""

    lists: int | None = None
    sample: int = 100_000
    rounds: int = 6
    parts: int = 16
    codes: int = 256
    seed: int = 11


@dataclass
class VectorIndex:
    """``centroids`` (lists x length), ``books`` (parts x codes x length of a part), ``vectors``, ``blocks``."""

    centroids: np.ndarray
    books: np.ndarray
    vectors: DataFrame
    blocks: DataFrame


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column without nulls, whose rows are all of one length, as doubles."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1) if len(a) else np.zeros((0, 0))


def _unit(vectors: DataFrame, key: str) -> DataFrame:
    """(key, v): vectors of length 1. Null and zero vectors, and those with a null or non-finite component, are similar to nothing
    and left out, as are rows of null key."""
    v = F.transform("vector", lambda x: x.cast("double"))
    rows = vectors.select(key, v.alias("v"), vx.norm(F.col("vector")).alias("n"))
    return rows.where(f"{key} IS NOT NULL AND n > 0 AND n < double('infinity') AND NOT isnan(n)").select(key, F.transform("v", lambda x: (x / F.col("n")).cast("float")).alias("v"))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest of ``centres`` to each row; ties to the smaller number."""
    return np.argmax(x @ centres.T - (centres**2).sum(1) / 2, axis=1)


def _lloyd(rows: DataFrame, start: np.ndarray, rounds: int) -> np.ndarray:
    """K-means of the parts of ``v``, each by itself: ``start`` is parts x cells x length of a part; an empty cell stays."""
    parts, cells, d = start.shape
    centres = start

    for _ in range(rounds):

        def add_up(batches: Iterator[pa.RecordBatch], centres=centres) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((parts, cells, d + 1), np.int64)
            for b in batches:
                x = _matrix(b.column(0)).reshape(b.num_rows, parts, d)
                whole = np.concatenate([np.rint(x * _ONE).astype(np.int64), np.ones((len(x), parts, 1), np.int64)], 2)
                for p in range(parts):
                    np.add.at(sums[p], _nearest(x[:, p], centres[p]), whole[:, p])
            p, c = np.nonzero(sums[:, :, d])
            yield pa.RecordBatch.from_arrays([pa.array(p * cells + c, pa.int64()), pa.array(sums[p, c].tolist(), pa.list_(pa.int64()))], names=["cell", "s"])

        each = rows.select("v").mapInArrow(add_up, "cell long, s array<long>").select("cell", F.posexplode("s").alias("i", "x")).groupBy("cell", "i").agg(F.sum("x").alias("x"))
        sums = np.zeros((parts * cells, d + 1))
        for r in each.collect():  # as many rows as the model has numbers
            sums[r.cell, r.i] = r.x
        sums = sums.reshape(parts, cells, d + 1)
        got = sums[:, :, d] > 0
        centres = centres.copy()
        centres[got] = sums[got][:, :d] / sums[got][:, d:] / _ONE
    return centres


def fit(vectors: DataFrame, how: Fit = Fit()) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and books for ``vectors`` (id, vector); none for an empty table."""
    units = _unit(vectors, "id")
    n = units.count()
    sample = staged(units.orderBy(F.xxhash64("id", F.lit(how.seed)), "id").limit(how.sample).select("v"), "ivf-sample")
    cells = min(n, how.lists or max(1, min(4096, round(n**0.5))))
    start = np.array([r.v for r in sample.limit(cells).collect()], np.float64)
    if not len(start):
        return np.zeros((0, 0)), np.zeros((0, 0, 0))
    if start.shape[1] % how.parts:
        raise ValueError(f"{how.parts} parts don't divide a vector of {start.shape[1]}")
    centroids = _lloyd(sample, start[None], how.rounds)[0]

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(0))
            r = x - centroids[_nearest(x, centroids)] if len(x) else x
            yield pa.RecordBatch.from_arrays([pa.array(list(r.astype(np.float32)), pa.list_(pa.float32()))], names=["v"])

    rest = staged(sample.mapInArrow(left, "v array<float>"), "ivf-rest")
    first = np.array([r.v for r in rest.limit(how.codes).collect()], np.float64)
    return centroids, _lloyd(rest, first.reshape(len(first), how.parts, -1).transpose(1, 0, 2), how.rounds)


def build(vectors: DataFrame, path: str, how: Fit = Fit()) -> VectorIndex:
    """The index of ``vectors`` (id, vector), written below ``path``; ids are unique, as in a store."""
    spark = vectors.sparkSession
    centroids, books = fit(vectors, how)
    id_type = dict(vectors.dtypes)["id"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                to = _nearest(x, centroids)
                r = (x - centroids[to]).reshape(len(x), books.shape[0], -1)
                code = np.stack([_nearest(r[:, p], books[p]) for p in range(books.shape[0])], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), b.column(0), pa.array([c.tobytes() for c in code], pa.binary()), b.column(1)], names=["list", "id", "code", "vector"])

    schema = f"list int, id {id_type}, code binary, vector array<float>"
    coded = _unit(vectors, "id").mapInArrow(encode, schema) if len(centroids) else spark.createDataFrame([], schema)
    # a large list is dealt out over several tasks, a task's lists lie one after the other
    dealt = coded.repartition("list", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("list", "id")
    dealt.write.partitionBy("list").parquet(f"{path}/vectors")
    stored = spark.read.schema(schema).parquet(f"{path}/vectors")
    packed = stored.select("list", "id", "code").mapInArrow(lambda b: _packs(b, BLOCK, _ARROW[id_type], "codes"), f"list int, ids array<{id_type}>, codes binary")
    packed.write.partitionBy("list").parquet(f"{path}/blocks")
    model = [("centroid", i, c.tolist()) for i, c in enumerate(centroids)] + [("book", i, b.tolist()) for i, b in enumerate(books.reshape(-1, books.shape[-1] if books.size else 1))]
    shape = spark.createDataFrame([("shape", 0, [float(x) for x in books.shape]), *model], "kind string, i int, v array<double>")
    shape.coalesce(1).write.parquet(f"{path}/model")
    return read(spark, path, id_type)


def read(spark: SparkSession, path: str, id_type: str = "bigint") -> VectorIndex:
    """An index that was built; its model comes to the driver (4,096 centroids at most, and the books)."""
    rows = spark.read.parquet(f"{path}/model").orderBy("kind", "i").collect()
    of = {k: [r.v for r in rows if r.kind == k] for k in ("shape", "centroid", "book")}
    books = np.array(of["book"], np.float64).reshape([int(x) for x in of["shape"][0]])
    vectors = spark.read.schema(f"id {id_type}, code binary, vector array<float>, list int").parquet(f"{path}/vectors")
    blocks = spark.read.schema(f"ids array<{id_type}>, codes binary, list int").parquet(f"{path}/blocks")
    return VectorIndex(np.array(of["centroid"], np.float64), books, vectors, blocks)


def _packs(batches: Iterator[pa.RecordBatch], most: int, kind: pa.DataType, name: str) -> Iterator[pa.RecordBatch]:
    """Rows (list, key, bytes) as packs of at most ``most`` neighbours of one list: (list, keys, bytes one after another)."""
    now, keys, parts = None, [], []

    def pack() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([keys], pa.list_(kind)), pa.array([b"".join(parts)], pa.binary())], names=["list", "ids" if name == "codes" else "qids", name])

    for b in batches:
        for to, key, part in zip(*(c.to_pylist() for c in b.columns)):
            if keys and (to != now or len(keys) == most):
                yield pack()
                keys, parts = [], []
            now = to
            keys.append(key)
            parts.append(part)
    if keys:
        yield pack()


def probed(index: VectorIndex, queries: DataFrame, probes: int) -> DataFrame:
    """(list, qid, v): each question (qid, vector) with the ``probes`` lists whose centroids are most similar to it."""
    kind = dict(queries.dtypes)["qid"]
    centroids = index.centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            near = np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :probes]
            n = near.shape[1]
            at = np.repeat(np.arange(len(x)), n)
            raw = [r.tobytes() for r in x.astype(np.float32)]
            yield pa.RecordBatch.from_arrays([pa.array(near.reshape(-1), pa.int32()), b.column(0).take(pa.array(at)), pa.array([raw[i] for i in at], pa.binary())], names=["list", "qid", "v"])

    return _unit(queries, "qid").mapInArrow(run, f"list int, qid {kind}, v binary")


def candidates(index: VectorIndex, queries: DataFrame, probes: int, refine: int, skip_self: bool = False) -> DataFrame:
    """(qid, list, id): the ``refine`` rows of each question that are best by their codes in the lists it probes."""
    spark = index.blocks.sparkSession
    q_type, id_type = dict(queries.dtypes)["qid"], dict(index.vectors.dtypes)["id"]
    schema = f"qid {q_type}, list int, id {id_type}, near double"
    if not len(index.centroids):
        return spark.createDataFrame([], schema).drop("near")
    asked = staged(probed(index, queries, probes).repartition("list", F.pmod(F.xxhash64("qid"), F.lit(8))).sortWithinPartitions("list").mapInArrow(lambda b: _packs(b, PACK, _ARROW[q_type], "vs"), f"list int, qids array<{q_type}>, vs binary"), "ivf-asked")
    lists = [r.list for r in asked.select("list").distinct().collect()]  # at most the index's lists, so that others aren't opened
    books, centroids = index.books, index.centroids
    parts, _, d = books.shape

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size = 0

        def cut(got: list) -> tuple:
            near, to, ids = (np.concatenate(x) for x in zip(*got))
            if len(near) > refine:
                edge = np.partition(-near, refine - 1)[refine - 1]
                keep = np.flatnonzero(-near <= edge)
                keep = keep[np.lexsort((ids[keep].astype(str) if ids.dtype == object else ids[keep], -near[keep]))][:refine]
                near, to, ids = near[keep], to[keep], ids[keep]
            return near, to, ids

        def flush() -> Iterator[pa.RecordBatch]:
            for qid, got in held.items():
                near, to, ids = cut(got)
                yield pa.RecordBatch.from_arrays([pa.array([qid] * len(near), _ARROW[q_type]), pa.array(to, pa.int32()), pa.array(ids.tolist(), _ARROW[id_type]), pa.array(near)], names=["qid", "list", "id", "near"])
            held.clear()

        for b in batches:
            for to, qids, vs, ids, codes in zip(*(c.to_pylist() for c in b.columns)):
                q = np.frombuffer(vs, np.float32).astype(np.float64).reshape(len(qids), parts, d)
                code = np.frombuffer(codes, np.uint8).reshape(len(ids), parts)
                near = np.repeat((q.reshape(len(qids), -1) @ centroids[to])[:, None], len(ids), 1)
                for p in range(parts):
                    near += (q[:, p] @ books[p].T)[:, code[:, p]]
                near = np.round(near, 6)
                names = np.array(ids, np.int64 if id_type != "string" else object)
                for a, qid in enumerate(qids):
                    mine = near[a], np.full(len(ids), to), names
                    if skip_self and (own := names == qid).any():
                        mine = tuple(x[~own] for x in mine)
                    mine = cut([mine])
                    got = held.setdefault(qid, [])
                    got.append(mine)
                    size += len(mine[0])
                    if sum(len(x[0]) for x in got) > 4 * refine:
                        size -= sum(len(x[0]) for x in got)
                        held[qid] = [cut(got)]
                        size += len(held[qid][0][0])
                if size > HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    met = asked.join(index.blocks.where(F.col("list").isin(lists)), "list").select("list", "qids", "vs", "ids", "codes")
    return top(met.mapInArrow(score, schema), [F.col("near").desc(), F.col("id")], refine).select("qid", "list", "id")


def search(index: VectorIndex, queries: DataFrame, k: int = VECTOR_CANDIDATES, floor: float | None = MIN_SIMILARITY, probes: int = 32, refine: int = 200, skip_self: bool = False) -> DataFrame:
    """Approximate (qid, id, similarity, rank) for questions (qid, vector): similarities are exact cosines, the set is nearly the
    nearest. More ``probes`` and a larger ``refine`` find more. A question whose vector is null or zero finds nothing."""
    found = candidates(index, queries, probes, max(refine, k), skip_self)
    mine = queries.select("qid", F.col("vector").alias("q"))
    pairs = found.join(index.vectors.select("list", "id", "vector"), ["list", "id"]).join(mine, "qid")
    scored = pairs.select("qid", "id", F.round(vx.cosine(F.col("q"), F.col("vector")), 6).alias("similarity"))
    return top(scored if floor is None else scored.where(F.col("similarity") >= floor), [F.col("similarity").desc(), F.col("id")], k)


def work(index: VectorIndex, queries: DataFrame, k: int = VECTOR_CANDIDATES, probes: int = 32, refine: int = 200) -> DataFrame:
    """One row: rows in the index, questions, pairs compared by code and pairs compared exactly by such a search."""
    sizes = index.blocks.groupBy("list").agg(F.sum(F.size("ids")).alias("n"))
    coded = probed(index, queries, probes).join(sizes, "list").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("by_code"))
    exact = candidates(index, queries, probes, max(refine, k)).agg(F.count("*").alias("exactly"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).crossJoin(queries.agg(F.count("*").alias("questions"))).crossJoin(coded).crossJoin(exact)  # one row each
