"""Vector search. Query vectors are a stated set, so they go against all rows in blocks; the rows stay where they are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import MIN_SIMILARITY, VECTOR_CANDIDATES
from ..functions import vectors as vx
from ..staging import staged
from .lexical import best, top

#: Query vectors that one block sends to every task, and rows that are compared with them at once.
BLOCK, STRIDE = 4096, 1024


def _blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    n = queries.count()
    blocks = max(1, -(-n // BLOCK))
    for k in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == k)
        rows = part.select("qid", "vector").collect()
        if rows:
            yield [r.qid for r in rows], np.array([r.vector for r in rows], np.float64).reshape(len(rows), -1)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = VECTOR_CANDIDATES, floor: float | None = MIN_SIMILARITY, skip_self: bool = False, qid_type: str = "long", id_type: str = "long", space: str = "cosine") -> DataFrame:
    """(qid, id, similarity, rank): the ``k`` rows of highest similarity for each query (qid, vector) among ``vectors`` (id, vector).

    In the space ``cosine`` that is the cosine, in ``ip`` the inner product of the vectors as they are; in ``l2`` the rows are the ``k`` of
    least distance, whatever the vectors' lengths, and of those the cosine is given, which orders them. A zero vector is similar to nothing. Each task keeps the best ``k`` of its own rows, so no more than queries x k x tasks rows are shuffled.
    """
    if space not in ("cosine", "l2", "ip"):
        raise ValueError(f"unknown space {space!r}")
    if space != "l2":
        return _topk(queries, vectors, k, floor, skip_self, qid_type, id_type, unit=space != "ip")
    near = _topk(queries, vectors, k, None, skip_self, qid_type, id_type, unit=False, by_distance=True).select("qid", "id")
    pairs = near.join(queries.select("qid", F.col("vector").alias("q")), "qid").join(vectors.select("id", "vector"), "id")
    scored = pairs.select("qid", "id", F.round(vx.cosine(F.col("q"), F.col("vector")), 6).alias("similarity"))
    return top(scored if floor is None else scored.where(F.col("similarity") >= floor), [F.col("similarity").desc(), F.col("id")], k)


def _topk(queries: DataFrame, vectors: DataFrame, k: int, floor: float | None, skip_self: bool, qid_type: str, id_type: str, meets=None, unit: bool = True, by_distance: bool = False) -> DataFrame:
    """:func:`vector_topk` of the pairs for which ``meets(question vectors)(vectors)`` is true; the others aren't compared. ``by_distance``:
    the squared distance, negative, in place of the similarity."""
    parts = []
    for qids, q in _blocks(queries):
        if unit:
            q = q / np.where((n := np.linalg.norm(q, axis=1, keepdims=True)) == 0, 1, n)
        met_by = meets and meets(q)

        def run(batches: Iterator[pa.RecordBatch], qids=qids, q=q, met_by=met_by) -> Iterator[pa.RecordBatch]:
            held_s, held_i = np.zeros((len(qids), 0)), np.zeros((len(qids), 0), object)
            names = np.array(qids, object)[:, None]
            for batch in (whole.slice(at, STRIDE) for whole in batches for at in range(0, whole.num_rows, STRIDE)):
                ids = np.array(batch.column(0).to_pylist(), object)
                x = np.array(batch.column(1).to_pylist(), np.float64).reshape(len(ids), -1)
                if unit:
                    x = x / np.where((m := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, m)
                if by_distance:
                    s = -np.round((q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * (q @ x.T), 6)
                elif met_by is None:
                    s = np.round(q @ x.T, 6)
                else:
                    s = np.full((len(qids), len(ids)), -np.inf)
                    for a, met in enumerate(met_by(x)):
                        s[a, met] = np.round(x[met] @ q[a], 6)
                if skip_self:
                    s[names == ids[None, :]] = -np.inf
                held_s, held_i = best(np.concatenate([held_s, s], 1), np.concatenate([held_i, np.broadcast_to(ids, s.shape)], 1), k)
            for a in range(len(qids)):
                keep = np.isfinite(held_s[a]) & ((held_s[a] >= floor) if floor is not None else True)
                if keep.any():
                    n = int(keep.sum())
                    yield pa.RecordBatch.from_arrays([pa.array([qids[a]] * n, arrow[qid_type]), pa.array(held_i[a][keep].tolist(), arrow[id_type]), pa.array(held_s[a][keep])], names=["qid", "id", "similarity"])

        arrow = {"long": pa.int64(), "string": pa.string()}
        parts.append(vectors.select("id", "vector").mapInArrow(run, f"qid {qid_type}, id {id_type}, similarity double"))
    if not parts:
        return vectors.sparkSession.createDataFrame([], f"qid {qid_type}, id {id_type}, similarity double, rank int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return top(out, [F.col("similarity").desc(), F.col("id")], k)


#: Vectors of one packed row, packed rows that a task has on its other side at most, and tasks of small tables.
PACK, SIDE, TASKS = 4096, 16, 24
#: Question vectors that are compared with a packed row at once, and near ones of each beyond which all are worked out in double.
STRIP, NEAR = 512, 64
BATCH_BYTES = 16 << 20


def all_topk(vectors: DataFrame, k: int, floor: float | None = None, skip_self: bool = False) -> DataFrame:
    """(qid, id, similarity, rank): :func:`vector_topk` of ``vectors`` (id, vector) among themselves. Rows without id have no neighbours.

    More than ``BLOCK`` vectors are packed into rows of many, and every task compares some packed rows with ``SIDE`` others at most: neither
    the driver nor a task holds all. Products are made in single precision, and those that can be among the best are worked out in double,
    so the result is that of products in double. The number of pairs is the square of the number of vectors.
    """
    rows = vectors.select("id", "vector").where("id IS NOT NULL")
    kind, n = dict(rows.dtypes)["id"], rows.count()
    if n <= BLOCK:
        return vector_topk(rows.withColumnRenamed("id", "qid"), rows, k, floor, skip_self, *("string" if kind == "string" else "long",) * 2)
    size = min(PACK, -(-n // TASKS))
    parts = -(-n // (size * SIDE))
    # a batch holds few pairs of packed rows
    vectors.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    packed = staged(rows.repartition(parts).sortWithinPartitions("id").mapInArrow(_packed(size, parts), f"block int, ids array<{kind}>, unit binary"), "packed")
    tasks = max(parts, min(TASKS, -(-n // size)))
    left = packed.repartitionById(tasks, F.pmod("block", F.lit(tasks)))
    right = packed.select(F.col("block").alias("other"), F.col("ids").alias("other_ids"), F.col("unit").alias("other_unit")).repartitionById(parts, F.pmod("other", F.lit(parts))).sortWithinPartitions("other")
    near = f"block int, q array<int>, qid array<{kind}>, id array<{kind}>, similarity array<double>"
    found = left.hint("shuffle_replicate_nl").crossJoin(right).select("block", "ids", "unit", "other_ids", "other_unit").mapInArrow(_compared(k, floor, skip_self, STRIP, NEAR), near)
    merged = found.groupBy("block").applyInArrow(_merged(k), f"qid {kind}, id {kind}, similarity double")
    return top(merged, [F.col("similarity").desc(), F.col("id")], k)


def _packed(size: int, parts: int):
    """Rows (block, ids, unit) of ``size`` vectors (id, vector) each, of unit length; blocks are numbered through all parts in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, ids, units, held = TaskContext.get().partitionId(), 0, [], [], 0

        def row(ids: list, units: list) -> pa.RecordBatch:
            names = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays([pa.array([made * parts + part], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), pa.array([np.concatenate(units).tobytes()], pa.binary())], names=["block", "ids", "unit"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, size - held)
                at, held = at + piece.num_rows, held + piece.num_rows
                x = np.asarray(piece.column(1).flatten(), np.float64).reshape(piece.num_rows, -1)
                ids.append(piece.column(0))
                units.append(x / np.where((m := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, m))
                if held == size:
                    yield row(ids, units)
                    made, ids, units, held = made + 1, [], [], 0
        if held:
            yield row(ids, units)

    return run


def _compared(k: int, floor: float | None, skip_self: bool, strip: int, near: int):
    """From pairs of packed rows, all pairs of the first one together, to its vectors' best ``k`` among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                block = batch.column(0)[row].as_py()
                if block != now:
                    if held is not None:
                        yield held.row(now)
                    now, held = block, _Nearest(batch.column(1)[row].values, _unit(batch, 2, row), k, floor, skip_self, strip, near)
                held.meet(batch.column(3)[row].values, _unit(batch, 4, row))
        if held is not None:
            yield held.row(now)

    return run


def _unit(batch: pa.RecordBatch, column: int, row: int) -> np.ndarray:
    return np.frombuffer(batch.column(column)[row].as_buffer(), np.float64).reshape(len(batch.column(column - 1)[row].values), -1)


class _Nearest:
    """The best ``k`` so far of each vector of a packed row: ``s`` and ``i``, similarities (-inf where there is none) and ids in order."""

    def __init__(self, ids: pa.Array, unit: np.ndarray, k: int, floor: float | None, skip_self: bool, strip: int, near: int):
        self.strip, self.near = strip, near
        self.arrow, self.ids, self.unit, self.single = ids, np.array(ids.to_pylist()), unit, unit.astype(np.float32)
        self.k, self.floor, self.skip_self = k, -np.inf if floor is None else floor, skip_self
        self.s, self.i = np.full((len(ids), k), -np.inf), np.broadcast_to(self.ids[:1], (len(ids), k)).copy()
        # how far a product in single precision of two unit vectors can be from one in double, and from one rounded to six places
        self.margin = (unit.shape[1] + 8) * 2.0**-23 + 2e-6

    def meet(self, arrow: pa.Array, unit: np.ndarray) -> None:
        """Compare with the vectors of another packed row, whose ids ascend."""
        ids, single = np.array(arrow.to_pylist()), unit.astype(np.float32)
        if ids.dtype.kind == "U" and ids.dtype.itemsize > self.i.dtype.itemsize:
            self.i = self.i.astype(ids.dtype)
        first, last = np.searchsorted(ids, self.ids, "left"), np.searchsorted(ids, self.ids, "right")
        for at in range(0, len(self.ids), self.strip):
            own = slice(at, at + self.strip)

            def without_self(s: np.ndarray) -> np.ndarray:
                for a in np.flatnonzero(last[own] > first[own]) if self.skip_self else ():
                    s[a, first[own][a] : last[own][a]] = -np.inf
                return s

            s = without_self(self.single[own] @ single.T)
            edge = np.maximum(self.s[own, -1], self.floor)
            new = np.flatnonzero(np.isneginf(self.s[own, -1]))
            least = edge.copy()
            if len(new) and s.shape[1] > self.k:
                least[new] = np.maximum(edge[new], np.partition(s[new], s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k])
            near = (s >= (least - self.margin).astype(np.float32)[:, None]) & (s > -np.inf)
            if np.count_nonzero(near) <= self.near * len(s):
                a, b = np.nonzero(near)
                exact = np.round(np.einsum("ij,ij->i", self.unit[own][a], unit[b]), 6)
                keep = (exact >= edge[a]) & (exact > -np.inf)
                a, b, exact = a[keep], b[keep], exact[keep]
            else:
                a, b, exact = self._exact(without_self(np.round(self.unit[own] @ unit.T, 6)), edge, own, ids)
            if len(a):
                self._merge(at + a, exact, ids[b])

    def _exact(self, s: np.ndarray, edge: np.ndarray, own: slice, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all similarities those that come before the last one held; of many the best, which come first among equals as ids ascend."""
        full = np.isfinite(self.s[own, -1]) & (self.s[own, -1] >= self.floor)
        better = (s > edge[:, None]) | ((s == edge[:, None]) & (~full[:, None] | (ids[None, :] < self.i[own, -1][:, None])))
        better &= s > -np.inf
        for row in np.flatnonzero(better.sum(1) > self.near):
            c = np.flatnonzero(better[row])
            better[row] = False
            better[row, c[np.argsort(-s[row, c], kind="stable")[: self.k]]] = True
        a, b = np.nonzero(better)
        return a, b, s[a, b]

    def _merge(self, a: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
        met = np.unique(a)
        a, s, ids = np.concatenate([a, np.repeat(met, self.k)]), np.concatenate([s, self.s[met].ravel()]), np.concatenate([ids, self.i[met].ravel()])
        _, s, ids, _ = _first(a, s, ids, self.k)
        self.s[met], self.i[met] = s.reshape(-1, self.k), ids.reshape(-1, self.k)

    def row(self, block: int) -> pa.RecordBatch:
        a, c = np.nonzero((self.s > -np.inf) & (self.s >= self.floor))
        columns = [pa.array(a, pa.int32()), self.arrow.take(pa.array(a)), pa.array(self.i[a, c].tolist(), self.arrow.type), pa.array(self.s[a, c])]
        offsets = pa.array([0, len(a)], pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.ListArray.from_arrays(offsets, x) for x in columns)], names=["block", "q", "qid", "id", "similarity"])


def _first(a: np.ndarray, s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The first ``k`` by similarity, then id, of each ``a``, and where they stood."""
    order = np.lexsort((ids, -s, a))
    ordered = a[order]
    order = order[np.arange(len(a)) - np.searchsorted(ordered, ordered, "left") < k]
    return a[order], s[order], ids[order], order


def _merged(k: int):
    """From one packed row's best among several parts to its best ``k`` of all."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        q, qid, id, s = (pa.concat_arrays([c.values.slice(c.offsets[0].as_py(), c.offsets[-1].as_py() - c.offsets[0].as_py()) for c in rows.column(name).chunks]) for name in ("q", "qid", "id", "similarity"))
        order = pa.array(_first(q.to_numpy(), s.to_numpy(), np.array(id.to_pylist()), k)[-1])
        return pa.table({"qid": qid.take(order), "id": id.take(order), "similarity": s.take(order)})

    return run


def lsh_topk(queries: DataFrame, vectors: DataFrame, k: int = VECTOR_CANDIDATES, floor: float = MIN_SIMILARITY, bits: int = 4, tables: int = 12, seed: int = 7, probes: int = 2) -> DataFrame:
    """Approximate (qid, id, similarity, rank): only rows in buckets of random hyperplane signs that a query probes are compared.

    In each table a query probes its own bucket and those across the ``probes`` planes nearest to it, one at a time; more
    ``tables`` or ``probes`` and fewer ``bits`` raise recall. The questions' buckets go to the tasks as in
    :func:`vector_topk`, so neither rows nor pairs are shuffled.
    """

    def meets(q: np.ndarray):
        planes = np.random.default_rng(seed).standard_normal((q.shape[1], bits * tables))

        def sides(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            side = (x @ planes).reshape(len(x), tables, bits)
            return side, (side > 0) @ (1 << np.arange(bits))

        side, own = sides(q)
        near = np.argsort(np.abs(side), axis=2, kind="stable")[:, :, :probes]
        probed = np.zeros((len(q), tables, 1 << bits), bool)
        for codes in (own, *(own ^ (1 << near[:, :, p]) for p in range(near.shape[2]))):
            np.put_along_axis(probed, codes[:, :, None], True, 2)

        def met_by(x: np.ndarray) -> Iterator[np.ndarray]:
            codes = sides(x)[1]
            for p in probed:
                yield np.flatnonzero(p[np.arange(tables), codes].any(1))

        return met_by

    return _topk(queries, vectors, k, floor, False, "long", "long", meets)
