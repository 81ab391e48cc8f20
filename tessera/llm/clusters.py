"""Centroid clustering of integer vectors by sort-means.

In each round the other centroids are ordered by their distance from each centroid. A vector starts at the centroid it was
assigned to before, at distance d, and scans that centroid's order; a centroid at more than 2d from the start can't be
nearer than d, nor can those behind it, so the scan stops there. One at exactly 2d may tie, so the stop is strict. All
arithmetic is on whole numbers and therefore exact.

A round is one pass: every task reads the vectors with their last assignment, writes the new one, and adds one row for each
centroid with the sum and count of its vectors. Only those rows are read back and added up by Spark, and the centroids come
to the driver: ``k`` times the number of components, whatever the input's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settled, staged

#: Vectors that a task assigns at once.
BLOCK = 8192
#: Beyond this a squared distance over 64 components might not fit 64 bits.
LARGEST = 1 << 27
#: Below this every squared distance over 64 components is exact in doubles too, which are faster.
EXACT_IN_DOUBLES = 1 << 22

_STATE = "vec_id long, v array<int>, cluster int, distance long, scanned int, n long, sums array<long>"


def kept_vectors(embeddings: DataFrame, dim: int = 64, scale: int = 256) -> DataFrame:
    """vec_id, v: rows of exactly ``dim`` components, none null or non-finite, as floor(scale * component)."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return embeddings.where((F.size(x) == dim) & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of least sha256 of "seed:vec_id"; equal ids by their components, null ids last."""
    rows = vectors.select("v", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


class Orders:
    """For each centroid the others by distance from it (ties: smaller number first), with those squared distances."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids.astype(np.int64)
        if len(centroids) and np.abs(self.centroids).max() >= LARGEST:
            raise ArithmeticError("a component is too large for exact 64-bit distances")
        k = len(centroids)
        apart = np.array([((self.centroids - c) ** 2).sum(1) for c in self.centroids]).reshape(k, k)
        self.order, self.apart = [], []
        for c in range(k):
            by = np.lexsort((np.arange(k), apart[c]))
            by = by[by != c]
            self.order.append(by)
            self.apart.append(apart[c][by])

    def assign(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid of each row of ``x`` (ties: smaller number), its squared distance, and how many were compared."""
        if len(x) and np.abs(x).max() >= LARGEST:
            raise ArithmeticError("a component is too large for exact 64-bit distances")
        small = max(np.abs(x).max(initial=0), np.abs(self.centroids).max(initial=0)) < EXACT_IN_DOUBLES
        x, centres = (x.astype(np.float64), self.centroids.astype(np.float64)) if small else (x, self.centroids)
        best, distance, scanned = before.copy(), np.zeros(len(x), np.int64), np.ones(len(x), np.int32)
        by = np.argsort(before, kind="stable")
        for rows in np.split(by, np.flatnonzero(np.diff(before[by])) + 1) if len(x) else []:
            c = int(before[rows[0]])
            start = _squared(x[rows], centres[c])
            # 4 * start fits, as a component's difference is below 2^28
            until = np.searchsorted(self.apart[c] / 4, start, side="right") if small else np.array([np.searchsorted(self.apart[c], 4 * int(s), side="right") for s in start])
            far = np.argsort(-until, kind="stable")
            rows, until = rows[far], until[far]
            own, least, at = x[rows], start[far], np.full(len(rows), c)
            live = len(rows) - np.searchsorted(until[::-1], np.arange(1, until[0] + 1), side="left")
            for other, n in zip(self.order[c].tolist(), live.tolist()):
                d = _squared(own[:n], centres[other])
                nearer = (d < least[:n]) | (d == least[:n]) & (other < at[:n])
                least[:n][nearer], at[:n][nearer] = d[nearer], other
            best[rows], distance[rows], scanned[rows] = at, least.astype(np.int64), 1 + until
        return best, distance, scanned


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def _gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Batches put together up to ``least`` rows or a little more."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= least:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _round(vectors: DataFrame, centroids: np.ndarray, last: bool) -> DataFrame:
    """Every vector with its new assignment, and rows of sums: one for each task and centroid that got a vector.

    The last round's sums are of distances, and it drops the components.
    """
    k, dim = centroids.shape
    with_before = "cluster" in vectors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = Orders(centroids)
        count, sums = np.zeros(k, np.int64), np.zeros((k, 1 if last else dim), np.int64)
        none = lambda n, t: pa.nulls(n, t)
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        names = ["vec_id", "v", "cluster", "distance", "scanned", "n", "sums"]
        for t in _gathered(batches, BLOCK):
            v = t["v"].combine_chunks()
            x = v.flatten().to_numpy().reshape(-1, dim).astype(np.int64)
            before = t["cluster"].to_numpy().astype(np.int64) if with_before else np.zeros(len(x), np.int64)
            to, distance, scanned = orders.assign(x, before)
            count += np.bincount(to, minlength=k)
            np.add.at(sums, to, distance[:, None] if last else x)
            n = len(x)
            out = [t["vec_id"].combine_chunks(), none(n, ints) if last else v, pa.array(to, pa.int32()), pa.array(distance), pa.array(scanned, pa.int32()), none(n, pa.int64()), none(n, longs)]
            yield from pa.Table.from_arrays(out, names=names).to_batches()
        got = np.flatnonzero(count)
        if len(got):
            n = len(got)
            out = [none(n, pa.int64()), none(n, ints), pa.array(got, pa.int32()), none(n, pa.int64()), none(n, pa.int32()), pa.array(count[got]), pa.array(sums[got].tolist(), longs)]
            yield from pa.Table.from_arrays(out, names=names).to_batches()

    return vectors.mapInArrow(run, _STATE)


def _sums(state: DataFrame, k: int, width: int) -> tuple[list[int], list[list[int]]]:
    """Count and component sums of each centroid, from the rows of sums alone: at most one for each task and centroid. Every
    component is a group of its own, so no task adds up much more than others; ``k * (width + 1)`` rows come to the driver."""
    rows = state.where(F.col("sums").isNotNull()).select("cluster", F.posexplode(F.array_append("sums", F.col("n"))).alias("i", "x"))
    counts, sums = [0] * k, [[0] * width for _ in range(k)]
    for r in rows.groupBy("cluster", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        if r.i < width:
            sums[r.cluster][r.i] = int(r.x)
        else:
            counts[r.cluster] = int(r.x)
    return counts, sums


def sort_means(embeddings: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dim: int = 64, scale: int = 256) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, scanned of every kept vector.

    Distances are squared; ``scanned`` says to how many centroids the last scan compared the vector. Rows with a null, short,
    long or non-finite vector aren't kept. Repeated rows count each; a null id never starts a centroid while other ids are
    there. With fewer kept vectors than ``k`` each starts a centroid; with none there are no rows. Components of 2^27 or more
    after scaling raise an ArithmeticError (2^31 or more: Spark's overflow error), as their distances need not fit 64 bits.
    Other columns are ignored.
    """
    spark = settled(embeddings.sparkSession)
    vectors = kept_vectors(embeddings, dim, scale)
    centroids = first_centroids(vectors, k, seed)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scanned int"
    if not len(centroids):
        return spark.createDataFrame([], schema)
    k, state = len(centroids), None
    for _ in range(rounds):
        now = staged(_round(vectors, centroids, False), "clusters")
        counts, sums = _sums(now, k, dim)
        centroids = np.array([[s // n for s in sums[c]] if (n := counts[c]) else centroids[c].tolist() for c in range(k)], np.int64)
        if state is not None:
            discard(state)
        state = now
        vectors = state.where(F.col("sums").isNull()).select("vec_id", "v", "cluster")
    final = staged(_round(vectors, centroids, True), "clusters")
    if state is not None:
        discard(state)
    _, sums = _sums(final, k, 1)
    total = sum(s[0] for s in sums)
    facts = [(c, sums[c][0], total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in range(k)]
    each = F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))  # k rows
    return final.where(F.col("sums").isNull()).join(each, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scanned")


def oracle(k: int = 40, rounds: int = 5, seed: int = 2, dim: int = 64, scale: int = 256) -> str:
    """The same in SQL: every vector against every centroid in each round, all rounds written out."""
    ctes = [
        f"q AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, vec_id, v FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * x::DOUBLE) AS BIGINT)) AS v FROM embeddings"
        f" WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0))",
        f"p AS MATERIALIZED (SELECT r, unnest(generate_series(1, {dim})) AS i, unnest(v) AS x FROM q)",
        f"c0 AS MATERIALIZED (SELECT c, unnest(generate_series(1, {dim})) AS i, unnest(v) AS x FROM (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM q QUALIFY c < {k}))",
    ]
    for n in range(rounds + 1):
        ctes.append(f"a{n} AS MATERIALIZED (SELECT r, c, d FROM (SELECT r, c, CAST(sum((p.x - k.x) * (p.x - k.x)) AS BIGINT) AS d FROM p JOIN c{n} k USING (i) GROUP BY r, c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if n < rounds:
            ctes.append(
                f"c{n + 1} AS MATERIALIZED (SELECT k.c, k.i, coalesce(m.x, k.x) AS x FROM c{n} k LEFT JOIN (SELECT c, i, CAST((s - ((s % w) + w) % w) // w AS BIGINT) AS x FROM (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS w FROM a{n} JOIN p USING (r) GROUP BY c, i)) m USING (c, i))"
            )
    start = f"(SELECT r, c FROM a{rounds - 1})" if rounds else "(SELECT r, 0 AS c FROM q)"
    ctes += [
        f"apart AS MATERIALIZED (SELECT a.c AS c, b.c AS o, CAST(sum((a.x - b.x) * (a.x - b.x)) AS BIGINT) AS d2 FROM c{rounds} a JOIN c{rounds} b ON a.i = b.i AND a.c <> b.c GROUP BY a.c, b.c)",
        f"began AS MATERIALIZED (SELECT s.r, any_value(s.c) AS c, CAST(sum((p.x - k.x) * (p.x - k.x)) AS BIGINT) AS d FROM {start} s JOIN p USING (r) JOIN c{rounds} k ON k.c = s.c AND k.i = p.i GROUP BY s.r)",
        "seen AS MATERIALIZED (SELECT r, CAST(1 + count(o) AS INTEGER) AS scanned FROM began LEFT JOIN apart ON apart.c = began.c AND apart.d2 <= 4 * began.d GROUP BY r)",
        f"digests AS MATERIALIZED (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)",
    ]
    return (
        "WITH " + ",\n".join(ctes) + f"\nSELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256, scanned"
        f" FROM a{rounds} JOIN q USING (r) JOIN seen USING (r) JOIN digests USING (c)"
    )
