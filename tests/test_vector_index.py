"""The inverted-file index and neighbour descent against exact search."""

import os

import numpy as np
import pytest

from tessera.operators import dense, descent, ivf
from tessera.staging import scratch

DIR = "/root/testdata/sf0.1"


def grouped(n, dim=32, groups=12, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((groups, dim))
    return [(i, (base[i % groups] + 0.5 * rng.standard_normal(dim)).tolist()) for i in range(n)]


def recall(exact, found):
    exact = {tuple(r) for r in exact.collect()}
    return len(exact & {tuple(r) for r in found.collect()}) / len(exact)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(grouped(900), "id long, vector array<float>").repartition(5)


@pytest.fixture(scope="module")
def index(spark, rows):
    return ivf.build(rows, scratch(spark, "ivf"), ivf.Fit(lists=24, parts=8, codes=64, rounds=4))


def test_every_row_is_in_the_index_once(spark, rows, index):
    assert sorted(r.id for r in index.vectors.select("id").collect()) == list(range(900))
    packs = index.blocks.collect()
    assert sorted(i for r in packs for i in r.ids) == list(range(900)) and all(len(r.codes) == 8 * len(r.ids) <= 8 * ivf.BLOCK for r in packs)
    place = {r.id: (r.list, bytes(r.code)) for r in index.vectors.collect()}
    for r in packs:
        for k, i in enumerate(r.ids):
            assert place[i] == (r.list, bytes(r.codes)[8 * k : 8 * k + 8])
    # the nearest centroid and the nearest code of each part, by hand
    for r in rows.where("id % 90 = 0").collect():
        x = np.array(r.vector, np.float32).astype(float)
        x = (x / np.linalg.norm(x)).astype(np.float32).astype(float)
        to = int(np.argmin(((index.centroids - x) ** 2).sum(1)))
        assert place[r.id][0] == to
        left = (x - index.centroids[to]).reshape(8, 4)
        assert list(place[r.id][1]) == [int(np.argmin(((index.books[p] - left[p]) ** 2).sum(1))) for p in range(8)]


def test_search_finds_most_and_compares_few(spark, rows, index):
    q = rows.where("id % 20 = 0").withColumnRenamed("id", "qid")
    exact = dense.vector_topk(q, rows, k=10, floor=0.0)
    got = ivf.search(index, q, k=10, floor=0.0, probes=6, refine=40)
    assert recall(exact.select("qid", "id"), got.select("qid", "id")) >= 0.9
    assert recall(exact.select("qid", "id", "similarity"), got.select("qid", "id", "similarity")) >= 0.85  # exact similarities, up to the sixth place
    w = ivf.work(index, q, k=10, probes=6, refine=40).first()
    assert w.rows == 900 and w.questions == 45 and w.exactly == 45 * 40 and w.by_code < 0.6 * 900 * 45
    every = ivf.search(index, q, k=10, floor=0.0, probes=24, refine=900)
    assert recall(exact.select("qid", "id"), every.select("qid", "id")) == 1.0  # all lists and rows: exact, up to the sixth place
    own = ivf.search(index, q, k=3, floor=None, probes=24, refine=900, skip_self=True)
    assert not own.where("qid = id").count() and own.count() == 45 * 3


def test_the_same_index_whatever_the_partitions(spark, rows, index):
    again = ivf.read(spark, ivf.build(rows.repartition(2), (at := scratch(spark, "ivf")), ivf.Fit(lists=24, parts=8, codes=64, rounds=4)) and at)
    assert np.array_equal(again.centroids, index.centroids) and np.array_equal(again.books, index.books)
    assert sorted(map(tuple, again.vectors.select("id", "list").collect())) == sorted(map(tuple, index.vectors.select("id", "list").collect()))


def test_odd_vectors_and_hot_lists(spark):
    odd = [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [float("nan"), 1.0]), ("e", [None, 1.0]), (None, [1.0, 1.0]), *((f"h{i:04d}", [0.6, 0.8]) for i in range(2500))]
    df = spark.createDataFrame(odd, "id string, vector array<float>")
    index = ivf.build(df, scratch(spark, "ivf"), ivf.Fit(lists=4, parts=2, codes=4, rounds=2))
    assert index.vectors.count() == 2501
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, None), (4, [0.0, 0.0])], "qid long, vector array<float>")
    got = ivf.search(index, q, k=3, floor=0.1, probes=4)
    assert [(r.qid, r.id) for r in got.orderBy("qid", "rank").collect()] == [(1, "a"), (1, "h0000"), (1, "h0001"), (2, "h0000"), (2, "h0001"), (2, "h0002")]
    none = ivf.build(df.limit(0), scratch(spark, "ivf"))
    assert ivf.search(none, q).count() == 0 and descent.descend(none)[0].count() == 0


def test_neighbour_descent(spark, rows, index):
    near, took = descent.descend(index, k=6, width=12)
    exact = dense.vector_topk(rows.withColumnRenamed("id", "qid"), rows, k=6, floor=None, skip_self=True)
    assert recall(exact.select("qid", "id"), near.select("id", "neighbour")) >= 0.9
    assert recall(exact.select("qid", "id", "similarity"), near.select("id", "neighbour", "similarity")) >= 0.85  # a sixth place may differ
    assert took["rounds"] > 1 and near.count() == 900 * 6 and not near.where("id = neighbour").count()


def test_descent_of_a_hub_and_of_copies(spark):
    """Half of all vectors are one; nothing grows with the square of that, and its copies are each other's neighbours."""
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 0.0, 0.0, 0.0]) if i % 2 else (i, rng.standard_normal(4).tolist()) for i in range(1200)]
    index = ivf.build(spark.createDataFrame(rows, "id long, vector array<float>"), scratch(spark, "ivf"), ivf.Fit(lists=12, parts=2, codes=16, rounds=3))
    near, took = descent.descend(index, k=4, width=8)
    assert {r.similarity for r in near.where("id % 2 = 1").collect()} == {1.0}
    assert took["pairs"] < 1200 * (2 * descent.SEEDS + took["rounds"] * (2 * 8) ** 2 / 2)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_recall_as_registered(spark):
    from tessera.plans import base, catalog  # noqa: F401

    d = base.Data(spark, DIR)
    exact = dense.vector_topk(d.query_vectors, d.vectors).select("qid", "id")
    got = base.QUERIES["vector_ivf"](spark, DIR).select("qid", "id")
    found, w = recall(exact, got), ivf.work(d.vector_index, d.query_vectors, **base.IVF_SEARCH).first()
    print(f"vector_ivf: recall at 50 {found:.3f}; compared by code {w.by_code / w.rows / w.questions:.3f}, exactly {w.exactly / w.rows / w.questions:.3f} of all pairs")
    assert found >= 0.9 and w.exactly <= 0.2 * w.rows * w.questions
    exact = dense.vector_topk(d.vectors.withColumnRenamed("id", "qid"), d.vectors, k=6, floor=None, skip_self=True).select("qid", "id")
    near, took = descent.descend(d.vector_index, **base.DESCENT)
    found = recall(exact, near.select("id", "neighbour"))
    print(f"knn_descent: recall at 6 {found:.3f}; {took['rounds']} rounds, {took['pairs']} pairs compared")
    assert found >= 0.9
