"""Clustering, classification and resampling against brute force, and on odd rows."""

import collections
import hashlib
import math
import os
import re
import zlib

import numpy as np
import pytest

from tessera.llm import classifier, clusters, resample
from tessera.llm.common import staged

DIR = "/root/testdata/sf0.01"


def plain_means(rows, k, rounds, seed, dim=64):
    """Lloyd's rounds in Python's whole numbers: (vec_id, cluster, distance, cluster_inertia, inertia, sha256) of each kept row."""
    kept = [(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centres = [tuple(sum(x) // len(groups[n]) for x in zip(*groups[n])) if n in groups else c for n, c in enumerate(centres)]
    got = [(i, *nearest(v)[::-1]) for i, v in kept]
    sums = collections.Counter()
    for _, c, d in got:
        sums[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return collections.Counter((i, c, d, sums[c], sum(sums.values()), sha[c]) for i, c, d in got)


def vectors(n, seed=1, dim=64):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 0.2, (6, dim))
    return [(i, [float(x) for x in base[i % 6] + rng.normal(0, 0.05, dim)]) for i in range(n)]


def found(df):
    return collections.Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_sort_means(spark):
    rows = vectors(160)
    rows += [(200 + i, rows[3][1]) for i in range(60)] + [rows[5]] * 4  # copies, repeated rows
    rows += [(300, None), (301, []), (302, rows[0][1][:63]), (303, rows[0][1] + [0.0]), (304, [*rows[0][1][:63], None]), (305, [*rows[0][1][:63], float("nan")]), (306, [*rows[0][1][:63], float("-inf")]), (None, rows[1][1]), (None, None)]
    df = spark.createDataFrame([(i, v, "own", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, sums int")
    for k, rounds in ((40, 5), (7, 2), (3, 0)):
        got = clusters.sort_means(df.repartition(5), k=k, rounds=rounds)
        assert found(got) == plain_means(rows, k, rounds, 2)
        assert all(1 <= r.scanned <= k for r in got.collect())
    assert found(clusters.sort_means(df.limit(0))) == collections.Counter()
    assert found(clusters.sort_means(df.where("vec_id = 7"), k=40)) == plain_means(rows[7:8], 40, 5, 2)  # fewer vectors than centroids


def test_ties_and_the_strict_stop(spark):
    """On a grid many centroids are equally near, and some stand at exactly twice the distance."""
    rows = [(i, [float(x) / 256 for x in (i % 8, i // 8, *([0] * 62))]) for i in range(64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for seed in range(4):
        assert found(clusters.sort_means(df, k=9, rounds=3, seed=seed)) == plain_means(rows, 9, 3, seed)
    o = clusters.Orders(np.array([[4, 0], [0, 0], [8, 0]]))
    to, d, scanned = o.assign(np.array([[2, 0], [6, 0], [4, 0]]), np.array([0, 0, 0]))
    assert to.tolist() == [0, 0, 0] and d.tolist() == [4, 4, 0] and scanned.tolist() == [3, 3, 1]
    to, d, scanned = o.assign(np.array([[2, 0], [2, 0]]), np.array([1, 2]))
    assert to.tolist() == [0, 0] and d.tolist() == [4, 4] and scanned.tolist() == [2, 3]


def test_large_components(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(2).integers(-400_000, 400_000, (30, 64)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(clusters.sort_means(df, k=5, rounds=2)) == plain_means(rows, 5, 2, 2)
    with pytest.raises(Exception, match="too large|OVERFLOW"):
        clusters.sort_means(spark.createDataFrame([(1, [1e6] * 64)], "vec_id long, embedding array<double>")).collect()


def test_scan_skips_far_centroids():
    rng = np.random.default_rng(4)
    centres = rng.integers(-1000, 1000, (40, 64))
    x = centres[rng.integers(0, 40, 3000)] + rng.integers(-5, 6, (3000, 64))
    o = clusters.Orders(centres)
    all_d = ((x[:, None, :] - centres[None]) ** 2).sum(2)
    to, d, scanned = o.assign(x, rng.integers(0, 40, 3000))
    assert (to == all_d.argmin(1)).all() and (d == all_d.min(1)).all()
    _, _, again = o.assign(x, to)
    assert again.max() == 1 < scanned.mean()


def plain_resample(rows, target, seed, percent, run=1):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    feats = lambda t: [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for w in [words(t)] for k in range(1, run + 1) for i in range(len(w) - k + 1)]
    s, t = collections.Counter(), collections.Counter()
    for _, x in rows:
        s.update(feats(x))
    for x in target:
        t.update(feats(x))
    sn, tn = float(sum(s.values())), float(sum(t.values()))
    gain = lambda b: math.floor(1000 * math.log((float(t[b]) + 1) * (sn + 10000) / ((float(s[b]) + 1) * (tn + 10000))))
    out = []
    for i, x in rows:
        w = sum(map(gain, feats(x)))
        h = None if i is None else int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(feats(x)), w, None if h is None else w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    long = [r for r, (_, x) in zip(out, rows) if len(words(x)) >= 20]
    for n, r in enumerate(sorted((r for r in long if r[3] is not None), key=lambda r: (-r[3], r[0], -r[2], -r[1]))[: percent * len(long) // 100], 1):
        r[4] = n
    return collections.Counter(map(tuple, out))


@pytest.mark.parametrize("run,percent", [(1, 10), (2, 60), (1, 100)])
def test_resample(spark, docs, texts, run, percent):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(7, texts[15])] * 30 + [(None, texts[16])] * 3
    df = spark.createDataFrame([(i, x, "own", 5) for i, x in rows], "doc_id long, text string, rank string, score int")
    target = [texts[14], texts[20], None, "", "ÉCOLE école É 9", "\x7f A-B_c"]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    got = resample.resample(df.repartition(5), t, seed=2024, percent=percent, run=run)
    assert collections.Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()) == plain_resample(rows, target, 2024, percent, run)


def test_resample_of_little(spark, docs, empty):
    t = empty.select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert collections.Counter(map(tuple, resample.resample(docs, t).collect())) == plain_resample(rows, [], 2024, 10)
    assert resample.resample(empty, docs).count() == 0
    short = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert [r["rank"] for r in resample.resample(short, docs).collect()] == [None, None]


def test_many_ties_are_ranked_without_gaps(spark):
    df = spark.range(3000).selectExpr("id % 10 as doc_id", "repeat('same words ', 15) as text")
    got = [r["rank"] for r in resample.resample(df, df.limit(1), percent=50).where("rank is not null").collect()]
    assert sorted(got) == list(range(1, 1501))


def pairwise(machine, x):
    """The machine's logit with every pair written out."""
    z = machine.bias + sum(machine.w[i] * v for i, v in x)
    for a in range(len(x)):
        for b in range(a):
            z += float(machine.v[x[a][0]] @ machine.v[x[b][0]]) * x[a][1] * x[b][1]
    return z


def labelled(n, seed=5):
    """Texts of good and bad quality that differ in structure."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeghi"), int(rng.integers(2, 8))))
    rows = []
    for i in range(n):
        w = [word() for _ in range(int(rng.integers(30, 90)))]
        good = i % 4 > 0
        rows.append((i, " ".join(w) if good else " | ".join(x.upper() for x in w[:20]) + " !!" * 5, int(good)))
    return rows


def test_linear_time_identity_and_gradient():
    rows = labelled(120)
    s = classifier.Setting(epochs=2, words=256, factors=3)
    f = [classifier.features(t, len(t), s.words) for _, t, _ in rows]
    m = classifier.train(f, np.array([y for *_, y in rows], float), s)
    index, value, starts = m.rows(f)
    ends = [*starts[1:], len(index)]
    z = m.logits(index, value, starts)
    for k in (0, 7, 50):
        assert abs(z[k] - pairwise(m, list(zip(index[starts[k] : ends[k]].tolist(), value[starts[k] : ends[k]].tolist())))) < 1e-9
    again = classifier.train(f, np.array([y for *_, y in rows], float), s)
    assert (again.w == m.w).all() and (again.v == m.v).all() and again.bias == m.bias
    assert np.abs(m.v).max() > 0.1  # pairs take part


def test_classify_odd_rows(spark):
    rows = [(i, t, len(t), y) for i, t, y in labelled(300)]
    odd = [(1000, None, None, 1), (1001, "", 0, 0), (1002, "  \n", None, 0), (1003, "x" * 300_000, -5, 1), (None, rows[1][1], 3, 1), rows[1], rows[1]]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, n_chars long, score int")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows + odd] + [(2, 0), (2, 1), (5, None), (None, 0)], "doc_id long, quality int")
    got = classifier.classify(df.repartition(3), labels).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in rows + odd)
    good = {r[0]: r[3] for r in rows}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.doc_id not in good or r.predicted == good[r.doc_id]
    same = {r.doc_id: r.score for r in classifier.classify(df.repartition(1), labels).collect()}
    assert all(same[r.doc_id] == r.score for r in got)
    assert classifier.classify(df.limit(0), labels).count() == 0
    none = classifier.classify(df.drop("n_chars"), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and len(none) == len(got)
    one = classifier.classify(df, labels.where("quality = 1 and doc_id < 900")).collect()
    assert len({r.score for r in one}) == 1 and one[0].score > 0.9


def test_no_label_of_a_held_out_row_matters(spark):
    rows = [(i, t, y) for i, t, y in labelled(200)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    a = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    b = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in rows], "doc_id long, quality int")
    assert sorted(classifier.classify(df, a).collect()) == sorted(classifier.classify(df, b).collect())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_held_out_quality(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    got = staged(classifier.classify(docs, labels), "scored").join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in got)
    bad = [r for r in got if r.quality == 0]
    assert len(got) > 80 and right >= 0.97 * len(got) and sum(r.predicted == 0 for r in bad) >= 0.85 * len(bad)
