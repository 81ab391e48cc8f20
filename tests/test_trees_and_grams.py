"""Hash trees against whole comparison, and the n-gram index against a scan."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import index, lexical, ngrams, store, tree
from tessera.staging import scratch


def manifest(spark, rows):
    return spark.createDataFrame(rows, "id long, doc_sha256 string, meta_sha256 string")


def test_changes_equal_the_sync_plan(spark, monkeypatch):
    monkeypatch.setattr(tree, "LEAF", 2)  # several levels
    rng = random.Random(4)
    old = [(i, f"d{rng.randrange(50)}", None if i % 9 == 0 else "m") for i in range(3000)]
    new = [r for r in old if r[0] % 500 != 7]
    new = [(i, d + "!", m) if i % 400 == 3 else (i, d, "null" if i == 9 else m) for i, d, m in new] + [(5000, "x", "y"), (5001, None, None)]
    a, b = (tree.build(manifest(spark, r).repartition(3), scratch(spark, "tree")) for r in (old, new))
    assert a.depth == 4 and tree.root(a) != tree.root(b)
    want = {tuple(r) for r in store.sync_plan(manifest(spark, old), manifest(spark, new)).where("action <> 'unchanged'").collect()}
    assert {tuple(r) for r in tree.changes(a, b).collect()} == want and len(want) > 15
    assert tree.compared(a, b) < 3 * len(want)  # in proportion to the changes, not to the rows
    same = tree.build(manifest(spark, old[::-1]).repartition(2), scratch(spark, "tree"))
    assert tree.root(same) == tree.root(a) and tree.changes(a, same).count() == 0 and tree.compared(a, same) == 0
    small = tree.build(manifest(spark, old[:5]), scratch(spark, "tree"))
    assert small.depth == 2 and tree.changes(a, small).where("action = 'delete'").count() == 2995
    none = tree.build(manifest(spark, []), scratch(spark, "tree"))
    assert tree.root(none) is None and tree.changes(none, small).count() == 5 and tree.changes(small, none).where("action = 'delete'").count() == 5


def test_postings_and_metadata_are_verified(spark):
    rows = [(f"d{i}", "", f"so'z {i} matn", f"p{i}", "x", "note") for i in range(40)]
    chunks = spark.createDataFrame(rows, "id string, title string, document string, parent_id string, project string, kind string")
    made = index.build(chunks, scratch(spark, "index"))
    says = ("meta", "token_count", "words")
    of = lambda docs, posts: tree.build(tree.index_state(docs, posts), scratch(spark, "tree"), says=says)
    whole, docs = of(made.docs, made.postings), lexical.kw_docs(chunks)
    assert tree.changes(whole, of(docs, lexical.postings(docs))).count() == 0
    lost = of(made.docs, made.postings.where("NOT (id = 'd7' AND term = 'matn')"))
    more = of(made.docs, made.postings.withColumn("tf", F.when((F.col("id") == "d8") & (F.col("term") == "matn"), 2).otherwise(F.col("tf"))))
    moved = of(made.docs.withColumn("project", F.when(F.col("id") == "d9", "y").otherwise(F.col("project"))), made.postings)
    counted = of(made.docs.withColumn("token_count", F.col("token_count") + (F.col("id") == "d1").cast("long")), made.postings)
    assert [[r.id for r in tree.changes(whole, t).collect()] for t in (lost, more, moved, counted)] == [["d7"], ["d8"], ["d9"], ["d1"]]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    rows = [(f"r{i}", "".join(rng.choice("abcd É") for _ in range(rng.randint(0, 60)))) for i in range(400)]
    return rows + [("null", None), ("empty", ""), ("same", rows[0][1]), ("long", "ab" * 5000 + "needle in it" + "cd" * 5000), ("%", "100% _x_ \\d+ 'q'")]


def test_substrings_equal_a_scan(spark, texts):
    rng = random.Random(9)
    held = ngrams.build(spark.createDataFrame(texts, "id string, text string"), scratch(spark, "grams"))
    strings = [t[a : a + rng.randint(1, 8)] for _, t in texts[:300:7] if t and len(t) > 10 for a in (rng.randrange(len(t) - 8),)]
    strings += ["", "a", "ab", "aaaa", "NEEDLE in", "zzz", "abzzz", "É a", "é", "100% _", "\\d+", "'q'", "dcab" * 4, None, "cd" * 40]
    asked = spark.createDataFrame(list(enumerate(strings)), "sid long, text string")
    want = {(k, i) for k, s in enumerate(strings) if s is not None for i, t in texts if t is not None and s.lower() in t.lower()}
    got = [tuple(r) for r in ngrams.containing(asked, held).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    few = asked.where("sid = 5 OR length(text) >= 6").select("sid", F.lower("text").alias("needle"))
    n, hits = ngrams.candidates(few, held).count(), sum(1 for k, _ in want if len(strings[k]) >= 6)
    assert n < 0.2 * len(texts) * few.count() and n >= hits
    empty = ngrams.build(spark.createDataFrame([], "id string, text string"), scratch(spark, "grams"))
    assert ngrams.containing(asked, empty).count() == 0


def test_a_gram_index_moves_no_postings(spark):
    """Grams are taken in one pass, so a long text is quick, and postings are written where the texts are read."""
    import time

    assert [len(ngrams.codes(t)) for t in ("", "ab", "abc", "aaaa", "a\U0001f600b\U0001f600")] == [0, 0, 1, 1, 2]
    long = spark.range(8).select(F.col("id").cast("string").alias("id"), F.repeat(F.concat(F.lit("so'z "), F.col("id").cast("string"), F.lit("x ")), 60_000).alias("text"))
    began = time.monotonic()
    held = ngrams.build(long.repartition(4), scratch(spark, "grams"))
    asked = spark.createDataFrame([(1, "Z 3X S"), (2, "z 3x s"), (3, "z 9x")], "sid long, text string")
    assert {tuple(r) for r in ngrams.containing(asked, held).collect()} == {(1, "3"), (2, "3")}
    assert time.monotonic() - began < 60
    assert held.postings.count() < 8 * 20


def test_rewritten_questions_are_merged_by_best_rank(spark):
    import os

    from tessera.operators import policy
    from tessera.plans import base, catalog  # noqa: F401

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    d = base.Data(spark, sf)
    asked = {r.qid: policy.query_variants(r.text) for r in d.queries.collect()}
    rows = [(q * 2 + v, t) for q, ts in asked.items() for v, t in enumerate(ts)]
    parent = {r.id: r.parent_id for r in d.chunks.select("id", "parent_id").collect()}
    ranks = {}
    for r in lexical.keyword_topk(spark.createDataFrame(rows, "qid long, text string"), d.index).collect():
        at = ranks.setdefault(r.qid, {})
        at[parent[r.id]] = min(at.get(parent[r.id], 0.0), r.score)
    best = {}
    for q, found in ranks.items():
        for n, (source, _) in enumerate(sorted(found.items(), key=lambda x: (x[1], x[0])), 1):
            key = (q // 2, source)
            best[key] = min(best.get(key, (n, q % 2)), (n, q % 2))
    want = set()
    for q in {k[0] for k in best}:
        mine = sorted((n, v, s) for (p, s), (n, v) in best.items() if p == q)[:30]
        want |= {(q, s, round(1 / (60 + n), 6), v, k) for k, (n, v, s) in enumerate(mine, 1)}
    got = {tuple(r) for r in base.QUERIES["retrieve_rewritten"](spark, sf).select("qid", "source_key", "score", "variant", "rank").collect()}
    assert got == want and got
