"""Operators on small corpora with known answers."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import audit, dense, evaluate, graph, index, lexical, retrieval, snapshots, store
from tessera.plans import base
from tessera.plans import catalog  # noqa: F401 (registers the queries)
from tessera.sources import parse
from tessera.streaming import ingest


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("d1", "Uy hayvonlari", "mushuk va it birga yashaydi", "p1"), ("d2", "", "mushuk sut ichadi", "p2"), ("d3", "", "it suyak yeydi", "p3"), ("d4", "", "baliq suvda", "p4")]
    chunks = spark.createDataFrame(rows, "id string, title string, document string, parent_id string").withColumns({"project": F.lit("x"), "kind": F.lit("note")})
    return lexical.kw_docs(chunks)


def test_any_term_matches(spark, docs):
    q = spark.createDataFrame([(1, "mushuk it"), (2, ""), (3, "yo'q")], "qid long, text string")
    got = lexical.keyword_topk(q, docs).collect()
    assert {r.id for r in got} == {"d1", "d2", "d3"} and {r.qid for r in got} == {1}
    assert min(got, key=lambda r: r.score).id == "d1"
    allowed = spark.createDataFrame([("d2",)], "id string")
    assert [(r.id, r.score) for r in lexical.bm25(q, docs, allowed).collect()] == [(r.id, r.score) for r in got if r.id == "d2"]


def test_gate(spark, docs):
    q = spark.createDataFrame([(1, "mushuk sut"), (2, "mushuk 2099"), (3, "sut")], "qid long, text string")
    pairs = spark.createDataFrame([(1, "d2", "mushuk sut ichadi"), (1, "d3", "it suyak yeydi"), (2, "d2", "mushuk sut ichadi"), (3, "d2", "mushuk sut ichadi")], "qid long, id string, evidence string")
    got = {(r.qid, r.id): r.passes for r in retrieval.evidence_gate(q, pairs, docs).collect()}
    assert got == {(1, "d2"): True, (1, "d3"): False, (2, "d2"): False, (3, "d2"): True}


def test_fusion_weights(spark):
    dn = spark.createDataFrame([(1, "a", "a", 0.95), (1, "b", "b", 0.6)], "qid long, id string, source_key string, similarity double")
    lx = spark.createDataFrame([(1, "b", "b", -5.0), (1, "a", "a", -1.0)], "qid long, id string, source_key string, score double")
    first = lambda w1, w2: retrieval.rrf(dn, lx, w1, w2).orderBy(F.col("rrf").desc()).first().source_key
    assert first(1.0, 0.2) == "a" and first(0.1, 2.0) == "b"


def test_merge_variants(spark):
    rows = [(1, v, r + 1, s) for v, ss in enumerate(["abcd", "xyda"]) for r, s in enumerate(ss)]
    got = retrieval.merge_variants(spark.createDataFrame(rows, "qid long, variant int, rank int, source_key string"), 4)
    assert [r.source_key for r in got.orderBy("rank").collect()] == ["a", "x", "b", "y"]


def test_representative_prefers_evidence(spark):
    rows = [(1, "s", "i", 0, 1, False), (1, "s", "j", 1, 3, True), (1, "s", "k", 1, 4, True), (1, "t", "m", 0, 2, False)]
    got = retrieval.representatives(spark.createDataFrame(rows, "qid long, source_key string, id string, leg int, pos int, passes boolean")).collect()
    assert {(r.source_key, r.id, r.passes, r.n_siblings) for r in got} == {("s", "j", True, 2), ("t", "m", False, 0)}


def test_packing(spark):
    assert spark.range(1).select(retrieval.packed(F.array(*[F.lit(x).cast("long") for x in (6, 5, 3, 1, 1)]), 10)).first()[0] == [True, False, True, True, False]


def test_vector_ties_and_graph(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, vector array<double>")
    assert [(r.id, r.rank) for r in dense.vector_topk(q, v, k=2).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert [tuple(r) for r in graph.knn_graph(v).collect()] == [(1, 2, 1.0)]
    assert dense.vector_topk(q.where("false"), v).count() == 0


@pytest.mark.parametrize("kind,near", [("long", 64), ("string", 0)])
def test_all_pairs_are_compared_by_tasks_alone(spark, monkeypatch, kind, near):
    """All against all equals the whole product with its ties, and no vector goes through the driver."""
    for name, value in (("BLOCK", 50), ("PACK", 32), ("SIDE", 3), ("TASKS", 5), ("STRIP", 20), ("NEAR", near)):
        monkeypatch.setattr(dense, name, value)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    x[40:140] = x[40]  # a hundred of one vector, some near it, and two without length
    x[140:160] = x[40] + 1e-6 * rng.standard_normal((20, 8)).astype(np.float32)
    x[[7, 250]] = 0
    ids = rng.permutation(300)
    ids = [int(i) if kind == "long" else f"v{i}" for i in ids]
    v = spark.createDataFrame([(i, e.tolist()) for i, e in zip(ids, x)] + [(None, [1.0] * 8)], f"id {kind}, vector array<float>")
    u = x.astype(float) / np.where((m := np.linalg.norm(x.astype(float), axis=1, keepdims=True)) == 0, 1, m)
    s = np.round(u @ u.T, 6)
    for k, floor, skip in ((6, None, True), (10, None, False), (6, 0.5, True)):
        want = set()
        for a, i in enumerate(ids):
            rest = sorted((-s[a, b], j) for b, j in enumerate(ids) if not (skip and i == j) and (floor is None or s[a, b] >= floor))
            want |= {(i, j, -t + 0.0, r + 1) for r, (t, j) in enumerate(rest[:k])}
        with monkeypatch.context() as only:
            only.setattr(type(v), "collect", lambda self: pytest.fail("collected"))
            found = dense.all_topk(v, k, floor, skip)
        assert {(r.qid, r.id, r.similarity + 0.0, r["rank"]) for r in found.collect()} == want


def test_lsh_recall(spark):
    import numpy as np

    x = np.random.default_rng(1).standard_normal((300, 16))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<float>")
    q = v.where("id % 20 = 0").withColumnRenamed("id", "qid")
    exact = {(r.qid, r.id) for r in dense.vector_topk(q, v, k=10, floor=0.0).collect()}
    near = {(r.qid, r.id) for r in dense.lsh_topk(q, v, k=10, floor=0.0).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_lsh_recall_as_registered(spark):
    from tessera.plans import base, catalog  # noqa: F401

    d = base.Data(spark, "/root/testdata/sf0.01")
    exact = {(r.qid, r.id) for r in dense.vector_topk(d.query_vectors, d.vectors).collect()}
    near = {(r.qid, r.id) for r in base.QUERIES["vector_lsh"](spark, d.dir).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_store(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, x string")
    assert {tuple(r) for r in store.upsert(old, new).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {r.id for r in store.delete(old, new, F.col("x") == "a").collect()} == set()
    plan = {r.id: r.action for r in store.sync_plan(old, new, hashes=("x",)).collect()}
    assert plan == {1: "delete", 2: "upsert", 3: "upsert"}
    assert tuple(store.drift(old, new, hashes=("x",)).first()) == (1, 1, 1, 3)
    assert {r.check: r.n for r in store.verify(old, new).collect()} == {"expected": 2, "actual": 2, "missing": 2, "excess": 2}


def test_last_row_of_a_key_counts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    new = spark.createDataFrame([(2, "z"), (2, "c"), (3, None), (3, "d"), (3, "d")], "id long, x string")
    assert sorted(tuple(r) for r in store.upsert(old, new).collect()) == [(1, "a"), (2, "z"), (3, "d")]
    late = new.withColumn("at", F.when(F.col("x") == "c", 9).otherwise(1))
    got = store.upsert(old.withColumn("at", F.lit(0)), late, order="at").select("id", "x").collect()
    assert sorted(tuple(r) for r in got) == [(1, "a"), (2, "c"), (3, "d")]


def test_hashes_tell_rows_apart(spark):
    rows = [("t", None, "b"), ("t", "a", None), ("t", 'a", "y": "b', ""), ("t", "a", "b"), (None, "a", "b")]
    df = spark.createDataFrame(rows, "d string, x string, y string")
    got = df.select(*store.content_hashes(F.col("d"), {"y": F.col("y"), "x": F.col("x")})).collect()
    assert len({r.meta_sha256 for r in got}) == 4 and None not in {v for r in got for v in r}
    hashed = df.select(F.monotonically_increasing_id().alias("id"), *store.content_hashes(F.col("d"), {"x": F.col("x")}))
    from tessera.staging import staged

    hashed = staged(hashed, "hashed")
    assert store.corpus_hash(hashed).first()[0] == store.corpus_hash(hashed.repartition(3)).first()[0] != store.corpus_hash(hashed.where("id > 0")).first()[0]


def test_snapshots_survive_crashes_and_rivals(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "kb")
    one, two = spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(1,), (2,)], "id long")
    assert snapshots.current_snapshot(spark, root) is None and snapshots.version(spark, root) == 0
    snapshots.commit_snapshot(spark, one, root, "a")
    put = snapshots.Folder.put
    monkeypatch.setattr(snapshots.Folder, "put", lambda *a, **k: 1 / 0)  # the process dies between files and pointer
    with pytest.raises(ZeroDivisionError):
        snapshots.commit_snapshot(spark, two, root, "b")
    monkeypatch.setattr(snapshots.Folder, "put", put)
    assert snapshots.current_snapshot(spark, root).count() == 1
    at = snapshots.version(spark, root)
    snapshots.commit_snapshot(spark, two, root, "c", at)
    with pytest.raises(snapshots.Conflict):
        snapshots.commit_snapshot(spark, one, root, "d", at)
    with pytest.raises(snapshots.Conflict):  # both saw the old version; the pointer decides
        snapshots.Folder(spark, root).put(f"{snapshots.POINTERS}/{at + 1:012d}", "d")
    assert snapshots.current_snapshot(spark, root).count() == 2
    assert snapshots.rollback(spark, root) == "a" and snapshots.current_snapshot(spark, root).count() == 1
    assert set(snapshots.retain(spark, root, 1)) == {"b", "c", "d"} and snapshots.current_snapshot(spark, root).count() == 1
    with pytest.raises(ValueError):
        snapshots.rollback(spark, root, 1)
    assert snapshots.fingerprint(spark, f"{root}/a").first().files > 0


def test_a_build_that_breaks_off_is_not_complete(spark, tmp_path):
    root, rows = str(tmp_path / "kb"), spark.createDataFrame([(1, "a"), (2, "b")], "id long, document string")
    manifest = rows.select("id", *store.content_hashes(F.col("document"), {"id": F.col("id").cast("string")}))
    assert snapshots.check(spark, root) == {"published": False, "complete": False, "counts_agree": False, "identity_agrees": False}
    snapshots.build(spark, rows, manifest, root, "a", {"model": "m"}, "h")
    assert all(snapshots.check(spark, root, {"model": "m"}).values()) and not snapshots.check(spark, root, {"model": "n"})["identity_agrees"]
    assert snapshots.unchanged(spark, root, {"model": "m"}, "h") and not snapshots.unchanged(spark, root, {"model": "m"}, "other")
    with pytest.raises(ValueError, match="manifest lists 1"):
        snapshots.build(spark, rows, manifest.limit(1), root, "b", {"model": "m"}, "h")
    assert snapshots.completed(spark, root, "b") is None and not snapshots.check(spark, root)["complete"]


def test_repair_and_pending(spark):
    df = lambda rows: spark.createDataFrame(rows, "id long, x string")
    plan = spark.createDataFrame([(1, "delete"), (2, "upsert"), (3, "add"), (4, "unchanged")], "id long, action string")
    assert {tuple(r) for r in store.repair(df([(1, "a"), (2, "b"), (4, "d")]), plan, df([(2, "B"), (3, "C"), (4, "D")])).collect()} == {(2, "B"), (3, "C"), (4, "d")}
    index, left = store.retry_pending(df([(1, "a"), (9, "gone")]), spark.createDataFrame([(1,), (9,)], "id long"), df([(1, "A")]))
    assert {tuple(r) for r in index.collect()} == {(1, "A")} and left.count() == 0
    assert [r.ok for r in store.health(spark, "/nonexistent/kb").collect()] == [False]
    old = spark.createDataFrame([("a", "2026-01-01 00:00:00"), ("b", "2026-01-01 01:30:00")], "name string, s string").withColumn("started", F.to_timestamp("s"))
    assert [r.name for r in store.stale(old, F.to_timestamp(F.lit("2026-01-01 02:00:00"))).collect()] == ["a"]


def test_names_pass_those_that_are_taken(spark):
    rows = [(1, "x"), (2, "x-2"), (3, "x"), (4, "x"), (5, "y"), (6, "y"), (7, "x-2"), (8, "x-3")]
    got = {r.n: r["name"] for r in parse.dedupe_names(spark.createDataFrame(rows, "n long, s string"), "s", "n").collect()}
    used, want = set(), {}
    for n, s in rows:
        name, k = s, 2
        while name in used:
            name, k = f"{s}-{k}", k + 1
        used.add(name)
        want[n] = name
    assert got == want


def test_items_are_found_where_they_stand(spark):
    docs = spark.createDataFrame([(1, "a long word here and more"), (2, "prefixlong word here an"), (3, None), (4, "long  word"), (5, "word")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "long word here an"), (2, "word"), (3, "long  word"), (4, ""), (5, None), (6, "no such thing there")], "qid long, q string")
    want = {(q, d) for q, t in [(1, "long word here an"), (2, "word"), (3, "long  word"), (4, "")] for d, x in [(1, "a long word here and more"), (2, "prefixlong word here an"), (4, "long  word"), (5, "word")] if t in x}
    assert {tuple(r) for r in evaluate.containing(docs, items).collect()} == want


def test_sweep_by_brute_force(spark):
    import random

    rng = random.Random(4)
    queries = [(q, rng.choice(["answerable", "answerable", "near_miss", "unanswerable"])) for q in range(30)]
    hits = [(q, rank, round(rng.random(), 3)) for q, k in queries if k == "answerable" for rank in rng.sample(range(1, 14), rng.randint(0, 5))]
    top = [(q, round(rng.random(), 3)) for q, _ in queries if rng.random() < 0.8]
    thetas = [round(i * 0.05, 4) for i in range(20)] + [s for _, s in top[:5]]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = {r.theta: (r.r10, r.mrr, r.far) for r in evaluate.sweep(frame(queries, "qid long, kind string"), frame(top, "qid long, score double"), frame(hits, "qid long, rank int, score double"), frame([(t,) for t in set(thetas)], "theta double")).collect()}
    yes, no = [q for q, k in queries if k == "answerable"], [q for q, k in queries if k != "answerable"]
    for t in set(thetas):
        first = {q: min((r for p, r, s in hits if p == q and s >= t), default=None) for q in yes}
        want = (sum(f is not None and f <= 10 for f in first.values()) / len(yes), sum(1 / f for f in first.values() if f) / len(yes), sum(s >= t for q, s in top if q in no) / len(no))
        assert got[t] == pytest.approx(want, abs=6e-5), t


def test_ties_are_bounded(spark):
    rows = [(i, [1.0, 0.0]) for i in range(3000, 0, -1)] + [(0, [0.9, 0.1])]
    v, q = spark.createDataFrame(rows, "id long, vector array<double>"), spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1])], "qid long, vector array<double>")
    got = {(r.qid, r.rank): r.id for r in dense.vector_topk(q, v, k=3).collect()}
    assert got == {(1, 1): 1, (1, 2): 2, (1, 3): 3, (2, 1): 0, (2, 2): 1, (2, 3): 2}


def test_stored_index(spark, docs, tmp_path):
    stored = index.of_docs(docs).write(str(tmp_path / "index"))
    q = spark.createDataFrame([(1, "mushuk it"), (2, "sut")], "qid long, text string")
    plain = sorted(map(tuple, lexical.keyword_topk(q, docs).collect()))
    assert sorted(map(tuple, lexical.keyword_topk(q, index.read(spark, str(tmp_path / "index"))).collect())) == plain
    assert {r.term: (r.df, r.parents) for r in stored.terms.collect()}["mushuk"] == (2, 2) and stored.stats.first().n_parents == 4


def test_audit_finds_each_category(spark):
    archive = spark.createDataFrame([("A", True, 1), ("B", False, 1), ("C", True, 1)], "shortcode string, usable boolean, n_items int")
    rows = [("1", "A", 2, "s", 10), ("2", "B", 0, "s", 10), ("3", "Z", 0, "s", 10), ("4", None, 0, "f", 10), ("5", None, 0, "f", 300)]
    chunks = spark.createDataFrame(rows, "id string, shortcode string, item int, source string, token_count int")
    assert {r.check: r.n for r in audit.summary(audit.findings(archive, chunks)).collect()} == dict.fromkeys(["usable_not_indexed", "unusable_indexed", "orphan_items", "missing_archive", "duplicate_files", "long_chunks"], 1)


def test_metrics(spark):
    rows = [(1, "uz", "answerable", 1), (2, "uz", "answerable", 3), (3, "en", "answerable", 6), (4, "en", "answerable", None), (5, "en", "near_miss", None)]
    df = spark.createDataFrame(rows, "qid long, lang string, kind string, first int")
    got = df.agg(*(evaluate.recall_at(k) for k in (1, 5, 10)), evaluate.mrr()).first()
    assert tuple(got) == (0.25, 0.5, 0.75, 0.375)
    by = {r.lang: (r.r, r.m) for r in evaluate.by_language(df, evaluate.recall_at(10).alias("r"), evaluate.mrr().alias("m")).collect()}
    assert by == {"overall": (0.75, 0.375), "uz": (1.0, 0.6667), "en": (0.5, 0.0833)}


def test_budget_chunks():
    assert parse.budget_chunks("") == [] and parse.budget_chunks("a b") == [("a b", 2)]
    text = " ".join(f"w{i}" for i in range(1000))
    chunks = parse.budget_chunks(text)
    assert all(n <= parse.BUDGET for _, n in chunks) and chunks[-1][0].endswith("w999")
    assert all(set(a.split()) & set(b.split()) for (a, _), (b, _) in zip(chunks, chunks[1:]))
    assert all(n <= parse.BUDGET for _, n in parse.budget_chunks("." * 5000))
    of = lambda text: [c for c, _ in parse.budget_chunks(text, budget=4, overlap=2)]
    assert of("a b c d e f g") == ["a b c d", "c d e f", "e f g"]
    assert of("a b c d. e f") == ["a b c d", "c d. e", "e f"]
    assert of("a\n\nb ....... c") == ["a\n\nb", "....", "... c"]


def test_stream_merges_and_repeats_nothing(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "store")
    schema = "id long, ts timestamp, x string"
    for rows in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]):
        spark.createDataFrame(rows, "id long, x string").selectExpr("id", "current_timestamp() ts", "x").write.mode("append").parquet(src)
        ingest.ingest(spark, src, schema, root, str(tmp_path / "cp")).awaitTermination()
    assert {(r.id, r.x) for r in ingest.current(spark, root, schema).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_stale_counts_parts_of_a_second(spark):
    rows = [(1, "2026-01-01 10:00:00.10"), (2, "2026-01-01 10:00:00.90"), (3, "2026-01-01 09:59:59.95"), (4, "2026-01-01 10:00:00.50"), (5, None)]
    for kind in ("timestamp", "timestamp_ntz"):
        started = spark.createDataFrame(rows, "id long, s string").select("id", F.col("s").cast(kind).alias("started"))
        old = store.stale(started, F.lit("2026-01-01 11:00:00.50").cast(kind))
        assert {r.id for r in old.collect()} == {1, 3}


def test_a_stored_index_is_built_and_searched_without_moving_postings(spark, tmp_path):
    """Counting words shuffles nothing, nor does scoring but the best of each task; ties of copies go by id, nulls and empty texts match nothing."""
    rows = [(f"d{i:03}", "x", "note", f"p{i // 4}", "", None if i == 7 else "" if i == 8 else f"olma{i % 5} nok olma{i % 5} anor " + "uzum " * (i % 9)) for i in range(300)]
    docs = lexical.kw_docs(spark.createDataFrame(rows, "id string, project string, kind string, parent_id string, title string, document string").repartition(3))
    made = index.of_docs(docs)
    plan = made.postings._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == docs._jdf.queryExecution().executedPlan().toString().count("Exchange")
    stored = made.write(str(tmp_path / "index"))
    assert sorted(map(tuple, stored.postings.select("id", "term", "tf").collect())) == sorted(map(tuple, lexical.postings(docs).collect()))
    q = spark.createDataFrame([(1, "olma1 uzum"), (2, "anor"), (3, "yo'q"), (4, ""), (5, "olma2 olma3 nok")], "qid long, text string")
    want = sorted(map(tuple, lexical.top(lexical.bm25(q, stored), [F.col("score"), F.col("id")], 12).collect()))
    found = lexical.keyword_topk(q, stored, 12)
    assert sorted(map(tuple, found.select("qid", "id", "score", "rank").collect())) == want and len(want) == 36
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    empty = index.of_docs(docs.limit(0)).write(str(tmp_path / "empty"))
    assert lexical.keyword_topk(q, empty).count() == 0 and lexical.keyword_topk(q.limit(0), stored).count() == 0


def test_best_documents_need_no_postings(spark, tmp_path):
    """Frequencies of asked words are counted where the documents are; the plain queries write neither postings nor terms (F12 to F23)."""
    rows = [(i, f"olma{i % 5} nok olma{i % 5} anor " + "uzum " * (i % 9) if i != 7 else None, "en", f"src{i % 3}", 9) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "olma1 uzum"), (2, "anor"), (3, "yo'q"), (4, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    made = lambda: {k[2] for k in base._INDEXES if k[1] == str(tmp_path)}
    hits = base.QUERIES["keyword_topk"](spark, str(tmp_path)).collect()
    assert base.QUERIES["context_pack"](spark, str(tmp_path)).count() == 20 and made() == {"words"}
    d = base.Data(spark, str(tmp_path))
    assert {r.term: r.df for r in lexical.asked_doc_freq(d.words.docs, lexical.query_terms(d.queries)).collect()} == {"olma1": 24, "uzum": 105, "anor": 119}
    want = lexical.top(lexical.bm25(d.queries, d.index), [F.col("score"), F.col("id")], 50).select("qid", "id", "score", "rank").collect()
    assert len(want) == 100 and sorted((r.qid, r.id, r["score"]) for r in hits) == sorted((r.qid, r.id, r.score) for r in want)
    assert made() == {"words", "index"} and sorted(map(tuple, lexical.keyword_topk(d.queries, d.index).select("qid", "id", "score", "rank").collect())) == sorted(map(tuple, want))


def test_stored_words_are_one_string_and_counted_as_lists_are(spark, tmp_path):
    """Slices, empty texts and nulls of stored words give the words and rows of their lists; tasks read no list of words from storage."""
    import pyarrow as pa

    lists = pa.array([["a", "b", "a"], [], ["d"], None, ["o'z", "e"]] * 5)
    joined = pa.array([x if x is None else " ".join(x) for x in lists.to_pylist()])
    for at, n in ((0, 25), (1, 7), (8, 2), (3, 1), (1, 1)):
        got, want = (lexical.flat_words(a.slice(at, n)) for a in (joined, lists))
        assert got[0].to_pylist() == want[0].to_pylist() and got[1].tolist() == want[1].tolist()
    rows = [(f"d{i:04}", "x", "note", f"p{i // 4}", None, None if i % 7 == 0 else "" if i % 7 == 1 else f"o'z{i} don\u2019t `` KITOBLARNI " + "uzum " * (i % 9)) for i in range(1300)]
    docs = lexical.kw_docs(spark.createDataFrame(rows, "id string, project string, kind string, parent_id string, title string, document string").repartition(1))
    stored = index.of_docs(docs).write_words(str(tmp_path / "index"))
    assert dict(spark.read.parquet(str(tmp_path / "index" / "docs")).dtypes)["words"] == "string"
    same = ["id", "project", "kind", "parent_id", "token_count", "tokens"]
    assert sorted(map(repr, stored.docs.select(same).collect())) == sorted(map(repr, docs.select(same).collect()))
    assert sorted(map(tuple, stored.postings.select("id", "term", "tf").collect())) == sorted(map(tuple, lexical.postings(docs).collect()))
    q = spark.createDataFrame([(1, "o'z5 uzum"), (2, "don't kitob")], "qid long, text string")
    want = lexical.top(lexical.bm25(q, docs), [F.col("score"), F.col("id")], 40).select("qid", "id", "score", "rank")
    assert sorted(map(tuple, lexical.keyword_topk(q, stored, 40).select("qid", "id", "score", "rank").collect())) == sorted(map(tuple, want.collect()))


def test_title_is_that_of_the_whole_text(spark, tmp_path):
    texts = [None, "", "  a\t\n b ", "x" * 50, " \n" * 60 + "y", ("ab" + " " * 9) * 30, "\U0001f600 " * 45, "a\u00a0b\u2028c " * 20]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    whole = F.left(F.regexp_replace("text", "[ \t\n\r]+", " "), F.lit(40))
    assert [r.t for r in df.select(base.titled(F.col("text")).alias("t")).collect()] == [r.t for r in df.select(whole.alias("t")).collect()]


def test_degraded_search_needs_no_vectors(spark, tmp_path):
    """With the vector leg gone the words alone answer: no vector is read, none compared (F14)."""
    rows = [(i, f"olma{i % 5} nok anor " + "uzum " * (i % 9), "en", f"src{i % 3}", 9) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "olma1 uzum"), (2, "anor")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = base.QUERIES["search_degraded"](spark, str(tmp_path)).collect()
    assert {r.qid for r in found} == {1, 2} and {r.degraded for r in found} == {"vector_search_failed"}
