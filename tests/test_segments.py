"""Segmented stores against stores made anew, and pruned search against whole search."""

import random

import pytest
from pyspark.sql import functions as F

from tessera import engine
from tessera.operators import impacts, index, lexical, segments, snapshots
from tessera.staging import scratch

SCHEMA = "id string, document string, title string, project string, source string"


def chunk_rows(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def front(spark, tmp_path):
    return engine.SearchEngine(spark, str(tmp_path / "kb"), current_project="alpha")


def texts(rng, n, words):
    return [" ".join(rng.choice(words) for _ in range(rng.randint(3, 12))) for _ in range(n)]


WORDS = "mushuk it sut suyak baliq uy bog' kitob kitoblar daftar qalam maktab yo'l daraxt olma gul tosh suv non choy".split()


def counted(index_):
    return sorted((r.term, r.df, r.parents, r.stem) for r in index_.terms.collect()), sorted(tuple(r) for r in index_.postings.collect()), tuple(index_.stats.first())


def test_an_upsert_of_one_row_writes_one_row(spark, front):
    rng = random.Random(1)
    front.upsert(chunk_rows(spark, [(f"c{i}", t, "T", "alpha", f"f{i % 7}") for i, t in enumerate(texts(rng, 60, WORDS))]))
    made = front.upsert(chunk_rows(spark, [("c5", "yangi mushuk matni", "N", "alpha", "f5")]))
    assert (made.rows, made.buried, made.dead) == (1, 1, 1) and made.dead_tokens > 0
    at = f"{front.root}/{{}}/in_segment={made.name}"
    assert spark.read.parquet(at.format("rows")).count() == 1 and spark.read.parquet(at.format("buried")).count() == 1
    assert spark.read.parquet(at.format("postings")).count() == len({"yangi", "mushuk", "matni", "n"}) and spark.read.parquet(at.format("words")).count() == 4
    assert front.chunks().count() == 60 and front.fetch("c5").first().document == "yangi mushuk matni"
    assert front.delete("c6", "c6", "absent") == 1
    last = front.store.segments()[-1]
    assert (last.rows, last.buried, last.dead) == (0, 1, 1) and front.delete("absent") == 0 and front.store.segments()[-1] == last


def test_search_equals_a_full_rebuild(spark, front, tmp_path, monkeypatch):
    """Writes of all kinds; in the end search, counts and postings are those of a store with the same rows."""
    rng, live = random.Random(5), {}
    questions = ["mushuk sut", "kitoblar maktab", "bog' gul olma", "tosh"]
    monkeypatch.setattr(segments, "MOST", 3)
    for step in range(9):
        kind = rng.random()
        if kind < 0.6 or not live:
            new = {f"c{rng.randrange(25)}": (t, f"f{rng.randrange(5)}") for t in texts(rng, rng.randint(1, 4), WORDS)}
            front.upsert(chunk_rows(spark, [(i, t, "T", "alpha", s) for i, (t, s) in new.items()]))
            live |= new
        elif kind < 0.8:
            gone = rng.choice(sorted(live))
            assert front.delete(gone) == 1
            del live[gone]
        else:
            source = f"f{rng.randrange(5)}"
            new = {f"r{step}": (texts(rng, 1, WORDS)[0], source)}
            front.replace_sources(chunk_rows(spark, [(i, t, "T", "alpha", s) for i, (t, s) in new.items()]), [source])
            live = {i: v for i, v in live.items() if v[1] != source} | new
        found = front.store.segments()
        assert len(found) <= 4 and front.store.counts()[0] == len(live)
        if step == 8:
            assert {r.id: (r.document, r.source) for r in front.chunks().collect()} == live
            other = engine.SearchEngine(spark, str(tmp_path / f"anew{step}"), current_project="alpha")
            other.upsert(chunk_rows(spark, [(i, t, "T", "alpha", s) for i, (t, s) in live.items()]))
            asked = spark.createDataFrame([(w,) for w in ("mushuk", "kitob", "maktab", "none")], "term string")
            assert counted(front.store.index(asked)) == counted(other.store.index(asked))
            one, two = (sorted(map(tuple, e.search(questions).collect()), key=repr) for e in (front, other))
            assert one == two and one


def test_compaction_and_rollback(spark, tmp_path):
    schema = spark.createDataFrame([], "id long, x string").schema
    held = segments.Store(spark, str(tmp_path / "s"), schema)
    written = 0
    for i in range(24):
        made = held.write(spark.createDataFrame([(i % 18, f"v{i}")], schema))
        written += made.rows
        if (merged := held.compact()) is not None:
            written += merged.rows
    want = {i: f"v{i + 18 if i < 6 else i}" for i in range(18)}
    assert {r.id: r.x for r in held.rows().collect()} == want and held.counts()[0] == 18
    assert len(held.segments()) <= segments.MOST and written < 24 * 4  # not 24 * 24 / 2
    held.write(None, spark.createDataFrame([(3,), (99,)], "id long"))
    assert held.rows().count() == 17 and held.counts()[0] == 17
    held.rollback()
    assert {r.id: r.x for r in held.rows().collect()} == want
    before = held.version
    assert held.retain(1) and {r.id: r.x for r in held.rows().collect()} == want
    with pytest.raises(ValueError):
        held.rollback(before - 1)
    held.compact(held.segments())
    (one,) = held.segments()
    assert (one.rows, one.buried, one.dead) == (18, 0, 0) and {r.id: r.x for r in held.rows().collect()} == want
    with pytest.raises(ValueError):
        held.compact([one, one])


def test_rivals_conflict(spark, tmp_path, monkeypatch):
    schema = spark.createDataFrame([], "id long, x string").schema
    a, b = (segments.Store(spark, str(tmp_path / "s"), schema) for _ in range(2))
    rows = spark.createDataFrame([(1, "a")], schema)
    a.write(rows)
    at = b.version
    a.write(spark.createDataFrame([(2, "b")], schema))
    with pytest.raises(snapshots.Conflict):
        b.write(rows, based_on=at)
    with monkeypatch.context() as m:  # the process dies between files and pointer
        m.setattr(snapshots.Folder, "put", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            a.write(spark.createDataFrame([(3, "c")], schema))
    assert {r.id for r in b.rows().collect()} == {1, 2}
    assert segments.Store(spark, str(tmp_path / "new"), schema).rows().count() == 0


def test_a_write_moves_its_rows_once_and_no_words(spark, front, monkeypatch):
    """Rows of one id meet by a shuffle; their words and vectors are made, and postings written, where the rows are."""
    monkeypatch.setattr(segments, "SMALL", 10)
    rows = chunk_rows(spark, [(f"c{i % 150}", t, "T", "alpha", "f") for i, t in enumerate(texts(random.Random(4), 200, WORDS))])
    made = front._completed(rows)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "max_by" not in plan
    written, write = [], type(spark.range(1).write).parquet
    monkeypatch.setattr(type(spark.range(1).write), "parquet", lambda self, path, *a, **b: (written.append((path, self._df._jdf.queryExecution().executedPlan().toString())), write(self, path, *a, **b))[-1])
    front.upsert(rows)
    assert [("Exchange" in p or "Join" in p) for path, p in written if "/postings/" in path] == [False]
    assert not [path for path, _ in written if front.root not in path]  # nothing is staged
    whole = front.chunks()
    assert whole.count() == 150
    want = whole.select("id", F.explode("tokens").alias("term")).groupBy("term", "id").count()
    assert sorted(map(tuple, front.store.postings().select("term", "id", "tf").collect())) == sorted(map(tuple, want.collect()))


def test_large_segments_are_opened_by_part(spark, front, monkeypatch):
    monkeypatch.setattr(segments, "SMALL", 10)
    rng = random.Random(2)
    front.upsert(chunk_rows(spark, [(f"c{i}", t, "T", "alpha", "f") for i, t in enumerate(texts(rng, 200, WORDS))]))
    front.upsert(chunk_rows(spark, [("c0", "mushuk", "T", "alpha", "f")]))
    asked = spark.createDataFrame([("mushuk",)], "term string")
    posts = front.store.postings(asked)
    plan = posts._jdf.queryExecution().toString()
    assert any("PartitionFilters" in x and "part#" in x.split("PartitionFilters")[1].split("]")[0] for x in plan.splitlines())
    whole = front.store.postings().where("term = 'mushuk'")
    assert sorted(map(tuple, posts.collect())) == sorted(map(tuple, whole.collect()))


def test_rows_without_id_are_refused(spark, front):
    with pytest.raises(Exception, match="chunk without id"):
        front.upsert(chunk_rows(spark, [(None, "x", "T", "alpha", "f")]))


# ---- search by impact


def corpus(spark, n, seed=3):
    """Words of all frequencies, some in nearly every document."""
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 4000}"
    rows = [(f"d{i:05d}", "", " ".join(word() for _ in range(rng.randint(1, 90))), f"p{i // 3}", "x", "note" if i % 3 else "doc") for i in range(n)]
    return spark.createDataFrame(rows, "id string, title string, document string, parent_id string, project string, kind string"), rng


@pytest.mark.parametrize("block,k", [(4, 5), (128, 50)])
def test_pruned_search_is_exact(spark, monkeypatch, block, k):
    monkeypatch.setattr(impacts, "BLOCK", block)
    monkeypatch.setattr(impacts, "LIST", 100)  # long lists in several pieces
    chunks, rng = corpus(spark, 1500)
    whole = index.build(chunks, scratch(spark, "index"))
    pruned = impacts.build(whole, scratch(spark, "impacts"))
    ask = lambda n: " ".join(f"w{int(rng.paretovariate(0.7)) % 4000}" for _ in range(n))
    rows = [(i, ask(n)) for i, n in enumerate([1, 2, 3, 8, 20, 40, 40, 60])] + [(90, "w1"), (91, "w1 w1 w2"), (92, ""), (93, "absent"), (94, None), (95, "w3999 w3998 absent w1")]
    q = spark.createDataFrame(rows, "qid long, text string")
    want = sorted(map(tuple, lexical.keyword_topk(q, whole, k=k).collect()))
    found = impacts.search(q, pruned, k)
    assert sorted(map(tuple, found.result().select("qid", "id", "score", "rank").collect())) == want
    allowed = chunks.where("kind = 'doc'").select("id")
    want = sorted(map(tuple, lexical.keyword_topk(q, whole, k=k, allowed=allowed).collect()))
    assert sorted(map(tuple, impacts.keyword_topk(q, pruned, k, allowed).select("qid", "id", "score", "rank").collect())) == want
    pieces = pruned.blocks.groupBy("term").agg(F.sum("n").alias("n"), F.count_distinct("piece").alias("p"), F.max("n").alias("most")).collect()
    assert max(r.p for r in pieces) > 3 and max(r.most for r in pieces) <= block and sum(r.n for r in pieces) == whole.postings.count()


def test_empty_index_finds_nothing(spark):
    chunks, _ = corpus(spark, 3)
    pruned = impacts.build(index.build(chunks.limit(0), scratch(spark, "index")), scratch(spark, "impacts"))
    q = spark.createDataFrame([(1, "w1")], "qid long, text string")
    assert impacts.keyword_topk(q, pruned).count() == 0 and impacts.keyword_topk(q.limit(0), pruned).count() == 0


def test_under_half_of_the_postings_are_read(spark):
    import os

    from tessera.plans import base, catalog  # noqa: F401

    if not os.path.isdir("/root/testdata/sf0.1"):
        pytest.skip("no tables")
    d = base.Data(spark, "/root/testdata/sf0.1")
    r = impacts.search(d.queries, d.impacts).read().agg(F.sum("n_postings").alias("n"), F.sum("n_read").alias("read")).first()
    print(f"keyword_topk_pruned: {r.read} of {r.n} postings read")
    assert r.read < 0.5 * r.n
