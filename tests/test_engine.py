"""The front, model identity and model slots."""

import json

import pytest

from tessera import identity
from tessera.engine import SearchEngine
from tessera.functions import models

FULL = {"schema_version": 2, "backend": "b", "model": "m", "model_digest": "d", "dimension": 4, "distance": "l2", "normalization": False}


def test_identity():
    assert identity.parse(FULL).dimension == 4
    assert identity.parse({f"x:{k}": str(v) for k, v in FULL.items()}, "x:") == identity.parse(FULL)
    for bad in ({"dimension": 4.5}, {"dimension": True}, {"normalization": "maybe"}, {"model": ""}, {"distance": "hamming"}, {"dimension": 0}, {"x:dimension": 5}):
        with pytest.raises(identity.IdentityError):
            identity.parse(FULL | bad, "x:")
    with pytest.raises(identity.IdentityError, match="model"):
        identity.agree(identity.parse(FULL), identity.parse(FULL | {"model": "n"}))
    assert identity.space_of({"space": "l2"}, {"space": "ip"}) == "l2" and identity.space_of(None, {"hnsw:space": "ip"}) == "ip"
    with pytest.raises(identity.IdentityError):
        identity.space_of({}, {})


def test_models(spark):
    models.checked("hashed", 8, dimension=8)
    with pytest.raises(ValueError):
        models.checked("hashed", 9, dimension=8)
    df = spark.createDataFrame([("a", "x y"), ("b", None)], "id string, document string")
    assert {r.id: len(r.embedding) for r in models.embed(df, dimension=8).collect()} == {"a": 8, "b": 8}
    pairs = spark.createDataFrame([(1, "a", "x q", "x y"), (1, "b", "x", "x")], "qid long, id string, question string, text string")
    assert {r.id: r.rerank_score for r in models.score_pairs(pairs).collect()} == {"a": 0.5, "b": 1.0}
    assert {r.rerank_score for r in models.score_pairs(pairs, budget=-1.0).collect()} == {None}
    calls = []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return texts

    assert models.with_retry(flaky, pause=0)(["x"]) == ["x"] and len(calls) == 3


def test_engine(spark, tmp_path):
    e = SearchEngine(spark, str(tmp_path / "kb"), current_project="alpha")
    assert e.list_memories().count() == 0
    rows = [("1", "mushuk sut ichadi va uxlaydi", "Mushuk", "alpha", "f1", None), ("2", "it suyak yeydi", "It", "alpha", "f2", None), ("3", "mushuk sut maxfiy", "Secret", "beta", "f3", None), ("4", "mushuk sut eski", "Old", "alpha", "f4", "false")]
    e.upsert(spark.createDataFrame(rows, "id string, document string, title string, project string, source string, usable string"))
    got = e.search(["mushuk sut", "what is the", "samolyot qanoti"]).collect()
    assert [(r.qid, r.id) for r in got if r.bucket == "result"] == [(0, "1")]
    assert not {r.id for r in got} & {"3", "4"} and not [r for r in got if r.qid == 1]
    note = e.save_memory("yangi eslatma", "Note", kind="odd", private=True)
    assert e.fetch(note).first().kind == "note" and e.list_memories(1).first().id == note
    assert e.delete(note) == 1 and e.delete("absent") == 0 and e.chunks().count() == 4
    packed = e.context("mushuk sut", "alpha").collect()
    assert [(json.loads(r.record)["id"], r.role, r.truncated) for r in packed if r.role == "hit"] == [("1", "hit", False)]
    assert "text" in json.loads(packed[0].record) and e.project == "alpha"
    assert {r.project for r in e.context("mushuk sut", "beta").collect()} <= {"beta", "shared", "Promtlarim"} and e.project == "alpha"
    assert all(r.truncated for r in e.context("mushuk sut", "alpha", max_chars=20).collect())
    with pytest.raises(ValueError):
        e.context("mushuk", "all")
    assert {r.step for r in e.health().where("ok").collect()} == {"opened", "columns", "counted", "queried"}


@pytest.fixture
def small(spark, tmp_path):
    e = SearchEngine(spark, str(tmp_path / "kb"), current_project="alpha")
    rows = [("1", "mushuk sut ichadi va uxlaydi", "Mushuk", "alpha", "f1"), ("2", "sut mushuk uchun", "Sut", "alpha", "f2"), ("3", "it suyak yeydi", "It", "alpha", "f3")]
    e.upsert(spark.createDataFrame(rows, "id string, document string, title string, project string, source string"))
    return e


def test_words_answer_where_vectors_fail(small, monkeypatch):
    whole = small.search(["mushuk sut"]).collect()
    assert {r.degraded for r in whole} == {None} and {r.rerank for r in whole} == {"off"}
    monkeypatch.setattr("tessera.operators.dense.vector_topk", lambda *a, **k: (_ for _ in ()).throw(ValueError("no embedder answers")))
    got = small.search(["mushuk sut"]).collect()
    assert {r.degraded for r in got} == {"vector_search_failed"} and {r.id for r in got if r.bucket == "result"} == {r.id for r in whole if r.bucket == "result"}
    assert small.search_knowledge(["mushuk sut"]).first().degraded == "vector_search_failed"
    monkeypatch.setattr("tessera.operators.dense.vector_topk", lambda *a, **k: (_ for _ in ()).throw(ValueError("collection does not exist")))
    with pytest.raises(ValueError, match="does not exist"):
        small.search(["mushuk sut"])


def test_reranking_in_search(small):
    models.RERANKERS["bad"] = lambda: lambda pairs: 1 / 0
    try:
        plain = [r.id for r in small.search(["mushuk sut"]).orderBy("position").collect()]
        got = small.search(["mushuk sut"], reranker="overlap", rerank_budget=60).orderBy("position").collect()
        assert {r.rerank for r in got} == {"on"} and sorted(r.id for r in got) == sorted(plain)
        missing = small.search(["mushuk sut"], reranker="absent").collect()
        assert {(r.rerank, r.rerank_reason) for r in missing} == {("unavailable", "no reranker is called 'absent'")}
        assert [r.id for r in sorted(missing, key=lambda r: r.position)] == plain
        assert models.first_working(["bad", "overlap"])[0] == "overlap" and models.first_working(["bad"])[0] is None
        pairs = small.spark.createDataFrame([(1, "a", "x", "y")], "qid long, id string, question string, text string")
        assert models._in_flight.acquire(blocking=False)
        assert models.score_within(pairs, "overlap")[1] == "another reranking is running"
        models._in_flight.release()
        scores, reason = models.score_within(pairs, "overlap", budget=0.0)
        assert scores is None and reason == "more than 0 s"
    finally:
        models.RERANKERS.pop("bad")


def test_model_must_be_the_store_s(spark, small):
    other = SearchEngine(spark, small.root, "alpha", dimension=8)
    with pytest.raises(identity.IdentityError, match="dimension"):
        other.search(["mushuk"])
    with pytest.raises(identity.IdentityError):
        other.save_memory("x", "y")
    assert small.identity.dimension == 256 and small.identity.normalization


def test_envelope(small):
    got = {r.qid: r for r in small.search_knowledge(["mushuk sut", "samolyot qanoti"]).collect()}
    assert got[0].status == "ok" and got[0].n_results == 2 and "| id: 1" in got[0].answer and 0 < got[0].returned_tokens <= got[0].whole_tokens
    assert (got[1].status, got[1].n_results, got[1].returned_tokens) == ("insufficient_evidence", 0, 0)


def test_sources_that_became_empty_go(spark, small):
    small.replace_sources(spark.createDataFrame([("9", "yangi matn", "f1")], "id string, document string, source string"), ["f1", "f2"])
    assert {r.id for r in small.chunks().collect()} == {"9", "3"}
    small.rollback()
    assert {r.id for r in small.chunks().collect()} == {"1", "2", "3"}


def test_settings_and_adapter():
    assert models.configured({"dimension": 8, "reranker": None})["dimension"] == 8 and models.configured()["embedder"] == "hashed"
    for bad in ({"colour": 1}, {"embedder": "absent"}, {"reranker": "absent"}):
        with pytest.raises(ValueError):
            models.configured(bad)
    a = models.Adapter("hashed", dimension=8)
    assert a.embed_query("x y") == a(["x y"])[0] == a.embed_documents(["x y"])[0] and "cosine" in a.supported_spaces() and a.default_space() == "cosine"


@pytest.mark.parametrize("stated", [True, False])
def test_long_texts_are_cut_and_tried_again(stated):
    sizes = []

    def encode(text):
        sizes.append(len(text))
        if len(text) > 900:
            raise RuntimeError(f"input ({len(text) * 10} tokens) is too large" if stated else "the input exceeds the context length")
        return [1.0]

    assert models.with_shrinking(encode)(["a" * 5000]) == [[1.0]]
    assert sizes == ([5000, 720] if stated else [5000, 2500, 1250, 625])
    with pytest.raises(RuntimeError):
        models.with_shrinking(lambda t: encode("a" * 2000))(["x" * 100])
    with pytest.raises(OSError):
        models.with_shrinking(lambda t: (_ for _ in ()).throw(OSError("down")))(["x"])


def test_services(spark):
    """A small service of both kinds on this machine."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    asked = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((body, self.headers.get("Authorization")))
            code, out = 200, {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(body.get("input", []))))]}
            if "prompt" in body:
                long = len(body["prompt"]) > 20
                code, out = (500, {"error": "input (16000 tokens) is too large to process"}) if long else (200, {"embedding": [float(len(body["prompt"]))]})
            answer = json.dumps(out).encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(answer)))
            self.end_headers()
            self.wfile.write(answer)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/x"
    try:
        assert models.EMBEDDERS["batch-service"](url=url, model="m", key="k")(["a", "bcd"]).tolist() == [[1.0, 1.0], [3.0, 1.0]] and asked[-1][1] == "Bearer k"
        assert models.EMBEDDERS["prompt-service"](url=url, model="m")(["abc", "x" * 40]).tolist() == [[3.0], [18.0]]
        df = spark.createDataFrame([("a", "four")], "id string, document string")
        assert models.embed(df, "prompt-service", url=url, model="m").first().embedding == [4.0]
    finally:
        server.shutdown()
    with pytest.raises(OSError):
        models.EMBEDDERS["batch-service"](url=url, model="m", seconds=1)(["a"])
