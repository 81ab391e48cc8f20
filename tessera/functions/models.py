"""Where models plug in: embedders and rerankers, registered by name. The defaults need no files and no network."""

from __future__ import annotations

import hashlib
import json
import re
import threading
import time
import urllib.error
import urllib.request
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import InheritableThread
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .. import identity as ids
from ..staging import staged

#: name -> factory of a function from texts to an array (texts x dimension). A factory runs once a worker.
EMBEDDERS: dict[str, Callable[..., Callable[[list[str]], np.ndarray]]] = {}
#: name -> factory of a function from (question, text) pairs to scores.
RERANKERS: dict[str, Callable[..., Callable[[list[tuple[str, str]]], np.ndarray]]] = {}


#: What a configuration says where it says nothing.
DEFAULTS: dict[str, Any] = {"embedder": "hashed", "dimension": 256, "distance": "cosine", "normalization": True, "reranker": None, "rerank_budget": 3.0}


def configured(config: dict[str, Any] | None = None) -> dict[str, Any]:
    """The defaults with what ``config`` says over them; a null says nothing, an unknown name is an error."""
    given = {k: v for k, v in (config or {}).items() if v is not None}
    if unknown := sorted(given.keys() - DEFAULTS.keys()):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    out = DEFAULTS | given
    for kind, known in (("embedder", EMBEDDERS), ("reranker", RERANKERS)):
        if out[kind] is not None and out[kind] not in known:
            raise ValueError(f"no {kind} is called {out[kind]!r}")
    return out


def embedder(name: str):
    return lambda factory: EMBEDDERS.setdefault(name, factory)


def reranker(name: str):
    return lambda factory: RERANKERS.setdefault(name, factory)


@embedder("hashed")
def hashed_embedder(dimension: int = 256):
    """Words hashed into signed places, unit length: the same everywhere."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dimension] += 1 if h & 0x80000000 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def _posted(url: str, body: dict, headers: dict[str, str], seconds: float) -> dict:
    """The JSON that a service answers; its own words are in the error of a refusal."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=seconds) as answer:
            return json.loads(answer.read())
    except urllib.error.HTTPError as e:
        said = e.read().decode(errors="replace")
        raise RuntimeError(f"HTTP {e.code}: {said[:500]}") from e


@embedder("prompt-service")
def prompt_service(url: str, model: str, seconds: float = 60.0):
    """A service that embeds one prompt a request (``{model, prompt}`` -> ``{embedding}``); long prompts are cut and sent again."""

    def one(text: str) -> list[float]:
        found = _posted(url, {"model": model, "prompt": text}, {}, seconds).get("embedding")
        if not found:
            raise RuntimeError(f"an empty embedding from {model}")
        return found

    encode = with_shrinking(one)
    return lambda texts: np.asarray(encode(texts), np.float32)


@embedder("batch-service")
def batch_service(url: str, model: str, key: str = "", seconds: float = 60.0):
    """A service that embeds many texts a request (``{model, input}`` -> ``{data: [{index, embedding}]}``)."""

    def encode(texts: list[str]) -> np.ndarray:
        data = _posted(url, {"model": model, "input": texts}, {"Authorization": f"Bearer {key}"} if key else {}, seconds)["data"]
        if len(data) != len(texts):
            raise RuntimeError(f"{len(data)} embeddings of {len(texts)} texts")
        return np.asarray([d["embedding"] for d in sorted(data, key=lambda d: d["index"])], np.float32)

    return encode


def _onnx(path: str, tokenizer_path: str, max_tokens: int):
    """A session and a function from texts, or pairs of texts, to its inputs; both packages are needed only here."""
    import onnxruntime
    from tokenizers import Tokenizer

    session, tokenizer = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"]), Tokenizer.from_file(tokenizer_path)
    tokenizer.enable_truncation(max_tokens)
    tokenizer.enable_padding()
    wanted = {i.name for i in session.get_inputs()}

    def inputs(texts: list) -> dict[str, np.ndarray]:
        got = tokenizer.encode_batch(texts)
        made = {"input_ids": [e.ids for e in got], "attention_mask": [e.attention_mask for e in got], "token_type_ids": [e.type_ids for e in got]}
        return {k: np.array(v, np.int64) for k, v in made.items() if k in wanted}

    return session, inputs


@embedder("onnx")
def onnx_embedder(path: str, tokenizer_path: str, max_tokens: int = 256):
    """A local model: the mean of its last states over a text's tokens, at unit length."""
    session, inputs = _onnx(path, tokenizer_path, max_tokens)

    def encode(texts: list[str]) -> np.ndarray:
        given = inputs(texts)
        states, mask = session.run(None, given)[0], given["attention_mask"][:, :, None]
        mean = (states * mask).sum(1) / np.maximum(mask.sum(1), 1)
        return (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    return encode


@reranker("onnx")
def onnx_reranker(path: str, tokenizer_path: str, max_tokens: int = 512):
    """A local cross-encoder: the sigmoid of its logit for (question, text)."""
    session, inputs = _onnx(path, tokenizer_path, max_tokens)
    return lambda pairs: 1 / (1 + np.exp(-session.run(None, inputs(pairs))[0].reshape(len(pairs), -1)[:, 0]))


@reranker("overlap")
def overlap_reranker():
    """The share of the question's words that the text has."""

    def score(pairs: list[tuple[str, str]]) -> np.ndarray:
        words = [(set(q.lower().split()), set(t.lower().split())) for q, t in pairs]
        return np.array([len(q & t) / max(1, len(q)) for q, t in words])

    return score


def with_retry(encode, tries: int = 5, pause: float = 1.0):
    """``encode``, tried again after a doubling pause; a ValueError is the caller's fault and isn't."""

    def run(texts: list[str]) -> np.ndarray:
        for k in range(tries):
            try:
                return encode(texts)
            except ValueError:
                raise
            except Exception:
                if k == tries - 1:
                    raise
                time.sleep(pause * 2**k)
        raise AssertionError

    return run


#: What services say of a text that is too long; the number of its tokens where they say it.
TOO_LONG = re.compile(r"input \((\d+) tokens\) is too large|exceeds the context length", re.I)
CONTEXT_TOKENS, SHRINKS = 8000, 4


def with_shrinking(encode: Callable[[str], Any], shrinks: int = SHRINKS) -> Callable[[list[str]], list]:
    """Embed texts one by one; a text that is too long is cut and tried again, ``shrinks`` times at most: to what its stated
    tokens allow, less a tenth, or to half. Other errors pass."""

    def one(text: str):
        for left in range(shrinks, -1, -1):
            try:
                return encode(text)
            except Exception as e:
                found = TOO_LONG.search(str(e))
                if not found or not left:
                    raise
                size = int(len(text) * CONTEXT_TOKENS / int(found[1]) * 0.9) if found[1] else len(text)
                size = size if size < len(text) else len(text) // 2
                if size < 1:
                    raise
                text = text[:size]
        raise AssertionError

    return lambda texts: [one(t) for t in texts]


class Adapter:
    """An embedder by the names that vector stores call: as a function, for questions, for documents."""

    def __init__(self, name: str = "hashed", **options):
        self.name, self.options = name, options
        self._encode = EMBEDDERS[name](**options)

    def __call__(self, input: list[str]) -> list[list[float]]:
        return np.asarray(self._encode(list(input)), np.float32).tolist()

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        return self(texts)

    def embed_query(self, text: str) -> list[float]:
        return self([text])[0]

    def supported_spaces(self) -> list[str]:
        return list(ids.DISTANCES)

    def default_space(self) -> str:
        return DEFAULTS["distance"]


def identity_of(name: str, **options) -> ids.Identity:
    """The identity of an embedder: its vector of a probe tells its dimension, whether it is of unit length, and a digest."""
    vector = np.asarray(EMBEDDERS[name](**options)(["probe"]), np.float32).reshape(-1)
    if not len(vector) or not np.isfinite(vector).all():
        raise ids.IdentityError(f"embedder {name!r} gives no vector")
    unit = bool(abs(float(np.linalg.norm(vector)) - 1) < 1e-3)
    return ids.Identity(1, "tessera", name, hashlib.sha256(vector.round(4).tobytes()).hexdigest(), len(vector), "cosine", unit)


def first_working(names: list[str]) -> tuple[str | None, str | None]:
    """The first reranker that can be made and scores a probe; or None and why each couldn't."""
    reasons = []
    for name in names:
        try:
            if np.isfinite(np.asarray(RERANKERS[name]()([("a", "a")]), float)).all():
                return name, "; ".join(reasons) or None
            reasons.append(f"{name}: no finite score")
        except Exception as e:
            reasons.append(f"{name}: {e}")
    return None, "; ".join(reasons)


_in_flight = threading.Lock()


def score_within(pairs: DataFrame, name: str, budget: float = 3.0, **options) -> tuple[DataFrame | None, str | None]:
    """(qid, id, rerank_score) of ``pairs``, worked out now; or None and why not: no such reranker, an error, more than
    ``budget`` seconds (its jobs are cancelled), or another one that is still running."""
    if name not in RERANKERS:
        return None, f"no reranker is called {name!r}"
    if not _in_flight.acquire(blocking=False):
        return None, "another reranking is running"
    sc, tag, out = pairs.sparkSession.sparkContext, f"rerank-{uuid.uuid4().hex}", {}

    def work() -> None:
        try:
            sc.addJobTag(tag)
            out["scores"] = staged(score_pairs(pairs, name, **options), "scores")
        except Exception as e:
            out["error"] = str(e).splitlines()[0][:300] if str(e) else type(e).__name__
        finally:
            _in_flight.release()

    thread = InheritableThread(target=work)
    thread.start()
    thread.join(budget)
    if thread.is_alive():
        sc.cancelJobsWithTag(tag)
        return None, f"more than {budget:g} s"
    return out.get("scores"), out.get("error")


def checked(name: str, expected: int, **options) -> None:
    """Raise unless the embedder gives finite vectors of this dimension; runs on the driver before a job starts."""
    got = np.asarray(EMBEDDERS[name](**options)(["probe"]))
    if got.shape != (1, expected) or not np.isfinite(got).all():
        raise ValueError(f"embedder {name!r} gives {got.shape}, not (1, {expected})")


def embed(df: DataFrame, name: str = "hashed", text_col: str = "document", id_col: str = "id", **options) -> DataFrame:
    """(id, embedding) of every row; a null text is embedded as empty. The model is made once for each task."""
    return embedded(df.selectExpr(f"CAST(`{id_col}` AS STRING) AS id", f"`{text_col}` AS text"), "embedding", name, "text", **options).drop("text")


def embedded(df: DataFrame, column: str, name: str = "hashed", text_col: str = "document", **options) -> DataFrame:
    """``df`` with the vectors of its texts as one more ``column``: rows stay where they are."""
    at = df.columns.index(text_col)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))  # a row may hold a long text and its words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = with_retry(EMBEDDERS[name](**options))
        for batch in batches:
            if batch.num_rows:
                vectors = np.asarray(encode([t or "" for t in batch.column(at).to_pylist()]), np.float32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors.tolist(), pa.list_(pa.float32()))], names=[*batch.schema.names, column])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(column, T.ArrayType(T.FloatType()))]))


def score_pairs(pairs: DataFrame, name: str = "overlap", budget: float | None = None, **options) -> DataFrame:
    """``pairs`` (qid, id, question, text) as (qid, id, rerank_score). Past ``budget`` seconds a task gives nulls, so a slow
    model makes no search fail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, began = RERANKERS[name](**options), time.monotonic()
        for batch in batches:
            rows = batch.to_pylist()
            out: list[float | None] = []
            for i in range(0, len(rows), 16):
                part = [(r["question"] or "", r["text"] or "") for r in rows[i : i + 16]]
                late = budget is not None and time.monotonic() - began > budget
                out += [None] * len(part) if late else [float(x) for x in score(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(out, pa.float64())], names=["qid", "id", "rerank_score"])

    return pairs.select("qid", "id", "question", "text").mapInArrow(run, "qid long, id string, rerank_score double")
