"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector x: hashed words (weighted by the log of their count, of length 1 together), one bin of each
structure statistic and one of the stated number of characters. The machine's logit is

    b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

and the pairwise part is half the sum over factors f of (sum_i v_if x_i)^2 - sum_i (v_if x_i)^2, which takes time linear in
the features that occur. It is trained here, by AdaGrad on the logistic loss, on a bounded sample of labelled rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, settled
from .quality import CLASSES, measure


@dataclass(frozen=True)
class Setting:
    """``sample`` bounds the labelled rows that are learnt from; the others are the machine's size and the training's course."""

    sample: int = 6000
    words: int = 4096
    bins: int = 12
    factors: int = 6
    epochs: int = 12
    batch: int = 128
    rate: float = 0.08
    decay: float = 2e-4
    seed: int = 12


#: What a text's structure statistics are; all but the first and last are shares or means and don't depend on length.
STATISTICS = ["log_words", "word_length", "symbols", "repeated_lines", "repeated_words", "distinct_words", "top_word", "common_words", "line_words", *(f"class_{i}" for i in range(CLASSES)), "log_stated_chars", "stated_minus_real"]


def features(text: str | None, stated: int | None, words: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Hashed words, their weights, and the statistics of one document. A null text is an empty one; an unknown statistic is -1."""
    text = text or ""
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat, hist, common = measure(text)
    raw = text.encode()
    counts = Counter(raw.lower().split())
    buckets = np.array([zlib.crc32(w) % words for w in counts], np.int64)
    each = np.bincount(buckets, weights=np.fromiter(counts.values(), np.float64, len(counts)), minlength=words) if counts else np.zeros(words)
    at = np.flatnonzero(each)
    value = np.log1p(each[at])
    value /= max(1e-9, float(np.sqrt((value**2).sum())))
    n, chars, lines = max(1, n_words), max(1, len(text)), raw.count(b"\n") + 1
    classes = [hist[i] / chars for i in range(CLASSES)]
    top = max(counts.values(), default=0)
    stats = [
        np.log2(n_words + 1), word_chars / n, n_symbols / chars, n_dup_lines / lines, n_repeat / n, len(counts) / n, top / n, 1 - common[-1] / n, n_words / lines, *classes,
        -1.0 if stated is None or stated < 0 else np.log2(stated + 1), -1.0 if stated is None else min(2.0, abs(stated - len(text)) / chars),
    ]
    return at.astype(np.uint16), value.astype(np.float32), [float(x) for x in stats]


@dataclass
class Machine:
    """A trained machine. ``edges`` has the bins' limits for each statistic; the features are the words and then all bins."""

    setting: Setting
    edges: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def rows(self, docs: list[tuple[np.ndarray, np.ndarray, list[float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers and values of all documents, one document after another, and where each begins."""
        return _rows(docs, self.edges, self.setting)

    def logits(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0)
        part = self.v[index] * value[:, None]
        sums, squares = np.add.reduceat(part, starts), np.add.reduceat(part**2, starts)
        return self.bias + np.add.reduceat(self.w[index] * value, starts) + 0.5 * (sums**2 - squares).sum(1)

    def scores(self, docs: list[tuple[np.ndarray, np.ndarray, list[float]]]) -> np.ndarray:
        return _sigmoid(self.logits(*self.rows(docs)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _rows(docs: list, edges: np.ndarray, s: Setting) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every document has a bin of each statistic, so none is without features."""
    stats = np.array([d[2] for d in docs])
    n = edges.shape[0]
    bins = np.stack([np.searchsorted(edges[j], stats[:, j], side="left") for j in range(n)], 1)
    own = s.words + np.arange(n) * s.bins + bins
    sizes = np.array([len(d[0]) + n for d in docs])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    index, value = np.empty(sizes.sum(), np.int64), np.ones(sizes.sum())
    for k, (at, x, _) in enumerate(docs):
        a = starts[k]
        index[a : a + n], index[a + n : a + sizes[k]] = own[k], at
        value[a + n : a + sizes[k]] = x
    return index, value, starts


def train(docs: list[tuple[np.ndarray, np.ndarray, list[float]]], labels: np.ndarray, s: Setting = Setting()) -> Machine:
    """The same machine for the same rows in the same order. Without labels, or with one kind only, it says the same share for all."""
    n_stats = len(STATISTICS)
    size = s.words + n_stats * s.bins
    rng = np.random.default_rng(s.seed)
    good = float(labels.sum())
    prior = (good + 1) / (len(labels) + 2)
    bias = float(np.log(prior / (1 - prior)))
    w, v = np.zeros(size), rng.normal(0, 0.05, (size, s.factors))
    if not 0 < good < len(labels):
        return Machine(s, np.zeros((n_stats, s.bins - 1)), bias, w, np.zeros_like(v))
    stats = np.array([d[2] for d in docs])
    edges = np.quantile(stats, np.linspace(0, 1, s.bins + 1)[1:-1], axis=0).T
    machine = Machine(s, edges, bias, w, v)
    index, value, starts = machine.rows(docs)
    ends = np.append(starts[1:], len(index))
    seen_w, seen_v, seen_b = np.full(size, 1e-8), np.full((size, s.factors), 1e-8), 1e-8
    for _ in range(s.epochs):
        order = rng.permutation(len(docs))
        for first in range(0, len(order), s.batch):
            chosen = order[first : first + s.batch]
            take = np.concatenate([np.arange(starts[i], ends[i]) for i in chosen])
            i, x = index[take], value[take]
            lens = ends[chosen] - starts[chosen]
            at = np.concatenate([[0], np.cumsum(lens)[:-1]])
            part = v[i] * x[:, None]
            sums, squares = np.add.reduceat(part, at), np.add.reduceat(part**2, at)
            z = machine.bias + np.add.reduceat(w[i] * x, at) + 0.5 * (sums**2 - squares).sum(1)
            slope = (_sigmoid(z) - labels[chosen]) / len(chosen)
            each = np.repeat(slope, lens)
            used, to = np.unique(i, return_inverse=True)
            gw = np.bincount(to, weights=each * x, minlength=len(used)) + s.decay * w[used]
            inner = (each * x)[:, None] * (np.repeat(sums, lens, axis=0) - part)
            gv = np.stack([np.bincount(to, weights=inner[:, f], minlength=len(used)) for f in range(s.factors)], 1) + s.decay * v[used]
            gb = float(slope.sum())
            seen_w[used] += gw**2
            seen_v[used] += gv**2
            seen_b += gb**2
            w[used] -= s.rate * gw / np.sqrt(seen_w[used])
            v[used] -= s.rate * gv / np.sqrt(seen_v[used])
            machine.bias -= s.rate * gb / np.sqrt(seen_b)
    return machine


def held_out(doc_id):
    """Whether a row's label may not be learnt from; a null doc_id has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _stated(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")).alias("stated"))


def sample(docs: DataFrame, labels: DataFrame, s: Setting = Setting()) -> tuple[list, np.ndarray]:
    """Features and labels of at most ``s.sample`` labelled documents that aren't held out, by least hash of their ids.

    The ids are chosen among the labels first, so no more than that many rows are broadcast and no text is shuffled. An id
    with contradicting labels is left out; of several texts of one id the one of least feature bytes counts, so an id that
    many rows share gives one row like any other.
    """
    settled(docs.sparkSession)
    d = F.col("doc_id").cast("long")
    known = labels.select(d.alias("doc_id"), F.col("quality").cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(d))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("high")).where("y = high").orderBy(F.xxhash64("doc_id", F.lit(s.seed)), "doc_id").limit(s.sample)
    rows = _stated(docs).join(F.broadcast(known.select("doc_id", "y")), "doc_id").select("doc_id", "y", "text", "stated")

    def run(cols: dict) -> dict:
        found = [features(t, n, s.words) for t, n in zip(cols["text"], cols["stated"])]
        return {"doc_id": cols["doc_id"], "y": cols["y"], "found": [np.array(f[2], np.float64).tobytes() + len(f[0]).to_bytes(4, "little") + f[0].tobytes() + f[1].tobytes() for f in found]}

    each = arrow_map(rows, run, "doc_id long, y int, found binary").groupBy("doc_id", "y").agg(F.min("found").alias("found"))
    got = sorted(each.collect(), key=lambda r: r.doc_id)
    docs_, n = [], len(STATISTICS)
    for r in got:
        b, k = bytes(r.found), int.from_bytes(r.found[8 * n : 8 * n + 4], "little")
        at = 8 * n + 4
        docs_.append((np.frombuffer(b, np.uint16, k, at), np.frombuffer(b, np.float32, k, at + 2 * k), np.frombuffer(b, np.float64, n).tolist()))
    return docs_, np.array([r.y for r in got], np.float64)


def score_documents(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # as many numbers as features and factors

    def run(cols: dict) -> dict:
        m = shared.value
        got = m.scores([features(t, n, m.setting.words) for t, n in zip(cols["text"], cols["stated"])])
        got = np.round(got, 6)
        return {"doc_id": cols["doc_id"], "score": got.tolist(), "predicted": (got >= 0.7).astype(int).tolist()}

    return arrow_map(_stated(docs), run, "doc_id long, score double, predicted int").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame, s: Setting = Setting()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by a machine trained on those labelled rows that aren't held out.

    A null text is scored as an empty one, and so is a text of white space but for its length; an unknown n_chars has a bin of
    its own. A null doc_id is never held out and never learnt from. Repeated rows are scored each. Without usable labels all
    scores are the share of good labels, (good + 1) / (all + 2). language, source and doc_id are not looked at; other columns
    are ignored.
    """
    found, y = sample(docs, labels, s)
    return score_documents(docs, train(found, y, s))
