"""Quality rules by distribution divergence.

Each text has two histograms, of character classes and of common words. The histograms of all texts of a language add
up to the language's reference; a text whose Jensen-Shannon distance from it is too large is rejected, if it is long
enough for its histogram to mean anything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_add, arrow_map, staged

#: Frequent function words of each language.
COMMON = {
    "en": "the of and to a in that is was it for on with as by at be this are from or an not have".split(),
    "fr": "le la les de des du un une et en que qui dans pour pas sur est au avec il elle ne ce par".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "es": "el la los las de y que en un una del se por con para su al lo como más no es pero o".split(),
}
WORDS = sorted({w for ws in COMMON.values() for w in ws})
#: Languages with a reference of their own; texts of any other are held against the reference of all texts.
LANGUAGES = [*COMMON, ""]
#: Byte -> class: lower case, upper case, digit, white space, punctuation, other sign, control, first byte beyond ASCII.
CLASSES = 8
SYMBOLS = b"#*$%&|<>"


def _class_table() -> np.ndarray:
    t = np.zeros((256, CLASSES), np.int64)
    for b in range(256):
        c = chr(b)
        k = 7 if b >= 0xC0 else None if b >= 0x80 else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in " \t\n\r\x0b\x0c" else 4 if c in ".,;:!?'\"()-" else 5 if 32 < b < 127 else 6
        if k is not None:
            t[b, k] = 1
    return t


_TABLE = _class_table()


def _variants() -> dict[bytes, int]:
    """Each common word as it may stand in a text: capital or not, a mark behind it or not."""
    out = {}
    for k, w in enumerate(WORDS):
        for form in {w, w.capitalize()}:
            for end in ("", ".", ",", ";", ":", "!", "?"):
                out[(form + end).encode()] = k
    return out


_FORMS = _variants()


@dataclass(frozen=True)
class Rules:
    """Limits of the distances (base 2, so at most 1) and the lengths under which a histogram isn't judged."""

    char_limit: float = 0.30
    word_limit: float = 0.32
    least_chars: int = 200
    least_words: int = 150


def measure(text: str | None) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the two histograms of one text."""
    text = text or ""
    raw = text.encode()
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _TABLE
    words = raw.split()
    ids: dict[bytes, int] = {}
    seq = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    counts = [0] * (len(WORDS) + 1)
    each = np.bincount(seq, minlength=len(ids)).tolist()
    rest = len(words)
    get = _FORMS.get
    for w, n in zip(ids, each):
        if len(w) < 9 and (k := get(w)) is not None:
            counts[k] += n
            rest -= n
    counts[-1] = rest
    repeated = 0
    if len(words) >= 3:
        v = len(ids) + 1
        windows = (seq[:-2] * v + seq[1:-1]) * v + seq[2:] if v < 2_000_000 else _paired(_paired(seq[:-2], seq[1:-1]), seq[2:])
        _, inverse, times = np.unique(windows, return_inverse=True, return_counts=True)
        twice = times[inverse] > 1
        if twice.any():
            hit = np.zeros(len(words), bool)
            for k in range(3):
                hit[k : len(words) - 2 + k] |= twice
            repeated = int(hit.sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    spaces = int(hist[3])
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated, hist.tolist(), counts


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each distinct pair."""
    return np.unique(np.stack([a, b]), axis=1, return_inverse=True)[1].reshape(-1).astype(np.int64)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of counts ``p`` from the counts ``q`` of its row; 0 where either is empty."""
    ps, qs = p.sum(1, keepdims=True), q.sum(1, keepdims=True)
    p, q = p / np.maximum(ps, 1), q / np.maximum(qs, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda x: np.where(x > 0, x * np.log2(x / m), 0).sum(1)
        d = np.sqrt(np.maximum(0, (part(p) + part(q)) / 2))
    return np.where((ps[:, 0] > 0) & (qs[:, 0] > 0), d, 0.0)


#: What :func:`measured_columns` gives.
MEASURED = "lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars array<long>, words array<long>"


def measured_columns(cols: dict) -> dict:
    """lang ("" if it has no reference), the base counts and both histograms."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "words"]
    return {"lang": [x if x in COMMON else "" for x in cols["lang"]], **dict(zip(names, map(list, zip(*map(measure, cols["text"])))))}


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and :func:`measured_columns` of every row."""

    def run(cols: dict) -> dict:
        return {"doc_id": cols["doc_id"], **measured_columns(cols)}

    return arrow_map(docs.select("doc_id", "lang", "text"), run, f"doc_id long, {MEASURED}")


def base_failed(n_words, n_repeat_words):
    """The contract's base rules, for numbers or arrays."""
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def references(measured: DataFrame, rules: Rules = Rules()) -> dict[str, tuple[list[int], list[int]]]:
    """The summed histograms of each language, and of all texts under "", over every text that is long enough and doesn't
    fail the base rules.

    Each task sends one row a language, so the driver gets a number of rows that follows the tasks, already added up.
    """
    least = rules.least_words

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, n, repeated, chars, words in zip(*(c.to_pylist() for c in batch.columns)):
                if n >= least and not base_failed(n, repeated):
                    both = np.array(chars + words, np.int64)
                    for k in {lang, ""}:
                        total[k] = total[k] + both if k in total else both
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(v)), pa.array(range(len(v)), pa.int32()), pa.array(v, pa.int64())], names=["lang", "k", "n"])

    rows = measured.select("lang", "n_words", "n_repeat_words", "chars", "words").mapInArrow(add, "lang string, k int, n long").groupBy("lang", "k").agg(F.sum("n").alias("n")).collect()
    out = {}
    for lang in {r.lang for r in rows}:
        v = [r.n for r in sorted((r for r in rows if r.lang == lang), key=lambda r: r.k)]
        out[lang] = (v[:CLASSES], v[CLASSES:])
    return out


def verdicts(cols: dict, refs: dict[str, tuple[list[int], list[int]]], rules: Rules) -> dict:
    """base_failed, kept, char_js and word_js of measured texts."""
    blank = ([0] * CLASSES, [0] * (len(WORDS) + 1))
    ref = [refs.get(x, blank) for x in cols["lang"]]
    char = js_distance(np.array(cols["chars"], float), np.array([r[0] for r in ref], float))
    word = js_distance(np.array(cols["words"], float), np.array([r[1] for r in ref], float))
    n, chars = np.array(cols["n_words"]), np.array(cols["word_chars"])
    bad = base_failed(n, np.array(cols["n_repeat_words"]))
    far = ((chars >= rules.least_chars) & (char > rules.char_limit)) | ((n >= rules.least_words) & (word > rules.word_limit))
    return {"base_failed": bad.tolist(), "kept": (~bad & ~far).tolist(), "char_js": char.round(6).tolist(), "word_js": word.round(6).tolist()}


def judge(docs: DataFrame, rules: Rules = Rules(), trusted: DataFrame | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, char_js, word_js of every row of ``docs`` (doc_id, lang, text).

    The references come from ``docs`` itself, or from ``trusted`` documents where most of ``docs`` may be junk. A null
    text has no words and fails; a null or unknown language is held against all texts together. Repeated rows are judged
    each, extra columns are ignored, and an empty table gives an empty result.
    """
    measured = staged(measures(docs), "measures")
    refs = references(measured if trusted is None else measures(trusted), rules)

    def run(cols: dict) -> dict:
        return {k: cols[k] for k in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} | verdicts(cols, refs, rules)

    return arrow_map(
        measured, run,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_js double, word_js double",
    )


def keep_documents(docs: DataFrame, rules: Rules = Rules(), trusted: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns.

    The rows are written with their histograms beside them, so each text is measured once and never shuffled.
    """
    names = [part.split()[0] for part in MEASURED.split(", ")]
    schema = ", ".join("__" + part for part in MEASURED.split(", "))
    wide = staged(arrow_add(docs, ["lang", "text"], lambda cols: {"__" + k: v for k, v in measured_columns(cols).items()}, schema), "measured")
    inner = wide.select(*(F.col("__" + k).alias(k) for k in names))
    refs = references(inner if trusted is None else measures(trusted), rules)
    judged = ["lang", "n_words", "word_chars", "n_repeat_words", "chars", "words"]

    @F.pandas_udf("boolean")
    def kept(*columns: pd.Series) -> pd.Series:
        cols = {k: c.tolist() for k, c in zip(judged, columns)}
        return pd.Series(verdicts(cols, refs, rules)["kept"] if len(columns[0]) else [], dtype=bool)

    return wide.where(kept(*("__" + k for k in judged))).select(*docs.columns)
