"""The token-budget chunker, as a function, over a DataFrame and as a table function for SQL.

A text is read once: where its parts begin and how many tokens each has. Chunks follow from sums of those by bisection, so the
work of packing grows with the number of chunks, not of words.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..constants import CHUNK_OVERLAP, CHUNK_TOKENS, PREFIX_TOKENS, SPECIAL_TOKENS

BUDGET = CHUNK_TOKENS - PREFIX_TOKENS - SPECIAL_TOKENS
CHUNKS = "chunk_index int, chunk_total int, text string, token_count long"
_WORD, _SPACE = 1, 2
_CHUNK = [StructField("chunk_index", IntegerType()), StructField("chunk_total", IntegerType()), StructField("text", StringType()), StructField("token_count", LongType())]
_TYPES = [pa.int32(), pa.int32(), pa.string(), pa.int64()]


@cache
def _kinds() -> np.ndarray:
    """For each code point whether it belongs to words, is white space, or neither, as Python's patterns see it."""
    every = "".join(map(chr, range(0x110000)))
    out = np.zeros(0x110000, np.uint8)
    for pattern, kind in ((r"\w+", _WORD), (r"\s+", _SPACE)):
        for m in re.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def _parts(text: str) -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
    """Begin and end of each part, which parts begin a word, and where tokens (words, and other signs each) begin.

    Parts are what white space leaves, and a full stop before a space is a part of its own.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[codes]
    solid = kind != _SPACE
    token = solid.copy()
    token[1:] &= ~((kind[1:] == _WORD) & (kind[:-1] == _WORD))
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    stop = np.zeros(len(codes), bool)
    stop[:-1] = (codes[:-1] == ord(".")) & (codes[1:] == ord(" "))
    starts = np.flatnonzero(opens | stop)
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    closes[:-1] |= stop[1:] & solid[:-1]
    return starts.tolist(), (np.flatnonzero(closes) + 1).tolist(), opens[starts], np.flatnonzero(token)


def _sliced(part: str, budget: int, count: Callable[[str], int]) -> list[tuple[int, int]]:
    """(length, tokens) of the longest pieces within the budget, one after another."""
    out, at = [], 0
    while at < len(part):
        low, high = 1, len(part) - at
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if count(part[at : at + mid]) <= budget else (low, mid - 1)
        out.append((low, count(part[at : at + low])))
        at += low
    return out


def budget_chunks(text: str, budget: int = BUDGET, overlap: int = CHUNK_OVERLAP, count: Callable[[str], int] | None = None) -> list[tuple[str, int]]:
    """(chunk, tokens): parts packed up to a budget, each chunk opening with the words that end the one before.

    Tokens are words and other signs, or what ``count`` says of a part. A part over the budget is cut by characters; what comes
    before it is a chunk of its own, and the next part joins its last piece. Opening words may take a chunk over the budget by
    their number. The overlap must not be over the budget.
    """
    if overlap > budget:
        raise ValueError("the overlap must not be over the budget")
    text = text.strip()
    if not text:
        return []
    starts, ends, opens, tokens = _parts(text)
    m = len(starts)
    n = np.diff(np.searchsorted(tokens, [*starts, len(text)])).tolist() if count is None else [count(text[a:b]) for a, b in zip(starts, ends)]
    before = [0, *np.cumsum(n).tolist()]
    if before[m] <= budget:
        return [(text[starts[0] : ends[-1]], before[m])]
    first_words = np.flatnonzero(opens).tolist()
    out: list[tuple[str, int]] = []
    # held: what began at ``at``, of it ``carried`` tokens before part ``low``, and the parts from there to ``j``
    at, carried, low, j = starts[0], 0, 0, 0

    def opening() -> tuple[int, int, int]:
        """The words that end what is held, of ``overlap`` tokens at most: what is held next."""
        if carried + before[j] - before[low] <= overlap:
            return at, carried, low
        i = bisect_left(first_words, max(low, bisect_left(before, before[j] - overlap)))
        k = first_words[i] if i < len(first_words) and first_words[i] < j else j
        return (starts[k] if k < m else len(text)), 0, k

    while j < m:
        used = carried + before[j] - before[low]
        j = max(j, bisect_right(before, budget - used + before[j]) - 1)
        if j >= m:
            break
        used = carried + before[j] - before[low]
        if n[j] > budget:
            if at < starts[j]:
                out.append((text[at : ends[j - 1]], used))
            pos = starts[j]
            if count is None:
                a, b = np.searchsorted(tokens, [starts[j], ends[j]]).tolist()
                cuts = [*tokens[a:b:budget].tolist(), ends[j]]
                pieces = [(y - x, min(budget, b - a - budget * i)) for i, (x, y) in enumerate(zip(cuts, cuts[1:]))]
            else:
                pieces = _sliced(text[starts[j] : ends[j]], budget, count)
            for size, k in pieces[:-1]:
                out.append((text[pos : pos + size], k))
                pos += size
            at, carried, low, j = pos, pieces[-1][1], j + 1, j + 1
            continue
        out.append((text[at : ends[j - 1]], used))
        at, carried, low = opening()
        j += 1
        used = carried + before[j] - before[low]
        # too much by now, so the space behind closes it; the one behind a full stop is the stop's own
        if used > budget and j < m and ends[j - 1] + text.startswith(". ", ends[j - 1] - 1) < starts[j]:
            out.append((text[at : ends[j - 1]], used))
            at, carried, low = opening()
    out.append((text[at : ends[-1]], carried + before[m] - before[low]))
    return [(c, k) for c, k in out if c]


def chunk_by_budget(docs: DataFrame, budget: int = BUDGET, overlap: int = CHUNK_OVERLAP, count: Callable[[str], int] | None = None) -> DataFrame:
    """parent_id, chunk_index, chunk_total, text, token_count; packing depends on what came before, so this runs in Python batches.
    A null, empty or blank text has no chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for parent, text in zip(*(c.to_pylist() for c in batch.columns)):
                chunks = budget_chunks(text or "", budget, overlap, count)
                rows += [(parent, i, len(chunks), t, n) for i, (t, n) in enumerate(chunks)]
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), *_TYPES])], names=["parent_id", "chunk_index", "chunk_total", "text", "token_count"])

    return docs.select("parent_id", "text").mapInArrow(run, f"parent_id string, {CHUNKS}")


class _Chunker:
    """``chunk_text(text, budget, overlap)``, or over ``TABLE(t)`` with its columns parent_id and text."""

    @staticmethod
    def analyze(source: AnalyzeArgument, budget: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        for a in (budget, overlap):
            if a is not None and (not a.isConstantExpression or a.value is None or a.value < 0):
                raise ValueError("budget and overlap must be numbers, 0 or more")
        if budget is not None and budget.value < 1:
            raise ValueError("the budget must be 1 or more")
        if source.isTable:
            names = {f.name for f in source.dataType.fields}
            if not {"parent_id", "text"} <= names:
                raise ValueError("the table needs the columns parent_id and text")
            return AnalyzeResult(StructType([StructField("parent_id", StringType()), *_CHUNK]))
        return AnalyzeResult(StructType(_CHUNK))

    def eval(self, source, budget: int = BUDGET, overlap: int = CHUNK_OVERLAP):
        table = hasattr(source, "asDict")
        chunks = budget_chunks((source["text"] if table else source) or "", budget, overlap)
        for i, (t, n) in enumerate(chunks):
            yield (*((source["parent_id"],) if table else ()), i, len(chunks), t, n)


def register(spark: SparkSession, name: str = "chunk_text"):
    """Make the chunker callable from SQL as ``name``, beside a row (LATERAL) or over a table, partitioned or not; the function."""
    chunker = udtf(_Chunker)
    spark.udtf.register(name, chunker)
    return chunker
