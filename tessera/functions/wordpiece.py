"""WordPiece by longest match: how many tokens a model's vocabulary makes of a text.

A text is normalised and cut into words as such models do (control signs out, accents off, lower case, every punctuation and CJK
sign a word of its own), and a word is taken apart from its front, each time by the longest piece in the vocabulary. The
vocabulary is a trie, so a word is read once for each piece, and every word that a task meets is taken apart once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

UNKNOWN, CONTINUED, LONGEST = "[UNK]", "##", 100
#: Words whose pieces a task remembers.
MEMO = 500_000
# Ranges of CJK signs that are words of their own.
CJK = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B920, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))


@cache
def _sign(c: str) -> str:
    """What one sign becomes: nothing, a space, itself in lower case without accents, or that between spaces."""
    code = ord(c)
    if c in "\t\n\r" or c.isspace() and unicodedata.category(c)[0] == "Z":
        return " "
    if code in (0, 0xFFFD) or unicodedata.category(c)[0] == "C":
        return ""
    if any(a <= code <= b for a, b in CJK):
        return f" {c} "
    out = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn").lower()
    return "".join(f" {x} " if _punctuation(x) else " " if x.isspace() else x for x in out)


def _punctuation(c: str) -> bool:
    return 33 <= ord(c) <= 47 or 58 <= ord(c) <= 64 or 91 <= ord(c) <= 96 or 123 <= ord(c) <= 126 or unicodedata.category(c)[0] == "P"


def words(text: str) -> list[str]:
    """The words of a text, normalised."""
    return "".join(map(_sign, text)).split()


class WordPiece:
    """Counts tokens with ``vocabulary``; a continued piece begins with ``##``. Pickles as its vocabulary."""

    def __init__(self, vocabulary: Iterable[str]):
        self.vocabulary = tuple(sorted(set(vocabulary)))
        self._grow()

    def _grow(self) -> None:
        self.first: dict = {}
        self.later: dict = {}
        for piece in self.vocabulary:
            node, rest = (self.later, piece[len(CONTINUED) :]) if piece.startswith(CONTINUED) and len(piece) > len(CONTINUED) else (self.first, piece)
            for c in rest:
                node = node.setdefault(c, {})
            node[""] = True
        self.memo: dict[str, int] = {}

    def __getstate__(self) -> tuple:
        return self.vocabulary

    def __setstate__(self, vocabulary: tuple) -> None:
        self.vocabulary = vocabulary
        self._grow()

    def pieces(self, word: str) -> list[str]:
        """The longest pieces one after another; the unknown one for a word that has a rest without a piece, or over 100 signs."""
        if len(word) > LONGEST:
            return [UNKNOWN]
        out, at, size = [], 0, len(word)
        while at < size:
            node, end = self.later if at else self.first, 0
            for i in range(at, size):
                node = node.get(word[i])
                if node is None:
                    break
                if "" in node:
                    end = i + 1
            if not end:
                return [UNKNOWN]
            out.append(("" if not at else CONTINUED) + word[at:end])
            at = end
        return out

    def count(self, text: str) -> int:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        n = 0
        for w in words(text):
            k = memo.get(w)
            if k is None:
                k = memo[w] = len(self.pieces(w))
            n += k
        return n


def count_tokens(docs: DataFrame, model: WordPiece, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, token_count) of every text, without special tokens; a null or empty text has none. Nothing is shuffled."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.count(t or "") for t in b.column(1).to_pylist()], pa.int64())], names=[key, "token_count"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, token_count long")
