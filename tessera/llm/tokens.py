"""Token counts of a byte-level BPE by the whole-token shortcut.

Offline, every vocabulary string is run through the merges: those that come back as one token are proven. A text is
then cut into pre-tokens; proven ones count as one token without merging, and only the others are merged (and their
counts remembered, up to a bound).
"""

from __future__ import annotations

import hashlib
import json

import regex
from pyspark.sql import DataFrame

from .common import arrow_map

#: Remembered counts of pre-tokens that aren't proven; beyond this many they are forgotten and counted anew.
MEMO = 400_000
#: Fixed by the tokenizer: how byte-level BPE cuts texts before merging. White space is spelled out as Unicode's.
PRETOKEN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class ShortcutCounter:
    """Counts tokens of whole texts; ``spec`` is the JSON of a byte-level BPE of the tokenizers library."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        self._merge = Tokenizer.from_str(spec).model.tokenize
        self._alphabet = byte_alphabet()
        self._find = regex.compile(PRETOKEN).findall
        special = sorted((t["content"] for t in parsed["added_tokens"]), key=len, reverse=True)
        self._special = regex.compile("(?:" + "|".join(map(regex.escape, special)) + ")") if special else None
        proven = self.prove(parsed["model"]["vocab"])

        class Memo(dict):
            def __missing__(memo, piece: str) -> int:
                if len(memo) > len(proven) + MEMO:
                    memo.clear()
                    memo.update(proven)
                n = len(self._merge("".join(map(self._alphabet.__getitem__, piece.encode()))))
                if len(piece) < 200:
                    memo[piece] = n
                return n

        self.proven = proven
        self._memo = Memo(proven)

    def prove(self, vocab: dict[str, int]) -> dict[str, int]:
        """Vocabulary strings, as text, that the merges turn into exactly their own token."""
        of = {c: b for b, c in enumerate(self._alphabet)}
        found = {}
        for mapped, token in vocab.items():
            if any(c not in of for c in mapped):
                continue
            try:
                text = bytes(of[c] for c in mapped).decode()
            except UnicodeDecodeError:
                continue
            got = self._merge(mapped)
            if len(got) == 1 and got[0].id == token:
                found[text] = 1
        return found

    def count(self, text: str) -> tuple[int, int]:
        """Tokens of ``text``, and how many of them are proven whole; a special string inside it is one token, as is the
        library's default."""
        parts = self._special.split(text) if self._special else [text]
        n, whole = len(parts) - 1, 0
        for p in parts:
            pieces = self._find(p)
            n += sum(map(self._memo.__getitem__, pieces))
            whole += sum(map(self.proven.__contains__, pieces))
        return n, whole


_counters: dict[str, ShortcutCounter] = {}


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_shortcut (tokens counted without merging) of every row.

    Null texts count as empty (no bytes, no tokens). Repeated rows are counted each; extra columns are ignored. The
    tokenizer's file is read on the driver and sent along (a vocabulary, so bounded).
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        raw = f.read()
    spec, key = docs.sparkSession.sparkContext.broadcast(raw), hashlib.sha256(raw.encode()).hexdigest()

    def run(cols: dict) -> dict:
        if key not in _counters:
            _counters.clear()
            _counters[key] = ShortcutCounter(spec.value)
        counter = _counters[key]
        texts = [t or "" for t in cols["text"]]
        n, whole = zip(*map(counter.count, texts))
        return {"doc_id": cols["doc_id"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n], "n_shortcut": whole}

    return arrow_map(docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_shortcut long")
