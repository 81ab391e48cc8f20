"""Offset-preserving SentencePiece encoding and decoding.

The model's own normaliser is carried out here: at each byte the longest prefix that the compiled character map holds is
replaced, and every normalised byte records the original byte it came from. The library merges the normalised text, and
every piece is projected on the original bytes.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
from pyspark.sql import DataFrame

from .common import arrow_map

SPACE = "▁"


class CharMap:
    """The compiled character map: a double-array trie over byte strings, and the texts that replace them."""

    def __init__(self, blob: bytes):
        self.empty = len(blob) < 4
        if not self.empty:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that ``data`` holds at ``at``, and what replaces it."""
        units, node, found = self.units, 0, None
        node ^= self._offset(units[0])
        for i in range(at, len(data)):
            c = data[i]
            if c == 0:
                break
            node ^= c
            unit = units[node]
            if unit & ((1 << 31) | 255) != c:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                start = units[node] & ((1 << 31) - 1)
                found = (i + 1 - at, self.texts[start : self.texts.index(0, start)])
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)


class PieceCodec:
    """Encodes and decodes as the library does, with byte spans; ``model`` is the serialised model."""

    def __init__(self, model: bytes):
        import sentencepiece as sp
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        self.sp = sp.SentencePieceProcessor(model_proto=model)
        self.eos, self.unknown = self.sp.eos_id(), self.sp.unk_id()
        spec = proto.normalizer_spec
        self.map = CharMap(spec.precompiled_charsmap)
        self.spec = spec
        self._bytes = np.array([1 if self.sp.is_byte(i) else len(self.sp.id_to_piece(i).encode()) for i in range(self.sp.get_piece_size())], np.int64)
        self.digits = [str(i) for i in range(self.sp.get_piece_size())]

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes, and its end, the byte of ``text`` that it stands for."""
        raw = text.encode()
        if not raw:
            return "", np.zeros(1, np.int64)
        if self.map.empty and self.spec.escape_whitespaces and not self.spec.remove_extra_whitespaces:
            width = np.ones(len(raw) + 1, np.int8)
            width[:-1][np.frombuffer(raw, np.uint8) == 32] = 3
            width[0] += 3 * self.spec.add_dummy_prefix
            places = np.repeat(np.arange(len(raw) + 1, dtype=np.int32), width)
            return (SPACE if self.spec.add_dummy_prefix else "") + text.replace(" ", SPACE), places
        parts, places, at = [], [], 0
        while at < len(raw):
            hit = None if self.map.empty else self.map.longest(raw, at)
            if hit is None:
                c = raw[at]
                hit = (n := 1 if c < 128 else 2 if c < 224 else 3 if c < 240 else 4, raw[at : at + n])
            new = hit[1]
            parts.append(new)
            places += [at] * len(new)
            at += hit[0]
        flat = b"".join(parts)
        return self._spaced(flat, places, len(raw))

    def _spaced(self, flat: bytes, places: list[int], end: int) -> tuple[str, np.ndarray]:
        if self.spec.remove_extra_whitespaces:
            keep = [i for i in range(len(flat)) if flat[i] != 32 or (i and flat[i - 1] != 32)]
            while keep and flat[keep[-1]] == 32:
                keep.pop()
            flat, places = bytes(flat[i] for i in keep), [places[i] for i in keep]
        if not flat:
            return "", np.array([end])
        mark = SPACE.encode() if self.spec.escape_whitespaces else b" "
        out, at = [], []
        if self.spec.add_dummy_prefix:
            out.append(mark)
            at += [places[0]] * len(mark)
        for c, p in zip(flat, places):
            b = mark if c == 32 else bytes([c])
            out.append(b)
            at += [p] * len(b)
        return b"".join(out).decode(), np.array([*at, end])

    def encode_batch(self, texts: list[str]) -> list[tuple[list[int], np.ndarray]]:
        """For each text its ids (with the end id) and each piece's (start, end) in the original bytes.

        The merges run in the library over the normalised texts; a space sign stands for itself there, so its own
        normaliser adds no more than the prefix that is left off here.
        """
        flat = [self.normalise(t) for t in texts]
        skip = 1 if self.spec.add_dummy_prefix else 0
        out = []
        for ids, (flat_text, places) in zip(self.sp.encode([f[skip:] for f, _ in flat], num_threads=1), flat):
            sizes = self._bytes[np.array(ids, np.int32)]
            if self.unknown in ids:  # such a piece is as long as what it stands for
                sizes = np.array([len(p.surface.encode()) for p in self.sp.encode(flat_text[skip:], return_type="proto").pieces])
                sizes[0] += len(flat_text.encode()) - int(sizes.sum())
            ends = np.cumsum(sizes, dtype=np.int32)
            spans = np.empty((len(ids), 2), np.int32)
            if ids:
                spans[:, 1] = places[ends]
                spans[0, 0], spans[1:, 0] = places[0], spans[:-1, 1]
            ids.append(self.eos)
            out.append((ids, spans))
        return out

    def encode(self, text: str) -> tuple[list[int], np.ndarray]:
        return self.encode_batch([text])[0]

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


_codecs: dict[str, PieceCodec] = {}


def codec_of(model, key: str) -> PieceCodec:
    """One codec a worker; ``model`` is a broadcast of the serialised model, ``key`` a digest of it."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = PieceCodec(model.value)
    return _codecs[key]


def encode_documents(docs: DataFrame, model_path: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_whole, spans_sha256 of every row, and the ids if asked for.

    spans_whole says that the pieces' byte spans follow each other from the text's first byte to its last, spans_sha256
    digests them (start and end of each piece as little-endian 32-bit numbers). Null and empty texts encode to the end id alone; repeated rows are encoded each; extra columns are ignored.
    """
    with open(model_path, "rb") as f:
        raw = f.read()
    model, key = docs.sparkSession.sparkContext.broadcast(raw), hashlib.sha256(raw).hexdigest()

    def run(cols: dict) -> dict:
        codec = codec_of(model, key)
        n, ids_sha, decoded_sha, whole, spans_sha, all_ids = [], [], [], [], [], []
        texts = [t or "" for t in cols["text"]]
        for text, (ids, spans) in zip(texts, codec.encode_batch(texts)):
            n.append(len(ids))
            if with_ids:
                all_ids.append(ids)
            ids_sha.append(hashlib.sha256(" ".join(map(codec.digits.__getitem__, ids)).encode()).hexdigest())
            decoded_sha.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            spans_sha.append(hashlib.sha256(spans.astype("<i4").tobytes()).hexdigest())
            ends = len(text.encode())
            whole.append(bool((spans[0, 0] == 0 and spans[-1, 1] == ends and (spans[1:, 0] <= spans[:-1, 1]).all()) if len(spans) else ends == 0))
        return {"doc_id": cols["doc_id"], "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": decoded_sha, "spans_whole": whole, "spans_sha256": spans_sha, "ids": all_ids}

    return arrow_map(docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_whole boolean, spans_sha256 string" + ", ids array<int>" * with_ids)
