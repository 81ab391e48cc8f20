"""Removal of repeated byte strings by suffix arrays.

Two equal strings of ``length`` bytes choose the same anchor in themselves: the ``ANCHOR``-byte string whose hash is
least. Neighbouring windows with one anchor make a piece, so equal windows lie in pieces with equal anchors, and only
those need to meet. A piece that occurs twice is repeated as a whole; pieces are told apart by a 128-bit BLAKE2b digest
of their bytes. The distinct pieces left beside others with their anchor go, with their bytes, into shards; a shard's
suffix array (induced sorting) and permuted common prefixes say which windows occur twice.

A shard must fit one task. Where a passage that very many texts share leaves more distinct pieces with one anchor than
that, the work is split: the pieces are cut into narrower ones, down to single windows, and the same rule (what occurs
twice by its digest is repeated) holds for those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, settled, staged
from .neardup import mix
from .suffix import permuted_lcp, suffix_array

#: Bytes of an anchor.
ANCHOR = 40
#: Bytes of text hashed at once, and of pieces in a shard. Places within a chunk must fit 21 bits.
CHUNK, SHARD = 1 << 19, 1 << 20
#: Distinct pieces of one anchor that a shard may hold; the work of an anchor with more is split.
MOST_PIECES = 2000
#: Neighbouring windows that are looked at together where an anchor has more.
STRIDE = 16
_PLACE = np.uint64((1 << 21) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def digest(data: bytes) -> bytes:
    """What tells strings apart."""
    return hashlib.blake2b(data, digest_size=16).digest()


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


class Rolling:
    """64-bit hashes of any substrings of ``data``."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers_to(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of ``data[start:end]``, all of equal or of different lengths."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + np.asarray(end - start).astype(np.uint64))


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours of ``x``."""
    n = len(x) - w + 1
    rows = -(-len(x) // w)
    grid = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(x)] = x
    grid = grid.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def pieces_of(raws: list[bytes], length: int, chunk: int = CHUNK) -> Iterator[tuple[int, np.ndarray]]:
    """Of each text with windows: its index, and rows (start, size, anchor's place in the piece, anchor hash) as int64."""
    todo: list[tuple[int, int, bytes]] = []
    for k, raw in enumerate(raws):
        for at in range(0, max(0, len(raw) - length + 1), chunk):  # parts overlap by all but one byte of a window
            todo.append((k, at, raw[at : at + chunk + length - 1]))
    i = 0
    while i < len(todo):
        j, total = i, 0
        while j < len(todo) and (j == i or total + len(todo[j][2]) <= chunk):
            total += len(todo[j][2])
            j += 1
        group = todo[i:j]
        i = j
        data = np.frombuffer(b"".join(g[2] for g in group), np.uint8)
        roll = Rolling(data)
        at = np.arange(len(data) - ANCHOR + 1)
        anchors = roll.of(at, at + ANCHOR)
        least = sliding_least((anchors & ~_PLACE) | at.astype(np.uint64), length - ANCHOR + 1)
        chosen = (least & _PLACE).astype(np.int64)
        begin = np.cumsum([0, *(len(g[2]) for g in group)])
        for (k, shift, part), lo in zip(group, begin):
            c = chosen[lo : lo + len(part) - length + 1]
            first = np.flatnonzero(np.diff(c, prepend=-1))
            last = np.append(first[1:], len(c)) - 1
            a, b = lo + first, lo + last + length
            yield k, np.stack([first + shift, b - a, c[first] - a, anchors[c[first]].view(np.int64)], 1)


def find_pieces(docs: DataFrame, length: int, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text key, start, size, place, anchor, piece of every piece of ``docs`` (doc_id, text)."""
    settled(docs.sparkSession)
    names = ["doc_id", "text_key", "start", "size", "place", "anchor", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [(t or "").encode() for t in batch.column(1).to_pylist()]
            which, rows, digests = [], [], []
            for k, r in pieces_of(raws, length, chunk):
                which.append(np.full(len(r), k))
                rows.append(r)
                digests += [digest(raws[k][a : a + n]) for a, n in r[:, :2].tolist()]
            if not rows:
                continue
            at, r = np.concatenate(which), np.concatenate(rows)
            keys = pa.array([hashlib.md5(x).digest() for x in raws], pa.binary())
            columns = [batch.column(0).cast(pa.int64()).take(pa.array(at)), keys.take(pa.array(at))]
            columns += [pa.array(r[:, c].astype(np.int32)) for c in range(3)] + [pa.array(r[:, 3]), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text_key binary, start int, size int, place int, anchor long, piece binary")


def runs_of(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Windows by their sorted starts, merged to runs (start, end)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    first, last = np.append(starts[0], starts[cut + 1]), np.append(starts[cut], starts[-1])
    return list(zip(first.tolist(), (last + length).tolist()))


def repeated_runs(contents: list[bytes], wanted: list[bool], length: int) -> list[list[tuple[int, int]]]:
    """For each wanted piece, the runs of its windows that occur twice in ``contents``, by the suffix array of all of them."""
    sizes = np.array([len(c) for c in contents])
    data = np.frombuffer(b"".join(c + b"\xff" for c in contents), np.uint8)  # UTF-8 never holds this byte
    begin = np.cumsum(np.append(0, sizes + 1))[:-1]
    sa = suffix_array(data)
    lcp = permuted_lcp(data, sa)
    both = lcp.copy()
    both[sa[:-1]] = np.maximum(both[sa[:-1]], lcp[sa[1:]])
    left = np.repeat(begin + sizes, sizes + 1) - np.arange(len(data))
    hits = np.flatnonzero((both >= length) & (left >= length))
    bounds = np.searchsorted(hits, np.append(begin, len(data)))
    return [runs_of(hits[bounds[k] : bounds[k + 1]] - begin[k], length) if w else [] for k, w in enumerate(wanted)]


def hot_runs(pieces: DataFrame, length: int) -> DataFrame:
    """text_key, start, size of repeated runs of pieces (anchor, piece, n, text_key, start, place, content) with hot anchors.

    Equal windows have their anchor in the same place, so a window's distance to it splits the work further. A block of
    up to 16 neighbouring windows is looked at as what all its windows share; only where two pieces share that are its
    windows counted one by one. Every window of a block holds the bytes that the block's windows share, so a piece with
    any of them has those bytes. Counting combines before it shuffles, and the joins are of written tables, so that a
    window of very many texts is no hot task.
    """

    def block_rows(cols: dict) -> dict:
        out: dict[str, list] = {"anchor": [], "block": [], "core": [], "piece": []}
        for a, p, place, c in zip(cols["anchor"], cols["piece"], cols["place"], cols["content"]):
            far = np.unique(np.arange(place - (len(c) - length), place + 1) // STRIDE)
            start = place - far * STRIDE
            out["anchor"] += [a] * len(far)
            out["block"] += far.tolist()
            out["core"] += [digest(c[max(0, b) : b - STRIDE + 1 + length]) for b in start.tolist()]
            out["piece"] += [p] * len(far)
        return out

    cores = arrow_map(pieces.select("anchor", "piece", "place", "content"), block_rows, "anchor long, block int, core binary, piece binary")
    cores = staged(cores, "cores")
    shared = staged(cores.groupBy("anchor", "block", "core").agg(F.count("*").alias("k")).where("k > 1").select("anchor", "block", "core"), "shared")
    look = cores.join(shared, ["anchor", "block", "core"], "left_semi")
    blocks = look.groupBy("anchor", "piece").agg(F.collect_set("block").alias("blocks"))

    def window_rows(cols: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("anchor", "window", "far", "n", "text_key", "at")}
        for a, n, key, begin, place, c, bs in zip(*(cols[k] for k in ("anchor", "n", "text_key", "start", "place", "content", "blocks"))):
            starts = np.arange(len(c) - length + 1)
            starts = starts[np.isin((place - starts) // STRIDE, bs)]
            out["anchor"] += [a] * len(starts)
            out["window"] += [digest(c[x : x + length]) for x in starts.tolist()]
            out["far"] += (place - starts).tolist()
            out["n"] += [n] * len(starts)
            out["text_key"] += [key] * len(starts)
            out["at"] += (starts + begin).tolist()
        return out

    rows = arrow_map(
        pieces.join(blocks, ["anchor", "piece"]).select("anchor", "n", "text_key", "start", "place", "content", "blocks"), window_rows,
        "anchor long, window binary, far int, n long, text_key binary, at int",
    )
    rows = staged(rows, "windows")
    twice = staged(rows.groupBy("anchor", "far", "window").agg(F.sum("n").alias("total")).where("total > 1").select("anchor", "far", "window"), "twice")
    return rows.where("n = 1").join(twice, ["anchor", "far", "window"], "left_semi").select("text_key", F.col("at").alias("start"), F.lit(length).alias("size"))


def repeated_spans(docs: DataFrame, length: int = 400, chunk: int = CHUNK) -> DataFrame:
    """text_key (MD5 of the UTF-8 text), start, size: spans that cover every byte of each repeated window."""
    pieces = staged(find_pieces(docs, length, chunk), "pieces")
    # written tables, so that joins with them deal out both sides anew and an anchor of very many pieces is split
    anchors = staged(pieces.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor"), "anchors")
    met = staged(pieces.join(anchors, "anchor"), "met")
    strings = staged(met.groupBy("anchor", "piece").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "start", "size", "place")).alias("at")), "strings")
    whole = met.join(strings.where("n > 1").select("anchor", "piece"), ["anchor", "piece"]).select("text_key", "start", "size")
    crowd = staged(strings.groupBy("anchor").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 AND least = 1").select("anchor", (F.col("k") > MOST_PIECES).alias("hot")), "crowd")
    want = strings.join(crowd, "anchor").select("anchor", "piece", "n", "hot", "at.*")
    fetch = want.groupBy(F.col("doc_id").alias("want_id"), F.col("text_key").alias("want_key")).agg(F.collect_list(F.struct("anchor", "piece", "n", "hot", "start", "size", "place")).alias("parts"))
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("text_key"))
    found = keyed.join(fetch, (F.col("text_key") == F.col("want_key")) & F.col("doc_id").eqNullSafe(F.col("want_id"))).select("text_key", "text", "parts")
    names = ["anchor", "piece", "n", "hot", "start", "place"]

    def cut(cols: dict) -> dict:
        out: dict[str, list] = {k: [] for k in (*names, "text_key", "content")}
        for key, text, parts in zip(cols["text_key"], cols["text"], cols["parts"]):
            raw = text.encode()
            for p in parts:
                for k in names:
                    out[k].append(p[k])
                out["text_key"].append(key)
                out["content"].append(raw[p["start"] : p["start"] + p["size"]])
        return out

    held = staged(arrow_map(found, cut, "anchor long, piece binary, n long, hot boolean, start int, place int, text_key binary, content binary"), "contents")
    n_hot, n_bytes = held.agg(F.count_if("hot"), F.coalesce(F.sum(F.when(~F.col("hot"), F.octet_length("content"))), F.lit(0))).first()
    n_shards = max(1, -(-int(n_bytes) // SHARD))

    def sort_shard(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["anchor", "piece"])
        out = []
        for key, start, runs in zip(group["text_key"], group["start"], repeated_runs(list(group["content"]), (group["n"] == 1).tolist(), length)):
            out += [(key, start + a, b - a) for a, b in runs]
        return pd.DataFrame(out, columns=["text_key", "start", "size"]).astype({"start": "int32", "size": "int32"})

    shard = F.pmod(F.xxhash64("anchor"), F.lit(n_shards)).alias("shard")
    partly = held.where("NOT hot").select(shard, "anchor", "piece", "n", "start", "text_key", "content").groupBy("shard").applyInPandas(sort_shard, "text_key binary, start int, size int")
    spans = whole.unionByName(partly)
    if n_hot:
        hot = held.where("hot").dropDuplicates(["anchor", "piece"])
        spans = spans.unionByName(hot_runs(staged(hot, "hot"), length))
    return spans.distinct()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, size) spans as maximal runs (start, end)."""
    out: list[list[int]] = []
    for a, size in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + size)
        else:
            out.append([a, a + size])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = 400, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeats of every row of ``docs`` (doc_id, text).

    Removed is each byte of a string of ``length`` bytes that also starts elsewhere in the table, in the same text or
    another; repeated rows are texts of their own, so both lose what they share. Null and empty texts, and texts
    shorter than ``length``, lose nothing. ``repeats`` says that a row loses something. Extra columns are ignored; an
    empty table gives an empty result.
    """
    spans = repeated_spans(docs, length, chunk).groupBy(F.col("text_key").alias("span_key")).agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    spans = staged(spans, "spans")  # a written table, so that the join deals out both sides anew and a text of very many rows is split
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("text_key"))

    def cut(cols: dict) -> dict:
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "repeats": []}
        for text, found in zip(cols["text"], cols["spans"]):
            raw = text.encode()
            runs = merged([(s["start"], s["size"]) for s in found or []])
            kept, at = hashlib.sha256(), 0
            for a, b in runs:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(sum(b - a for a, b in runs))
            out["n_spans"].append(len(runs))
            out["kept_sha256"].append(kept.hexdigest())
            out["repeats"].append(bool(runs))
        return {"doc_id": cols["doc_id"], **out}

    both = keyed.join(spans, F.col("text_key") == F.col("span_key"), "left").select("doc_id", "text", "spans")
    return arrow_map(both, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeats boolean")
