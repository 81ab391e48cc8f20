"""Near-duplicates by SuperMinHash: signatures, banding, verification on full sets and union-find grouping.

A text's set holds 64-bit hashes of its distinct word shingles. Texts with one set are one node. Nodes that share a
band of their signatures are linked to the band's least node, its leader; the components of these links are families,
which hold every candidate pair. Within a family that fits a task all pairs are verified on the full sets and joined by
union-find. In a larger one each node is first verified against its leaders, and most are joined by that; what is left
are pairs between different components: nodes outside the family's largest component, its strays, are verified block by
block against each other and against that component. So work grows with nodes times strays, not with their square.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import arrow_map, discard, staged

#: Registers of a signature, and bands they are cut into: a pair of similarity 0.8 shares no band once in 2e7 times.
REGISTERS, BANDS = 128, 32
#: Nodes of a family that one task holds; of larger families, nodes of a block.
BLOCK = 1024
#: Leaders that a node of a larger family is verified against first.
LEADERS = 3
#: Nodes of small families that share a task.
SHARD_NODES = 1000
#: Bytes of text hashed at once.
CHUNK = 1 << 19
#: Sets whose signatures are made together.
TOGETHER = 128
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_MASK = (1 << 64) - 1
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word `[^\\x20\\x09-\\x0D]+` of ``data``."""
    a = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(a) + 2, np.int8)
    inside[1:-1] = ~_GAP[a]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[0::2], edges[1::2]
    up, down = _powers_to(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP)


def _word_hashes(texts: list[str]) -> Iterator[np.ndarray]:
    """Hashes of the words of each text in turn, A-Z in lower case; long texts are hashed in parts cut at white space."""
    raw = [t.encode().translate(_LOWER) for t in texts]
    i = 0
    while i < len(raw):
        if len(raw[i]) > CHUNK:
            data, at, parts = raw[i], 0, []
            while at < len(data):
                end = at + CHUNK
                while end < len(data) and not _GAP[data[end]]:
                    end += 1
                parts.append(hashed_words(data[at:end])[1])
                at = end
            yield np.concatenate(parts)
            i += 1
            continue
        j, total = i, 0
        while j < len(raw) and (j == i or total + len(raw[j]) <= CHUNK):
            total += len(raw[j]) + 1
            j += 1
        starts, hashes = hashed_words(b"\n".join(raw[i:j]))
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raw[i:j])]))
        for k in range(j - i):
            yield hashes[bounds[k] : bounds[k + 1]]
        i = j


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words than ``size`` has one, of no words none."""
    out = []
    for w in _word_hashes([t or "" for t in texts]):
        k = min(size, len(w))
        if not k:
            out.append(np.zeros(0, np.uint64))
            continue
        acc = np.zeros(len(w) - k + 1, np.uint64)
        for j in range(k):
            acc = acc * _STEP + w[j : len(w) - k + 1 + j]
        out.append(np.unique(mix(acc + np.uint64(k))))
    return out


def superminhash(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """Signatures of many sets at once (len(sets) x m, float64; empty sets have infinite registers).

    Each element draws a random permutation of the registers and offers register ``p[j]`` the value ``j + r``; level j
    of all sets is done together, and a set stops once no register holds ``j`` or more.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    h = np.full((len(sets), m), np.inf)
    doc = np.repeat(np.arange(len(sets)), sizes)
    if not len(doc):
        return h
    x = np.concatenate(sets)
    flat = h.reshape(-1)
    perm: np.ndarray | None = None
    first: np.ndarray | None = None
    for j in range(m):
        if j:
            live = (h.max(axis=1) >= j)[doc]
            if not live.any():
                break
            if not live.all():
                doc, x = doc[live], x[live]
                perm = perm[live] if perm is not None else None
                first = first[live] if first is not None else None
            if perm is None:  # the first swap is made up for once few elements are left
                perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(x), 1))
                rows = np.arange(len(x))
                perm[rows, first], perm[:, 0] = 0, first
        v = mix(x + np.uint64((j + 1) * int(_STEP) & _MASK))
        k = j + ((v >> np.uint64(44)) % np.uint64(m - j)).astype(np.int64)
        if j == 0:
            place = first = k
        else:
            rows = np.arange(len(x))
            place = perm[rows, k].astype(np.int64)
            perm[rows, k], perm[rows, j] = perm[rows, j], place
        value = (v & np.uint64((1 << 44) - 1)).astype(np.float64) * 2.0**-44 + j
        np.minimum.at(flat, doc * m + place, value)
    return h


def band_hashes(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit hash for each band of each signature."""
    bits = np.ascontiguousarray(signatures).view(np.uint64).reshape(len(signatures), bands, -1)
    acc = np.zeros(bits.shape[:2], np.uint64)
    for j in range(bits.shape[2]):
        acc = mix(acc * _STEP + bits[:, :, j])
    return mix(acc + np.arange(bands, dtype=np.uint64) * _STEP).view(np.int64)


def node_of(s: np.ndarray) -> int | None:
    """A set's 64-bit name; None for the empty set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "big", signed=True) if len(s) else None


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_key (MD5 of the text), n_shingles, node, bands of every row."""

    def run(cols: dict) -> dict:
        sets = shingle_sets(cols["text"], size)
        full = [s for s in sets if len(s)]
        bands = iter([b for i in range(0, len(full), TOGETHER) for b in band_hashes(superminhash(full[i : i + TOGETHER])).tolist()])
        return {
            "doc_id": cols["doc_id"], "text_key": [hashlib.md5((t or "").encode()).digest() for t in cols["text"]], "n_shingles": [len(s) for s in sets], "node": [node_of(s) for s in sets],
            "bands": [next(bands) if len(s) else [] for s in sets],
        }

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, text_key binary, n_shingles long, node long, bands array<long>")


class Forest:
    """Union-find in which the least member is the root."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x] = top
            x = y
        return top

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition as one star for each of its components."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
    nodes = list(forest.up)
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([forest.root(x) for x in part], pa.int64())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b: long) but the roots; a root is its component's least node.

    Union-find within partitions, then alternating large and small stars over what is left, each round written to the
    shared folder (and removed once the next one is), until a round changes nothing. No task holds more than its partition
    of links, and those of a hub are split.
    """

    def stars(edges: DataFrame) -> DataFrame:
        return edges.where("a <> b").mapInArrow(_local_forest, "a long, b long")

    def seal(edges: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        edges = staged(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")), "links")
        return edges, tuple(sorted(seen.get.items()))

    cur, state = seal(stars(links.select("a", "b")))
    while True:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")  # so that the join can split a hub's links
        large = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt, new_state = seal(small.unionByName(small_least.select("a", F.col("m").alias("b"))).distinct())
        discard(cur)
        discard(least)
        if new_state == state:
            return nxt.toDF("node", "root")
        cur, state = nxt, new_state


def linked_pairs(names: list[int], sets: list[np.ndarray], left: int | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets; with ``left``, only of links from the first ``left`` sets to the others."""
    forest, out = Forest(), []
    sizes = np.array([len(s) for s in sets], np.float64)
    n = len(sets)
    if n <= 6:
        pairs = ((i, j) for i in range(n) for j in range(i + 1, n) if left is None or i < left <= j)
        return [(names[i], names[j]) for i, j in pairs if similar(sets[i], sets[j], percent) and forest.join(names[i], names[j])]
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes.astype(np.int64))
    shared = counts > 1
    column = (np.cumsum(shared) - 1)[inverse]
    keep = shared[inverse]
    row, column = row[keep], column[keep]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    a = np.arange(n if left is None else left)
    b = np.arange(n) if left is None else np.arange(left, n)
    both = np.zeros((len(a), len(b)), np.float32)
    step = 4096
    for c in range(0, int(shared.sum()), step):
        lo, hi = np.searchsorted(column, [c, c + step])
        x = np.zeros((n, step), np.float32)
        x[row[lo:hi], column[lo:hi] - c] = 1
        both += x[a] @ x[b].T
    for i in range(len(a)):
        for j in np.flatnonzero(100 * both[i].astype(np.float64) >= percent * (sizes[a[i]] + sizes[b] - both[i])):
            if a[i] != b[j] and forest.join(names[a[i]], names[b[j]]):
                out.append((names[a[i]], names[b[j]]))
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, big = sorted((len(a), len(b)))
    if 100 * small < percent * big:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (small + big - both)


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``wanted`` (node, rep_id and more) with each node's full set as bytes, read from the text of its representative."""
    columns = [f for f in wanted.schema.fields if f.name != "rep_id"]
    # sorted on both sides at every size: what is wanted grows with the input, so it is never sent to every task
    texts = docs.select("doc_id", "text").join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("text", *(f.name for f in columns))

    def run(cols: dict) -> dict:
        sets = shingle_sets(cols["text"], size)
        keep = [i for i, s in enumerate(sets) if node_of(s) == cols["node"][i]]
        return {f.name: [cols[f.name][i] for i in keep] for f in columns} | {"shingles": [sets[i].tobytes() for i in keep]}

    return arrow_map(texts, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns) + ", shingles binary")


def links_in_blocks(dealt: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the links in each group of ``dealt`` (task columns family, kind, i, j; node, root, side,
    shingles). In a group of kind "s" links run between all nodes of a root, in any other from side 0 to side 1."""

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        group = group.drop_duplicates("node")
        for _, g in group.groupby("root", sort=False):
            g = g.sort_values(["side", "node"])
            sets = [np.frombuffer(s, np.uint64) for s in g["shingles"]]
            found += linked_pairs(g["node"].tolist(), sets, None if g["kind"].iat[0] == "s" else int((g["side"] == 0).sum()), percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("family", "kind", "i", "j").applyInPandas(verify, "a long, b long")


def links_of_small(full: DataFrame, percent: int) -> DataFrame:
    """All links of families (root) that fit a task; many such families share one."""
    n_shards = max(1, -(-full.count() // SHARD_NODES))
    shard = F.pmod(F.xxhash64("root"), F.lit(n_shards)).cast("int").alias("i")
    return links_in_blocks(full.select(F.lit(0).cast("long").alias("family"), F.lit("s").alias("kind"), shard, F.lit(0).alias("j"), "node", "root", F.lit(0).alias("side"), "shingles"), percent)


def links_of_large(full: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """Links that hold the components of large families together: those with leaders, and those of strays.

    A node is verified against the ``LEADERS`` leaders with which it shares most bands. What its least verified leader and
    that one's least verified leader lead is a part; parts decide only how many strays are left, not what is found, since
    all pairs of the largest part with other nodes, and of these, are verified after it.
    """
    sets = lambda end: full.select(F.col("node").alias(end), F.col("shingles").alias(f"set_{end}")).dropDuplicates([end])

    def check(cols: dict) -> dict:
        keep = [i for i, (x, y) in enumerate(zip(cols["set_a"], cols["set_b"])) if similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)]
        return {k: [cols[k][i] for i in keep] for k in ("a", "b")}

    order = Window.partitionBy("a").orderBy(F.col("shared").desc(), "b")
    nearest = candidates.withColumn("k", F.row_number().over(order)).where(F.col("k") <= LEADERS).select("a", "b")
    pairs = nearest.join(sets("a").hint("merge"), "a").join(sets("b").hint("merge"), "b")
    led = staged(arrow_map(pairs.select("a", "b", "set_a", "set_b"), check, "a long, b long"), "led")
    up = led.groupBy("a").agg(F.min("b").alias("b"))
    above = up.select(F.col("a").alias("b"), F.col("b").alias("c"))
    nodes = full.select("node", "root").distinct()
    parts = nodes.join(up.join(above, "b", "left").select(F.col("a").alias("node"), F.coalesce("c", "b").alias("part")), "node", "left")
    parts = staged(parts.select("node", "root", F.coalesce("part", "node").alias("part")), "parts")
    sizes = parts.groupBy("root", "part").agg(F.count("*").alias("n"))
    core = sizes.groupBy("root").agg(F.max(F.struct("n", "part")).alias("most"), F.sum("n").alias("n")).where("n > most.n")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    core = staged(core.select("root", F.col("most.part").alias("core"), blocks(F.col("most.n")).alias("n_core"), blocks(F.col("n") - F.col("most.n")).alias("n_stray")), "core")
    left = full.select("node", "shingles").dropDuplicates(["node"]).join(parts.hint("merge"), "node").join(core, "root").withColumn("stray", F.col("part") != F.col("core"))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def dealt(rows: DataFrame, kind, own_blocks: str, other_blocks: str, i, j, side) -> DataFrame:
        rows = rows.withColumn("own", own(own_blocks)).withColumn("other", each(other_blocks))
        return rows.select(F.col("root").alias("family"), kind.alias("kind"), i.alias("i"), j.alias("j"), "node", "root", side.cast("int").alias("side"), "shingles")

    mine, other = F.col("own"), F.col("other")
    strays, rest = left.where("stray"), left.where("NOT stray")
    pair = F.when(mine == other, F.lit("s")).otherwise(F.lit("strays"))
    within = dealt(strays, pair, "n_stray", "n_stray", F.least(mine, other), F.greatest(mine, other), mine > other)
    core_pair = F.lit("core")
    across = dealt(strays, core_pair, "n_stray", "n_core", other, mine, F.lit(1)).unionByName(dealt(rest, core_pair, "n_core", "n_stray", mine, other, F.lit(0)))
    return led.unionByName(links_in_blocks(within.unionByName(across), percent))


def verified_links(docs: DataFrame, sig: DataFrame, families: DataFrame, candidates: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): links that hold the nodes of each component together, found on full sets; ``families``: (node, root)."""
    member = families.unionByName(families.select(F.col("root").alias("node"), "root").distinct())
    counted = member.groupBy("root").agg(F.count("*").alias("n")).where("n > 1")
    reps = sig.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep_id"))
    wanted = staged(member.join(counted, "root").join(reps, "node").select("node", "root", "rep_id", "n"), "wanted")
    full = staged(full_sets(docs, wanted, size), "sets")
    found = links_of_small(full.where(F.col("n") <= BLOCK), percent)
    large = full.where(F.col("n") > BLOCK)
    if large.limit(1).count():
        of_large = candidates.join(wanted.where(F.col("n") > BLOCK).select(F.col("node").alias("a")), "a", "left_semi")
        found = found.unionByName(links_of_large(large, of_large, percent))
    return found


def rooted(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows; and of the rows with words doc_id, text_key, n_shingles and root, their component's name."""
    sig = staged(signatures(docs, size), "signatures")
    nodes = sig.where("node is not null").groupBy("node").agg(F.first("bands").alias("bands"))
    places = nodes.select("node", F.explode("bands").alias("bucket"))
    leaders = places.groupBy("bucket").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").select("bucket", "b")
    candidates = places.join(leaders, "bucket").where("node <> b").groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("shared"))
    candidates = staged(candidates, "candidates")
    families = components(candidates)
    roots = components(verified_links(docs, sig, families, candidates, size, percent))
    return sig, sig.where("node is not null").join(roots, "node", "left").select("doc_id", "text_key", "n_shingles", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text).

    Null texts and texts without words have no shingles, are linked with nothing and are kept. Rows with equal texts
    are one component; a repeated doc_id gives a row each time. A component's id is its least doc_id (null only where
    all are null). Extra columns are ignored; an empty table gives an empty result.
    """
    sig, labelled = rooted(docs, size, percent)
    # a written table, so that the join deals out both sides anew and a component of very many rows is split
    ids = staged(labelled.groupBy("root").agg(F.min("doc_id").alias("component_id")), "ids")
    out = labelled.join(ids, "root").select("doc_id", "n_shingles", "component_id")
    bare = sig.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(bare).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, the one of least doc_id; rows without words all stay.

    Columns of ``docs`` stay as they are. A row that is repeated whole stays once.
    """
    sig, labelled = rooted(docs, size, percent)
    least = labelled.groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("row")).select("row.*")
    bare = sig.where("node is null").select("doc_id", "text_key").distinct()
    keep = least.unionByName(bare).toDF("keep_id", "keep_key")
    key = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    kept = docs.join(keep.hint("merge"), F.col("doc_id").eqNullSafe(F.col("keep_id")) & (key == F.col("keep_key")), "left_semi")
    again = labelled.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if again else kept
