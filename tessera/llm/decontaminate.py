"""Benchmark decontamination: one Aho-Corasick automaton over the windows of normalised test items.

A text is normalised byte by byte (A-Z to lower case, every other byte that ends words to a space), so an offset in the
normalised words maps back to the original. It is scanned once; overlapping hits merge into hit words.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_filter, arrow_map, staged, table

#: Bytes of test items in one automaton (it takes some 60 times as much memory); more items go in blocks, a scan each.
AUTOMATON_BYTES = 4 << 20
WINDOW = 13
#: Fixed by the contract: words are of 0-9, a-z and anything beyond ASCII.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> set[bytes]:
    """Each window as its words joined by a space; fewer words than ``size``, but not none, are one window."""
    if not words:
        return set()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


class Automaton:
    """Finds windows of ``items`` (pairs of id and text) in texts."""

    def __init__(self, items: list[tuple], size: int = WINDOW):
        import ahocorasick

        owners: dict[bytes, set] = {}
        for item, text in items:
            for w in windows_of(words_of(text), size):
                owners.setdefault(w, set()).add(item)
        self._owners = list(owners.values())
        self._machine = ahocorasick.Automaton()
        for k, w in enumerate(owners):
            self._machine.add_word(f" {w.decode('latin-1')} ", (k, len(w) + 2))
        if owners:
            self._machine.make_automaton()
        self.empty = not owners

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged runs of hit words (first, end exclusive), and the items with a window that occurs."""
        if self.empty or not words:
            return [], set()
        flat = (b" " + b" ".join(words) + b" ").decode("latin-1")
        runs: list[list[int]] = []
        items: set = set()
        for end, (k, length) in self._machine.iter(flat):
            items |= self._owners[k]
            start = end - length + 1  # place of the space before the first word
            while runs and runs[-1][0] >= start:
                end = max(end, runs.pop()[1])
            if runs and start < runs[-1][1]:
                runs[-1][1] = max(end, runs[-1][1])
            else:
                runs.append([start, end])
        spans, seen, at = [], 0, 0
        for start, end in runs:  # spaces before a place are words before it
            seen += flat.count(" ", at, start)
            n = flat.count(" ", start, end)
            spans.append((seen, seen + n))
            seen, at = seen + n, end
        return spans, items


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as code-point offsets into the original text."""
    raw = text.encode()
    flat, bounds, at = raw.translate(NORMAL), [], 0
    for w in flat.split():
        at = flat.index(w, at)
        bounds.append((at, at + len(w)))
        at += len(w)
    return [(len(raw[: bounds[a][0]].decode()), len(raw[: bounds[b - 1][1]].decode())) for a, b in runs]


_machines: dict[tuple, Automaton] = {}


def _items_sha(items: set) -> str:
    return hashlib.sha256(",".join(sorted(str(x) for x in items if x is not None)).encode()).hexdigest()


class Block:
    """Some items as a broadcast, with a digest of them by which workers keep the automaton made of them."""

    def __init__(self, spark, items: list[tuple]):
        self.digest = hashlib.blake2b(repr(items).encode(), digest_size=16).hexdigest()
        self.items = spark.sparkContext.broadcast(items)

    def automaton(self, size: int) -> Automaton:
        key = (self.digest, size)
        if key not in _machines:
            _machines.clear()  # one automaton a worker
            _machines[key] = Automaton(self.items.value, size)
        return _machines[key]


def benchmark_blocks(benchmark: DataFrame, limit: int = AUTOMATON_BYTES) -> list[Block]:
    """The items in blocks of about ``limit`` bytes, or of one longer item; the driver never holds more than one block."""
    rows = benchmark.select("item_id", "text").where("text is not null")
    (total,) = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(1, -(-int(total) // max(1, limit)))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [Block(benchmark.sparkSession, sorted(((r.item_id, r.text) for r in (rows if n == 1 else rows.where(block == k)).collect()), key=repr)) for k in range(n)]


def judged(texts: list[str | None], found: list[tuple[list, set, int]]) -> dict:
    """The columns of :func:`find_contamination` from the runs of hit words and the items found in each text."""
    hit, items, n = [_covered(runs) for runs, _, _ in found], [x for _, x, _ in found], [x for _, _, x in found]
    spans = [",".join(f"{a}:{b}" for a, b in original_spans(t, _united(runs))) if runs else "" for t, (runs, _, _) in zip(texts, found)]
    return {
        "n_words": n, "n_hit": hit, "n_items": [len(x) for x in items], "items_sha256": [_items_sha(x) for x in items],
        "contaminated": [h > 0 and 20 * h >= w for h, w in zip(hit, n)], "spans": spans,
    }


def found_in_blocks(docs: DataFrame, blocks: list[Block], size: int) -> DataFrame:
    """``docs`` with the columns __runs and __items, from one scan of the texts for each block, so a task holds one automaton."""
    key = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    texts = docs.select(key.alias("__key"), "text")

    def scan(block: Block) -> DataFrame:
        def run(cols: dict) -> dict:
            out: dict[str, list] = {"__key": [], "__runs": [], "__items": []}
            for k, t in zip(cols["__key"], cols["text"]):
                runs, items = block.automaton(size).scan(words_of(t))
                if runs:
                    out["__key"].append(k)
                    out["__runs"].append([x for r in runs for x in r])
                    out["__items"].append(sorted((None if x is None else str(x) for x in items), key=repr))
            return out

        return arrow_map(texts, run, "__key string, __runs array<int>, __items array<string>")

    hits = reduce(DataFrame.unionByName, map(scan, blocks)).dropDuplicates(["__key", "__runs", "__items"])
    merged = hits.groupBy("__key").agg(F.flatten(F.collect_list("__runs")).alias("__runs"), F.flatten(F.collect_list("__items")).alias("__items"))
    merged = staged(merged, "hits")  # a written table, so that a text of very many rows is split
    return docs.withColumn("__doc_key", key).join(merged, F.col("__doc_key") == F.col("__key"), "left").drop("__doc_key", "__key")


def _pairs(runs: list[int] | None) -> list[tuple[int, int]]:
    return list(zip((runs or [])[::2], (runs or [])[1::2]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, with_spans: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of ``docs``, and spans if asked for: the hit
    runs as start:end in code points of the original text, comma-joined.

    Null and empty texts have no words and are clean; an item without words has no window; items with one id count
    once; items without id count once, too, and aren't in items_sha256; repeated documents are judged each; extra
    columns are ignored. With no benchmark every document is clean.
    """
    blocks = benchmark_blocks(benchmark)
    rows = docs.select("doc_id", "text")
    if len(blocks) > 1:
        rows = found_in_blocks(rows, blocks, size)

    def run(cols: dict) -> dict:
        return {"doc_id": cols["doc_id"], **judged(cols["text"], _found(cols, blocks, size))}

    return arrow_map(rows, run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" + ", spans string" * with_spans)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns; rules for odd rows as in :func:`find_contamination`."""
    blocks = benchmark_blocks(benchmark)
    rows, columns = docs, ["text"]
    if len(blocks) > 1:
        rows, columns = found_in_blocks(docs, blocks, size), ["text", "__runs", "__items"]
    kept = arrow_filter(rows, columns, lambda cols: [not x for x in judged(cols["text"], _found(cols, blocks, size))["contaminated"]])
    return kept.select(*docs.columns)


def _found(cols: dict, blocks: list[Block], size: int) -> list[tuple[list, set, int]]:
    """Runs, items and number of words of each text: of the scans by block if there were any, else by the one automaton."""
    if "__runs" in cols:
        return [(_pairs(r), set(i or []), len(words_of(t))) for r, i, t in zip(cols["__runs"], cols["__items"], cols["text"])]
    machine = blocks[0].automaton(size)
    return [(*machine.scan(words), len(words)) for words in map(words_of, cols["text"])]


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _covered(spans: list[tuple[int, int]]) -> int:
    return sum(b - a for a, b in _united(spans))


def query(spark, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + 12) AS win, least(len(w), 13) AS n
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM bw WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), sizes AS (SELECT DISTINCT n FROM win
), places AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, sizes WHERE len(w) >= n)
), hits AS (SELECT p.doc_id, p.i, p.n, w.item_id FROM places p JOIN win w ON p.n = w.n AND p.win = w.win
), hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM dw d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
