"""Operators that compare documents, and the pipeline, against brute force."""

import collections
import hashlib
import re

import numpy as np
import pytest

from tessera.llm import chat, neardup, sharding, substrings, suffix
from tessera.llm.common import staged


def sets_of(t, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def components(rows, size, percent=80):
    """Component of each row (by place) of (doc_id, text)."""
    sets = [sets_of(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    return [root(i) for i in range(len(rows))], sets


@pytest.mark.parametrize("block", [1024, 4])
def test_near_duplicates(docs, empty, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    comp, sets = components(rows, 4)
    least = {c: min((d for (d, _), x in zip(rows, comp) if x == c and d is not None), default=None) for c in comp}
    want = collections.Counter((d, len(s), least[c], d == least[c]) for (d, _), c, s in zip(rows, comp, sets))
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect())
    assert got == want
    assert neardup.near_duplicates(empty).count() == 0


def test_large_families_lose_no_link(spark, monkeypatch):
    """A chain and strays around a template, in families cut into blocks of a few nodes."""
    import random

    monkeypatch.setattr(neardup, "BLOCK", 5)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(160)]
    rows = []
    for i in range(40):  # near the template
        w = list(base)
        w[rng.randrange(160)] = word()
        rows.append(" ".join(w))
    w = list(base)
    for i in range(25):  # each near the one before it
        for _ in range(3):
            w[rng.randrange(160)] = word()
        rows.append(" ".join(w))
    for i in range(25):  # strays: half of the template
        rows.append(" ".join(base[:80] + [word() for _ in range(60 + i)]))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    comp, sets = components(rows, 4)
    least = {c: min(d for (d, _), x in zip(rows, comp) if x == c) for c in comp}
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: least[c] for (d, _), c in zip(rows, comp)} and len(set(got.values())) > 10


def test_one_of_each_stays(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    comp, sets = components(rows, 5)
    kept = [(r.doc_id, r.text) for r in neardup.keep_one_of_each(docs).collect()]
    place = {row: c for row, c in zip(rows, comp)}
    with_words = [place[k] for k in kept if sets_of(k[1], 5)]
    assert len(with_words) == len(set(with_words)) == len({c for c, s in zip(comp, sets) if s})
    assert {k for k in kept if not sets_of(k[1], 5)} == {r for r, s in zip(rows, sets) if not s}


def test_long_texts_are_hashed_in_parts(monkeypatch):
    """Texts over a chunk are cut at white space; sets stay the same, with and without a long word across a seam."""
    texts = ["ab cd\tef  gh\nij " * 40, "x" * 500 + " y z " + "w" * 90 + " " + "q r s t u v " * 30, None, "", " ", "one two"]
    whole = [s.tolist() for s in neardup.shingle_sets(texts, 4)]
    for chunk in (7, 16, 64, 100):
        monkeypatch.setattr(neardup, "CHUNK", chunk)
        assert [s.tolist() for s in neardup.shingle_sets(texts, 4)] == whole
    monkeypatch.setattr(neardup, "CHUNK", 1 << 19)
    long = " ".join(f"w{i % 5000}" for i in range(200_000))
    assert len(long) > 1 << 20 and len(neardup.shingle_sets([long], 4)[0]) == 5000


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    errors = []
    for share in (100, 200, 300, 360):
        b = np.concatenate([a[:share], rng.integers(0, 1 << 63, 400 - share).astype(np.uint64)])
        s = neardup.superminhash([np.unique(a), np.unique(b)])
        errors.append((s[0] == s[1]).mean() - share / (800 - share))
    assert np.abs(errors).max() < 0.15
    small = neardup.superminhash([np.array([5], np.uint64), np.array([5, 9], np.uint64), np.zeros(0, np.uint64)])
    assert np.isfinite(small[:2]).all() and np.isinf(small[2]).all()
    assert sorted(np.floor(small[0])) == list(range(128))


def test_early_stop_changes_nothing():
    rng = np.random.default_rng(3)
    x = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    both = neardup.superminhash([x, x[:3]])
    assert (neardup.superminhash([x])[0] == both[0]).all() and (neardup.superminhash([x[:3]])[0] == both[1]).all()


def test_components(spark):
    import random

    rng = random.Random(5)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    up = {x: x for e in links for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert got == {x: root(x) for x in up if root(x) != x}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_arrays():
    import random

    rng = random.Random(1)
    for _ in range(300):
        n, k = rng.randint(1, 70), rng.choice([1, 2, 3, 256])
        d = bytes(rng.randrange(k) for _ in range(n))
        a = np.frombuffer(d, np.uint8)
        sa = suffix.suffix_array(a)
        assert sa.tolist() == sorted(range(n), key=lambda i: d[i:])
        want = [0] * n
        for x, y in zip(sa, sa[1:]):
            while max(x, y) + want[y] < n and d[x + want[y]] == d[y + want[y]]:
                want[y] += 1
        assert suffix.permuted_lcp(a, sa).tolist() == want


def doubled(t):
    """Suffix array by doubling of ranks."""
    n, rank, k = len(t), np.asarray(t).astype(np.int64), 1
    while True:
        key = rank * (n + 2)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) > 0)
        if new[order[-1]] == n - 1:
            return order
        rank, k = new, 2 * k


def thue_morse(n):
    bits = np.zeros(1, np.uint8)
    while len(bits) < n:
        bits = np.concatenate([bits, 1 - bits])
    return (bits[:n] + ord("a")).tobytes()


def test_suffix_arrays_of_structured_and_long_strings():
    rng = np.random.default_rng(4)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)) for _ in range(3000)]
    prose = b" ".join(words[i] for i in rng.integers(0, 3000, 30_000))
    for d in (b"a" * 50_000, thue_morse(1 << 16), b"abcab" * 900 + b"q" * 700, b"ab" * 40_000 + b"b", prose, prose + prose[:70_000], bytes(rng.integers(0, 256, 100_000).astype(np.uint8))):
        a = np.frombuffer(d, np.uint8)
        assert (suffix.suffix_array(a) == doubled(np.append(a.astype(np.int64) + 1, 0))[1:]).all(), d[:20]


@pytest.mark.parametrize("most", [2000, 2])
def test_repeats(spark, docs, empty, monkeypatch, most):
    monkeypatch.setattr(substrings, "MOST_PIECES", most)
    same_as_brute_force(docs, 90)
    assert substrings.remove_repeats(empty, 90).count() == 0
    t, shared = thue_morse(9000).decode(), "".join(map(chr, range(200, 400)))
    odd = [t, t[4096:] + t[:4096], "a" * 3000, "a" * 95, "ab" * 700, t[:4096] + "x" + t[4096:], *(f"{i:04d}" * 20 + shared + f"{i * 7:05d}" * 9 for i in range(12))]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    same_as_brute_force(df, 90, chunk=1000)  # texts are cut at several seams


def same_as_brute_force(docs, length, **how):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]
    starts = collections.Counter(b[i : i + length] for _, b in rows for i in range(len(b) - length + 1))
    want = collections.Counter()
    for d, b in rows:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if starts[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want[d, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), bool(gone.any())] += 1
    got = collections.Counter(tuple(r) for r in substrings.remove_repeats(docs, length, **how).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "repeats").collect())
    assert got == want and sum(k[2] for k in want) > 0


def test_sharding(docs, empty, tmp_path):
    n = docs.count()
    digests = staged(sharding.digests(docs), "digests")
    got = sharding.assign_shards(digests, 5).collect()
    want = collections.Counter((r.doc_id, len((r.text or "").encode()) + 8) for r in docs.collect())
    assert collections.Counter((r.doc_id, r["size"]) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert set(by) == set(range(5)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    key = lambda rs: sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in rs)
    assert key(sharding.assign_shards(digests.repartition(7), 5).collect()) == key(got)
    assert sharding.assign_shards(sharding.digests(empty), 5).count() == 0
    out = str(tmp_path / "shards")
    sharding.write_shards(docs.drop("shard"), out, 5, ["doc_id", "text"], sharding.F.octet_length(sharding.F.coalesce("text", sharding.F.lit(""))))
    back = docs.sparkSession.read.parquet(out)
    assert back.count() == n and sorted(r.slot for r in back.where("shard = 0").collect()) == list(range(back.where("shard = 0").count()))


def shuffled_by_hand(ids, sizes, n_shards, seed=17):
    """Shard and slot of records with distinct ids, from the rules alone."""
    import struct

    import xxhash

    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    of_int = lambda x, s: xxhash.xxh64_intdigest(struct.pack("<i", x), s)
    of_long = lambda x, s: xxhash.xxh64_intdigest(struct.pack("<q", x), s)
    n = len(ids)
    n_buckets = max(1, -(-sum(sizes) // sharding.BUCKET_BYTES), -(-n // sharding.BUCKET_ROWS))
    buckets = collections.defaultdict(list)
    for d in ids:
        h = signed(of_int(seed, 42) if d is None else of_long(d, of_int(seed, 42)))
        buckets[signed(of_long(h, of_int(seed + 1, 42))) % n_buckets].append((h, d))
    out, rank = {}, 0
    for b in sorted(buckets):
        order = []
        for i in range(len(buckets[b])):
            j = signed(of_int(i, of_int(b, of_int(seed + 2, 42)))) % (i + 1)
            order.append(i)
            order[j], order[i] = order[i], order[j]
        records = sorted(buckets[b])
        for i in order:
            shard = rank * n_shards // n
            out[records[i][1]] = shard, rank - -(-shard * n // n_shards)
            rank += 1
    return out


@pytest.mark.parametrize("partitions,adaptive", [(4, "true"), (7, "false"), (200, "true"), (1, "false")])
def test_shuffle_is_the_one_of_the_rules(spark, partitions, adaptive):
    import zlib

    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    texts = {i: f"text {i % 97} é" * (i % 13) for i in range(3000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        got = sharding.shard_documents(docs).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    want = shuffled_by_hand(list(texts), [len(t.encode()) + 8 for t in texts.values()], 24)
    assert {(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got} == {(d, len(t.encode()) + 8, zlib.crc32(t.encode()), *want[d]) for d, t in texts.items()}
    assert len(got) == 3000


def test_fisher_yates_is_uniform(spark):
    """Each of the 24 orders of four comes up about as often."""
    from pyspark.sql import functions as F

    draw = lambda i: F.pmod(F.xxhash64(F.col("id"), i), (i + 1).cast("long")).cast("int")
    seen = {tuple(r.a): r["count"] for r in spark.range(24_000).select(sharding.fisher_yates(F.lit(4), draw).alias("a")).groupBy("a").count().collect()}
    assert len(seen) == 24 and sum((n - 1000) ** 2 / 1000 for n in seen.values()) < 60


def test_sharding_writes_whole_records(spark, docs, empty, monkeypatch, tmp_path):
    from tessera.llm import queries

    written = []
    put = sharding.write_shards
    monkeypatch.setattr(sharding, "write_shards", lambda df, path, *a: (written.append(path), put(df, path, *a)))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op2_sharding(spark, str(tmp_path)).collect()
    files = spark.read.parquet(written[0])
    plain = lambda df, shard: collections.Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars, r[shard], r.root) for r in df.collect())
    assert plain(files, "own_shard") == plain(docs, "shard")
    size = lambda t: len((t or "").encode()) + 8
    assert sorted((r.shard, r.slot, str(r.doc_id), r["size"]) for r in got) == sorted((r.shard, r.slot, str(r.doc_id), size(r.text)) for r in files.collect())
    again = sharding.shard_documents(docs.repartition(7)).collect()
    key = lambda rs: sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in rs)
    assert key(again) == key(got) and {r.law for r in got} == {"rows"}
    by = collections.Counter(r.shard for r in got)
    assert max(by.values()) - min(by.get(k, 0) for k in range(24)) <= 1
    assert sharding.shard_documents(empty).count() == 0


def test_chats(spark):
    turns = [(1, "a", "x"), (2, "b", "y"), (3, "a", "z")]
    logs = {1: turns[:1], 2: turns[:2], 3: turns, 4: turns, 5: [(1, "a", "x"), (2, "b", "other")], 6: [(1, None, None)], 7: [(9, "a", "x"), (10, "b", "y")], None: [(1, "q", "w"), (1, "q", "w")]}
    df = spark.createDataFrame([(c, t, r, x, "extra") for c, ts in logs.items() for t, r, x in ts], "conv_id long, turn long, role string, text string, pos string")
    got = {r.conv_id: (r.n_turns, r.n_copies) for r in chat.collapse_and_render(df).collect()}
    assert got == {3: (3, 2), 5: (2, 1), 6: (1, 1), None: (2, 1)}
    text = chat.collapse_and_render(df).where("conv_id = 5").first().rendered
    assert text == "<|a|>\nx\n<|end|>\n<|b|>\nother\n<|end|>\n"
    assert chat.collapse_and_render(df.where("false")).count() == 0


def test_long_conversations(spark):
    """One log of thousands of turns, its prefixes, and many copies of a short one."""
    turns = [(i, "ab"[i % 2], f"t{i}" * 30) for i in range(3000)]
    logs = {1: turns, 2: turns[:2999], 3: turns[:1], 4: [*turns[:100], (100, "a", "other")], **{k: [(1, "a", "same")] for k in range(10, 400)}}
    df = spark.createDataFrame([(c, t, r, x) for c, ts in logs.items() for t, r, x in ts], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat.collapse_and_render(df).collect()}
    assert {c: v[:2] for c, v in got.items()} == {1: (3000, 1), 4: (101, 1), 10: (1, 390)}
    assert got[1][2] == "".join(f"<|{r}|>\n{x}\n<|end|>\n" for _, r, x in turns)


def test_pipeline_takes_odd_and_empty_tables(spark, docs, empty, tmp_path):
    """Every stage on nulls, empty and long texts, repeated rows and more columns, and on no rows at all."""
    import corpus_pipeline

    bench = spark.createDataFrame([(1, "a b c"), (None, None), (2, "")], "item_id long, text string")
    for name, table in (("odd", docs), ("none", empty)):
        d = str(tmp_path / name)
        table.write.parquet(f"{d}/documents.parquet")
        bench.write.parquet(f"{d}/benchmark.parquet")
        rows = spark.read.parquet(f"{d}/documents.parquet")
        for stage, fn in corpus_pipeline.STAGES:
            out = staged(fn(spark, rows, d), stage)  # each stage by itself, on the whole table
            assert stage == "encoding" or out.columns == table.columns
            assert out.count() <= rows.count()
        assert (corpus_pipeline.run(spark, d).count() == 0) == (name == "none")


def test_pipeline(spark, docs, tmp_path):
    """The stages, one by one, against plain Python."""
    import corpus_pipeline
    import sentencepiece

    from tessera.llm import pii, quality
    from tessera.llm.queries import tokenizer

    prose = [r.text for r in docs.where("doc_id < 12").collect()]
    rows = [(100 + i, t + " " + t[::-1], "en", "s", 1) for i, t in enumerate(prose)] + [(300, prose[0] + " " + prose[0][::-1], "en", "s", 1), (301, "short", "en", "s", 1), (302, None, None, None, None)]
    rows += [(303, prose[1][:400] + " mail me@x.org now " + prose[2], "en", "s", 1)]
    d = str(tmp_path)
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, " ".join(rows[4][1].split(" ")[:40]))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    kept = {r.doc_id: r.text for r in table.join(quality.judge(table).where("kept").select("doc_id"), "doc_id").collect()}
    order = sorted(kept.items())
    comp, sets = components(order, 5)
    alive = {k: t for i, (k, t) in enumerate(order) if not sets[i] or k == min(order[j][0] for j in range(len(order)) if comp[j] == comp[i])}
    from tests.llm.test_text_ops import contaminated

    alive = {k: t for k, t in alive.items() if not contaminated(t, [(1, " ".join(rows[4][1].split(" ")[:40]))])[4]}
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    want = {k: sp.encode(pii.mask(t), add_eos=True) for k, t in alive.items()}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, d).collect()}
    assert got == want and 300 not in got and 104 not in got and 301 not in got and len(got) > 5
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "personal_data", "encoding"]
