"""The chunker against the plain walk over a text's parts, and WordPiece against the library."""

import os
import re

import pytest

from tessera.functions import wordpiece
from tessera.sources import chunking, parse

DIR = "/root/testdata"
COUNT = re.compile(r"\w+|[^\w\s]")


def plain_chunks(text, budget, overlap, count=lambda s: len(COUNT.findall(s))):
    """Part by part, each counted when it comes."""
    text = text.strip()
    if not text:
        return []
    if (n := count(text)) <= budget:
        return [(text, n)]
    out, held, used = [], "", 0
    for part in filter(None, re.split(r"(\n\n|\n|\. |\s+)", text)):
        n = count(part)
        if n > budget:
            out.append(held)
            while count(part) > budget:
                size = max(k for k in range(1, len(part) + 1) if count(part[:k]) <= budget)
                out.append(part[:size])
                part = part[size:]
            held, used = part, count(part)
        elif used + n > budget and held.strip():
            out.append(held)
            words, left = re.split(r"(\s+)", held), overlap
            while words and count(words[-1]) <= left:
                left -= count(words.pop())
            opening = held[len("".join(words)) :].lstrip()
            held, used = opening + part, count(opening) + n
        else:
            held, used = held + part, used + n
    return [(c, count(c)) for c in (x.strip() for x in (*out, held)) if c]


@pytest.mark.parametrize("budget,overlap", [(4, 2), (4, 0), (6, 6), (9, 3), (30, 7)])
def test_chunks_by_hand_made_texts(budget, overlap):
    import random

    rng = random.Random(budget)
    bits = ["a", "bc", "d.", "e. ", " ", "  ", "\n", "\n\n", "\n\n\n", ".", ". ", "...... ", "x-y", "--------------------", "é", "ñu_2", "　", "\x1c", "w" * 40, "1,2;3:4!5?6", "\t", "🙂", "漢字"]
    for _ in range(600):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))
        assert chunking.budget_chunks(text, budget, overlap) == plain_chunks(text, budget, overlap), repr(text)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_chunk_budget_over_all_rows(spark):
    from tessera.plans import base, catalog  # noqa: F401

    got = {}
    for r in base.QUERIES["chunk_budget"](spark, f"{DIR}/sf0.01").collect():
        got.setdefault(r.parent_id, []).append((r.chunk_index, r.chunk_total, r.text, r.token_count))
    for r in spark.read.parquet(f"{DIR}/sf0.01/documents.parquet").collect():
        want = plain_chunks(r.text or "", parse.BUDGET, 40)
        assert sorted(got.pop(str(r.doc_id), [])) == [(i, len(want), t, n) for i, (t, n) in enumerate(want)]
    assert not got


def test_table_function(spark):
    chunking.register(spark)
    rows = [("a", " ".join(f"w{i}" for i in range(700))), ("b", "short"), ("c", ""), ("d", None)]
    df = spark.createDataFrame(rows, "parent_id string, text string")
    df.createOrReplaceTempView("texts")
    want = sorted(map(tuple, chunking.chunk_by_budget(df, 50, 5).collect()))
    by_row = spark.sql("SELECT parent_id, c.* FROM texts, LATERAL chunk_text(text, 50, 5) c")
    by_table = spark.sql("SELECT * FROM chunk_text(TABLE(texts) PARTITION BY (parent_id), 50, 5)")
    assert sorted(map(tuple, by_row.collect())) == sorted(map(tuple, by_table.collect())) == want and len(want) > 14
    assert spark.sql("SELECT count(*) FROM chunk_text('one two three', 2, 0)").first()[0] == 2
    for bad in ("chunk_text('x', -1)", "chunk_text('x', 0)", "chunk_text(TABLE(SELECT 1 AS y))", "chunk_text('x', 5, NULL)"):
        with pytest.raises(Exception, match="budget|table needs"):
            spark.sql(f"SELECT * FROM {bad}").collect()


def library(vocabulary):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    t = Tokenizer(models.WordPiece({w: i for i, w in enumerate(vocabulary)}, unk_token="[UNK]", max_input_chars_per_word=100))
    t.normalizer, t.pre_tokenizer = normalizers.BertNormalizer(), pre_tokenizers.BertPreTokenizer()
    return t


def test_pieces_equal_the_library():
    vocabulary = ["[UNK]", "un", "##aff", "##able", "##a", "##b", "##l", "##e", "a", "b", "c", "ab", "abc", "##bc", "##bcd", "e", "n", "##n", "o", "!", ".", "-", "漢", "##'", "'", "ß", "##ss", "i", "##i", "##"]
    model, lib = wordpiece.WordPiece(vocabulary), library(vocabulary)
    for text in ["unaffable", "abcd abcdbcd", "abx", "ÀB éÑ İi ß", "a" * 100, "a" * 101, "a.b-c!", "漢字 a漢b", "a​b\x00c\x07�n", "a b c　e", "a\tb\nc\x0be\x85n", "Ａ ﬁ", "áb", "don't", "", " ", "a¿b«c»", "a_b$c+e", "ẞ ẞ", "##a", "[UNK]"]:
        assert [p for w in wordpiece.words(text) for p in model.pieces(w)] == lib.encode(text, add_special_tokens=False).tokens, repr(text)
        assert model.count(text) == len(lib.encode(text, add_special_tokens=False).ids)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_counts_equal_the_library_on_whole_documents(spark):
    from tessera.plans import base, catalog  # noqa: F401

    lib = library(base.wordpiece_vocabulary())
    got = {r.doc_id: r.token_count for r in base.QUERIES["wordpiece_count"](spark, f"{DIR}/sf0.01").collect()}
    rows = spark.read.parquet(f"{DIR}/sf0.01/documents.parquet").select("doc_id", "text").collect()
    counts = lib.encode_batch([r.text or "" for r in rows], add_special_tokens=False)
    assert got == {r.doc_id: len(c.ids) for r, c in zip(rows, counts)} and sum("[UNK]" in c.tokens for c in counts) < len(rows)


def test_chunks_by_model_tokens():
    model = wordpiece.WordPiece(["a", "b", "##a", "##b", "c", ".", "!"])
    import random

    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["a", "ab", "ba ", " ", "c. ", "!!!!!!!! ", "\n", "abab", "x"]) for _ in range(rng.randint(1, 40)))
        assert chunking.budget_chunks(text, 5, 2, model.count) == plain_chunks(text, 5, 2, model.count), repr(text)
