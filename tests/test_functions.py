"""Text and vector functions against hand-made value tables."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import vectors as vx
from tessera.operators import policy


def values(spark, inputs, column, kind="string"):
    rows = [(i, x) for i, x in enumerate(inputs)]
    df = spark.createDataFrame(rows, f"i int, x {kind}").select("i", column(F.col("x")).alias("y"))
    return [r.y for r in df.orderBy("i").collect()]


def test_tokenize(spark):
    words = ["kitob", "kitoblar", "kitobning", "kitobdan", "kitobga", "bor", "bir", "van", "dify", "customer"]
    assert values(spark, words, tx.tokenize) == [["kitob"]] * 5 + [["bor"], ["bir"], ["van"], ["dify"], ["customer"]]
    assert values(spark, ["Narxlar bo‘yicha", "'a' b_c 1,5", "", None, "oʻzbek ʼx"], tx.tokenize) == [["narx", "bo", "yicha"], ["a", "b_c", "1", "5"], [], None, ["o'zbek", "x"]]


def python_stem(word):
    """The stemmer's rules, one at a time."""
    from tessera.constants import STEM_SUFFIXES

    while len(word) > 3:
        for s in sorted(STEM_SUFFIXES, key=len, reverse=True):
            if word.endswith(s) and len(word) - len(s) >= 3:
                word = word[: len(word) - len(s)] + ("a" if s in ("aymiz", "aydi") else "")
                break
        else:
            if word.endswith("mi") and len(word) >= 5:
                word = word[:-2]
            elif word.endswith("i") and not word.endswith("mi") and len(word) >= 6 and word[-2] not in "aeiou":
                word = word[:-1]
            else:
                break
    return word


def test_light_stem(spark):
    import random

    rng = random.Random(4)
    parts = ["kitob", "lar", "ning", "ish", "la", "aymiz", "aydi", "i", "mi", "tarmog'", "bor", "x", "imiz", "dagi", "gan", "dimi", "o"]
    words = ["api", "mini", "ai", "tarmog'i", "boshlaymiz", "oqiydi"] + ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(600)]
    assert values(spark, words, tx.light_stem) == [python_stem(w) for w in words]
    assert values(spark, ["api", "mini", "ai"], tx.light_stem) == ["api", "mini", "ai"]


def test_light_stem_ends_at_a_fixpoint(spark):
    words = ["kitob" + "lar" * n for n in (15, 16, 17, 18, 60)] + ["kitob" + "larning" * 20, "", "a" * 3000, None]
    assert values(spark, words, tx.light_stem) == [w and python_stem(w) for w in words]
    assert values(spark, words[:5], tx.light_stem) == ["kitob"] * 5


def test_constraints_slug_prefix(spark):
    assert values(spark, ['in 2026 "Big Deal" 1899 20261'], tx.strict_constraints) == [["2026", "big deal"]]
    assert values(spark, ["Hello,  World!", "", "___"], tx.slugify) == ["hello-world", "chat", "-"]
    assert values(spark, ["ig:a:item:3", "ig:a:", "x"], tx.parent_prefix) == ["ig:a:item:", "ig:a:", "x:"]
    assert values(spark, ["D--claude-projects-AI-academiya", "D--claude-projects", "C--Users-user-Desktop-Uzbekonacisco-uz"], tx.project_label) == ["cc-ai-academiya", "cc-claude-projects", "cc-uzbekonacisco-uz"]
    assert values(spark, [["A", "B", "B", "A"], [], ["C"]], tx.run_length_chain, "array<string>") == ["A -> B x2 -> A", "", "C"]


def test_distances(spark):
    got = lambda d, space: spark.range(1).select(*vx.distance_to_similarity(F.lit(d), space)).first()
    assert tuple(got(1.0, "l2")) == (0.5, 0.5)
    assert tuple(got(0.3, "cosine")) == pytest.approx((0.7, 0.7))
    assert tuple(got(4.0, "l2")) == (0.0, -1.0)
    assert tuple(got(-1.0, "l2")) == (1.0, 1.5)
    with pytest.raises(ValueError):
        vx.distance_to_similarity(F.lit(0.0), "hamming")


def test_normalise(spark):
    assert values(spark, [[3.0, 4.0]], vx.l2_normalize, "array<double>") == [[0.6, 0.8]]
    with pytest.raises(Exception, match="normalised"):
        values(spark, [[0.0, 0.0]], vx.l2_normalize, "array<double>")
    assert values(spark, [[1.0, 0.0], [2.0, 0.0]], vx.is_unit, "array<double>") == [True, False]


def test_where_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, k string")
    got = lambda w: [r.i for r in df.where(policy.where(w)).orderBy("i").collect()]
    assert got(None) == got({}) == [1, 2, 3]
    assert got({"k": "a"}) == got({"k": {"$eq": "a"}}) == [1]
    assert got({"k": {"$ne": "a"}}) == [2, 3]
    assert got({"k": {"$nin": ["a"]}}) == [2, 3]
    assert got({"k": {"$in": ["a", None]}}) == [1, 3]
    assert got({"k": None}) == [3]
    assert got({"k": {"$gt": "a"}}) == []
    assert got({"$or": [{"k": "a"}, {"k": "b"}]}) == [1, 2]
    assert got({"$and": [{"k": {"$ne": "a"}}, {"k": {"$ne": "b"}}]}) == [3]


def test_query_variants():
    assert policy.query_variants("what is the") == []
    assert policy.query_variants('salom "exact phrase" 2026 $10k+ gpt-6 haqida') == ['"exact phrase" 2026 $10k+ gpt-6']
    assert policy.query_variants("xotira tizimi") == ["xotira tizimi", "memory tizimi"]
    assert policy.query_variants("x" * 1500) == []
    long = " ".join([f"w{'a' * i}" for i in range(30)] + ["2024"] + [f"z{'b' * i}" for i in range(30)])
    assert len(policy.query_variants(long)[0].split()) == 41


def test_source_key(spark):
    rows = [("a", None, None, "save_memory"), ("b", "ig:Q1:item:2", None, None), ("c", "p", "q", "r"), ("d", "", "", ""), ("e", None, None, "https://instagram.com/reel/Z9/x")]
    df = spark.createDataFrame(rows, "id string, parent_id string, canonical_id string, source string")
    assert [r[0] for r in df.select(policy.source_key({c: F.col(c) for c in df.columns})).collect()] == ["a", "ig:Q1", "p", "d", "ig:Z9"]
