"""Retrieval quality: recall, reciprocal rank, false answers, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import THRESHOLD_TOLERANCE
from ..functions.text import parent_prefix


#: Characters of questions that are sent to every task.
SENT = 8 << 20


def first_hits(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(qid, first): the rank of each query's first hit. results: (qid, rank, parent); expected: (qid, expected)."""
    return results.join(expected, "qid").where(F.col("parent") == F.col("expected")).groupBy("qid").agg(F.min("rank").alias("first"))


def is_hit(ids: Column, expected: Column) -> Column:
    """Whether any of a result's ids (arrays of strings) is an expected one, lies below it or above it, or shares its parent."""

    def meets(c: Column, e: Column) -> Column:
        pc, pe = parent_prefix(c), parent_prefix(e)
        return (c == e) | c.startswith(F.concat(e, F.lit(":"))) | e.startswith(F.concat(c, F.lit(":"))) | pc.startswith(pe) | pe.startswith(pc)

    given = F.filter(expected, lambda e: F.coalesce(F.trim(e), F.lit("")) != "")
    return F.coalesce(F.exists(F.filter(ids, lambda c: F.coalesce(c, F.lit("")) != ""), lambda c: F.exists(given, lambda e: meets(c, F.trim(e)))), F.lit(False))


def candidates(top: DataFrame) -> DataFrame:
    """theta: steps of 0.05, every score seen, and a fine grid where all scores are under 0.1."""
    steps = top.sparkSession.range(20).select(F.round(F.col("id") * 0.05, 4).alias("theta"))
    seen = top.select(F.round("score", 4).alias("theta"))
    most = top.agg(F.max(F.round("score", 4)).alias("m")).where("m < 0.1")
    fine = most.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: F.round(i * F.col("m") / 50, 5))).alias("theta"))
    return steps.unionByName(seen).unionByName(fine).distinct()


def recall_at(k: int, first: str = "first", kind: str = "kind") -> Column:
    return F.round(F.avg(F.when(F.col(kind) == "answerable", (F.coalesce(F.col(first), F.lit(1 << 30)) <= k).cast("double"))), 4)


def mrr(first: str = "first", kind: str = "kind") -> Column:
    return F.round(F.avg(F.when(F.col(kind) == "answerable", F.coalesce(1.0 / F.col(first), F.lit(0.0)))), 4)


def false_answers(condition: Column, answered: Column) -> Column:
    return F.round(F.avg(F.when(condition, answered.cast("double"))), 4)


def by_language(rows: DataFrame, *measures: Column, languages: tuple[str, ...] = ("uz", "en")) -> DataFrame:
    """Measures of all queries (lang ``overall``) and of each of ``languages``, in one pass of grouping sets."""
    cube = rows.groupingSets([["lang"], []], "lang").agg(*measures, F.grouping_id().alias("g"))
    named = cube.withColumn("lang", F.when(F.col("g") == 1, "overall").otherwise(F.col("lang"))).drop("g")
    return named.where(F.col("lang").isin("overall", *languages))


def sweep(queries: DataFrame, top: DataFrame, hits: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(theta, r10, mrr, far) of each threshold; hits below it don't count, and it answers whatever scores at least it.

    As the threshold falls, measures change only where some hit or answer comes in; these changes are added up along the
    scores once, so work follows hits and thresholds, not their product. hits: (qid, rank, score); top: (qid, score).
    """
    kinds = queries.select("qid", (F.col("kind") == "answerable").alias("answerable"))
    n = kinds.agg(F.count_if("answerable").alias("n_yes"), F.count_if(~F.col("answerable")).alias("n_no"))
    along = Window.partitionBy("qid").orderBy(F.col("score").desc())
    # of each query: the least rank seen down to each score, and what it adds to the measures
    least = hits.groupBy("qid", "score").agg(F.min("rank").alias("rank")).withColumn("least", F.min("rank").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.lag("least").over(along)
    exact = lambda c: c.cast("decimal(20,12)")
    recall = lambda c: F.when(c <= 10, 1).otherwise(0)
    steps = least.withColumn("before", before).join(kinds.where("answerable"), "qid").select(
        "score", (recall(F.col("least")) - F.when(F.col("before").isNull(), 0).otherwise(recall(F.col("before")))).alias("d_recall"),
        (exact(1 / F.col("least")) - F.coalesce(exact(1 / F.col("before")), exact(F.lit(0)))).alias("d_rank"), F.lit(0).alias("d_answered"),
    )
    answered = top.join(kinds.where("NOT answerable"), "qid").select("score", F.lit(0).alias("d_recall"), exact(F.lit(0)).alias("d_rank"), F.lit(1).alias("d_answered"))
    names = ("d_recall", "d_rank", "d_answered")
    changes = steps.unionByName(answered).groupBy("score").agg(*(F.sum(c).alias(c) for c in names)).withColumn("theta", F.lit(None).cast("double"))
    asked = thresholds.select(F.col("theta").alias("score"), F.lit(0).alias("d_recall"), exact(F.lit(0)).alias("d_rank"), F.lit(0).alias("d_answered"), "theta")
    down = Window.orderBy(F.col("score").desc()).rangeBetween(Window.unboundedPreceding, 0)
    total = changes.unionByName(asked).select("theta", *(F.sum(c).over(down).alias(c) for c in names)).where("theta IS NOT NULL")
    share = lambda c, of: F.round(F.col(c).cast("double") / F.nullif(F.col(of), F.lit(0)), 4)
    return total.crossJoin(F.broadcast(n)).select("theta", share("d_recall", "n_yes").alias("r10"), share("d_rank", "n_yes").alias("mrr"), share("d_answered", "n_no").alias("far"))


def containing(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(qid, doc_id): which documents (doc_id, text) hold which items (qid, q) as they stand.

    A text that holds an item has each of its inner words between spaces, so texts and items meet by the item's longest
    inner word before they are compared. Items of two words or less have none and go to every text, in a batch whose size
    is checked.
    """
    words = F.split("q", " ")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    keyed = items.where("q IS NOT NULL").select("qid", "q", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"].alias("word"))
    long, short = keyed.where("coalesce(word, '') <> ''"), keyed.where("coalesce(word, '') = ''")
    met = docs.select("doc_id", "text", F.explode(F.array_distinct(F.split("text", " "))).alias("word")).join(_sent(long), "word").where(F.contains("text", "q")).select("qid", "doc_id")
    size = short.agg(F.coalesce(F.sum(F.length("q")), F.lit(0))).first()[0]
    if size > SENT:
        raise ValueError(f"{size} characters of items of two words or less are too many to compare with every text")
    return met if not short.limit(1).count() else met.unionByName(docs.join(F.broadcast(short), F.contains("text", "q")).select("qid", "doc_id"))


def _sent(items: DataFrame) -> DataFrame:
    """``items``, to be sent to every task where they are small."""
    (size,) = items.agg(F.coalesce(F.sum(F.length("q")), F.lit(0))).first()
    return F.broadcast(items) if size <= SENT else items.hint("merge")


def verdict(with_: Column, without: Column, margin: float = 0.0) -> Column:
    """ON where a configuration with a step beats the one without by more than ``margin``, OFF where it loses by as much, else EQUAL."""
    return F.when(with_ - without > margin, "ON").when(without - with_ > margin, "OFF").otherwise("EQUAL")


def optimal(swept: DataFrame, tolerance: float = THRESHOLD_TOLERANCE) -> DataFrame:
    """The threshold of fewest false answers among those within ``tolerance`` of the best recall."""
    best = swept.agg(F.max("r10").alias("best"))
    return swept.crossJoin(best).where(F.col("r10") >= F.round(F.col("best") - tolerance, 6)).orderBy("far", F.col("r10").desc(), F.col("theta").desc()).limit(1).select("theta", "r10", "mrr", "far")


def ranked(configs: DataFrame, *by: Column) -> DataFrame:
    return configs.withColumn("position", F.row_number().over(Window.orderBy(*by)))
