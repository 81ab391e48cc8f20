"""Hybrid retrieval of a batch of questions in one plan: fusion, evidence, reranking, merging of variants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DENSE_WEIGHT, IDF_FLOOR, LEXICAL_WEIGHT, MIN_COVERAGE, RERANK_ALPHA, RERANK_TOP, RRF_K
from ..functions import text as tx
from ..session import prepare
from ..staging import staged
from .lexical import top


#: Terms of a question batch that are sent to every task; more are joined by a shuffle.
SENT_TERMS = 500_000
#: A date that counts as evidence.
ISO_DATE = r"^\d{4}-\d{2}-\d{2}(T.*)?$"


def best_per_source(hits: DataFrame, by: list[Column]) -> DataFrame:
    """The best hit of each (qid, source_key)."""
    w = Window.partitionBy("qid", "source_key").orderBy(*by, "id")
    return hits.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def rrf(dense: DataFrame, lexical: DataFrame, dense_weight: float = DENSE_WEIGHT, lexical_weight: float = LEXICAL_WEIGHT, k: int = RRF_K) -> DataFrame:
    """(qid, source_key, rrf): weighted reciprocal ranks of each leg's sources, added up.

    dense: (qid, id, source_key, similarity); lexical: (qid, id, source_key, score).
    """
    prepare(dense.sparkSession)
    legs = []
    for hits, by, weight in ((dense, F.col("similarity").desc(), dense_weight), (lexical, F.col("score"), lexical_weight)):
        best = best_per_source(hits, [by])
        rank = F.row_number().over(Window.partitionBy("qid").orderBy(by, "id"))
        legs.append(best.select("qid", "source_key", (F.lit(weight) / (k + rank)).alias("part")))
    return legs[0].unionByName(legs[1]).groupBy("qid", "source_key").agg(F.round(F.sum("part"), 6).alias("rrf"))


def term_weights(queries: DataFrame, docs) -> DataFrame:
    """(qid, term, weight): inverse frequency of each meaningful term over distinct parents, floored; ``docs`` as for
    :func:`lexical.bm25`."""
    from .index import Index, of_docs

    index = docs if isinstance(docs, Index) else of_docs(docs)
    terms = queries.select("qid", F.explode(F.array_distinct(tx.meaningful(tx.tokenize(F.col("text"))))).alias("term"))
    found = F.coalesce("parents", F.lit(0))
    idf = F.log((F.col("n_parents") - found + 0.5) / (found + 0.5) + 1)
    return terms.join(index.terms, "term", "left").crossJoin(F.broadcast(index.stats)).select("qid", "term", F.round(F.greatest(F.lit(IDF_FLOOR), idf), 6).alias("weight"))


def stems(terms: DataFrame) -> DataFrame:
    """(term, stem) of a vocabulary."""
    return terms.select("term").distinct().select("term", tx.light_stem(F.col("term")).alias("stem"))


def coverage(weights: DataFrame, pairs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(qid, id, coverage, matched) of ``pairs`` (qid, id, tokens): the share of the question's weight that the text has by stem,
    and how many of its terms.

    ``vocabulary`` (term, stem) knows the texts' words; without one it is made of them. Only words whose stem some question
    asks for are looked at, so a text's words aren't shuffled.
    """
    words = pairs.select("qid", "id", F.explode(F.array_distinct("tokens")).alias("term"))
    asked = weights.join(stems(weights), "term")
    known = stems(words) if vocabulary is None else vocabulary
    wanted = staged(known.join(asked.select("stem").distinct(), "stem", "left_semi").select("term", "stem").distinct(), "wanted")
    have = words.join(F.broadcast(wanted) if wanted.count() <= SENT_TERMS else wanted, "term").select("qid", "id", "stem").distinct()
    hit = have.join(asked, ["qid", "stem"]).groupBy("qid", "id").agg(F.sum("weight").alias("w"), F.count("*").alias("matched"))
    total = weights.groupBy("qid").agg(F.sum("weight").alias("total"))
    rows = pairs.select("qid", "id").distinct().join(total, "qid", "left").join(hit, ["qid", "id"], "left")
    return rows.select("qid", "id", F.coalesce(F.round(F.col("w") / F.col("total"), 6), F.lit(0.0)).alias("coverage"), F.coalesce("matched", F.lit(0)).alias("matched"))


def evidence_words(chunks: DataFrame, docs) -> DataFrame:
    """(id, evidence, tokens, extra) of chunks (id, document, title, date) of an index: the words come from the index, those of
    the date are ``extra``."""
    dated = F.when(F.col("date").rlike(ISO_DATE), F.col("date")).otherwise(F.lit(""))
    looked = chunks.select("id", evidence_text(F.col("document"), F.col("title"), F.col("date")).alias("evidence"), tx.tokenize(dated).alias("extra"))
    return looked.join(docs.docs.select("id", "tokens"), "id").select("id", "evidence", F.array_union("tokens", "extra").alias("tokens"), "extra")


def evidence_text(document: Column, title: Column, date: Column) -> Column:
    """What is looked at as evidence: the text, the title, and a date that is one."""
    named = F.concat(F.coalesce(document, F.lit("")), F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit(" "), title)).otherwise(F.lit("")))
    return F.concat(named, F.when(date.rlike(ISO_DATE), F.concat(F.lit(" "), date)).otherwise(F.lit("")))


def evidence_gate(queries: DataFrame, pairs: DataFrame, docs) -> DataFrame:
    """(qid, id, coverage, matched, passes) of each pair (qid, id, evidence; tokens and extra as of :func:`evidence_words` if
    there are any).

    One raw token: it must stand in the text as it is. Else every year and quoted string must, and the text must cover
    enough of the question's weight with enough of its terms.
    """
    from .index import Index, of_docs

    index = docs if isinstance(docs, Index) else of_docs(docs)
    vocabulary = None
    if {"tokens", "extra"} <= set(pairs.columns):
        vocabulary = index.terms.select("term", "stem").unionByName(stems(pairs.select(F.explode("extra").alias("term"))))
    else:
        pairs = pairs.select("qid", "id", "evidence", tx.tokenize(F.col("evidence")).alias("tokens"))
    pairs = staged(pairs.select("qid", "id", "evidence", "tokens"), "pairs")
    covered = coverage(term_weights(queries, index), pairs, vocabulary)
    asked = queries.select(
        "qid", tx.tokenize(F.col("text")).alias("raw"), tx.strict_constraints(F.col("text")).alias("constraints"),
    ).withColumn("n_meaningful", F.size(F.array_distinct(F.filter("raw", lambda t: ~t.isin(*tx.stop_list())))))
    low = F.lower(F.col("evidence"))
    strict = F.when(F.size("constraints") == 0, True).otherwise(F.forall("constraints", lambda c: F.contains(low, c)))
    single = F.when(F.size("raw") == 1, F.array_contains("tokens", F.col("raw")[0]))
    looked = pairs.join(asked, "qid").select("qid", "id", single.alias("single"), strict.alias("strict"), F.when(F.col("n_meaningful") == 1, 1).otherwise(2).alias("need"))
    rule = F.when(F.col("single").isNotNull(), F.col("single")).otherwise(F.col("strict") & (F.col("coverage") >= MIN_COVERAGE) & (F.col("matched") >= F.col("need")))
    return looked.join(covered, ["qid", "id"]).select("qid", "id", "coverage", "matched", rule.alias("passes"))


def gate_hits(queries: DataFrame, hits: DataFrame, chunks: DataFrame, index) -> DataFrame:
    """:func:`evidence_gate` of hits (qid, id) on a stored index and its chunks (id, document, title, date).

    A document's words come from the postings of words that some question asks for by stem, once for each document however
    many questions hit it. Texts are read only for questions that have constraints, so none is copied for a pair.
    """
    pairs = staged(hits.select("qid", "id").distinct(), "pairs")
    ids = pairs.select("id").distinct()
    weights = staged(term_weights(queries, index), "weights")
    asked = weights.join(stems(weights), "term").select("qid", "stem", "weight")
    dated = chunks.select("id", F.explode(tx.tokenize(F.when(F.col("date").rlike(ISO_DATE), F.col("date")))).alias("term")).join(ids, "id", "left_semi").distinct()
    extra = staged(dated, "dates")
    raw = queries.select("qid", tx.tokenize(F.col("text")).alias("raw"), tx.strict_constraints(F.col("text")).alias("constraints"))
    raw = raw.withColumn("n_meaningful", F.size(F.array_distinct(F.filter("raw", lambda t: ~t.isin(*tx.stop_list())))))
    # words by stem
    known = index.terms.select("term", "stem").unionByName(stems(extra))
    wanted = staged(known.join(asked.select("stem").distinct(), "stem", "left_semi").distinct(), "wanted")
    few = wanted.count() <= SENT_TERMS
    sent = F.broadcast(wanted) if few else wanted
    said = index.postings.select("id", "term").join(sent, "term").join(ids, "id", "left_semi").select("id", "stem").unionByName(extra.join(wanted, "term").select("id", "stem"))
    have = staged(said.distinct(), "stems")
    hit = pairs.join(have, "id").join(asked, ["qid", "stem"]).groupBy("qid", "id").agg(F.sum("weight").alias("w"), F.count("*").alias("matched"))
    total = weights.groupBy("qid").agg(F.sum("weight").alias("total"))
    # one word must stand as it is; years and quoted strings must stand in the text
    one = raw.where(F.size("raw") == 1).select("qid", F.col("raw")[0].alias("term"))
    alone = index.postings.select("id", "term").unionByName(extra).join(F.broadcast(one) if few else one, "term").join(pairs, ["qid", "id"]).select("qid", "id").distinct().withColumn("stands", F.lit(True))
    # written, so that its size is known before the texts are read: few such pairs are sent to them
    strict = staged(pairs.join(raw.where((F.size("raw") != 1) & (F.size("constraints") > 0)).select("qid", "constraints"), "qid"), "strict")
    text = chunks.select("id", F.lower(evidence_text(F.col("document"), F.col("title"), F.col("date"))).alias("low"))
    broken = strict.join(text, "id").where(~F.forall("constraints", lambda c: F.contains(F.col("low"), c))).select("qid", "id", F.lit(True).alias("broken"))
    rows = pairs.join(raw.select("qid", F.size("raw").alias("n_raw"), "n_meaningful"), "qid").join(total, "qid", "left").join(hit, ["qid", "id"], "left").join(alone, ["qid", "id"], "left").join(broken, ["qid", "id"], "left")
    rows = rows.withColumns({"coverage": F.coalesce(F.round(F.col("w") / F.col("total"), 6), F.lit(0.0)), "matched": F.coalesce("matched", F.lit(0))})
    enough = F.col("broken").isNull() & (F.col("coverage") >= MIN_COVERAGE) & (F.col("matched") >= F.when(F.col("n_meaningful") == 1, 1).otherwise(2))
    return rows.select("qid", "id", "coverage", "matched", F.when(F.col("n_raw") == 1, F.col("stands").isNotNull()).otherwise(enough).alias("passes"))


def representatives(candidates: DataFrame) -> DataFrame:
    """(qid, source_key, id, passes, n_siblings) of each source among (qid, source_key, id, leg, pos, passes): its best
    hit if that is evidence, else its first hit that is, vector hits first; else its best hit all the same."""
    once = candidates.groupBy("qid", "source_key", "id").agg(F.min(F.struct("leg", "pos")).alias("at"), F.max("passes").alias("passes"))
    w = Window.partitionBy("qid", "source_key")
    lead = once.withColumn("lead", F.row_number().over(w.orderBy("at", "id")) == 1).withColumn("n", F.count("*").over(w))
    order = w.orderBy((F.col("passes") & F.col("lead")).desc(), F.col("passes").desc(), F.col("lead").desc(), "at", "id")
    return lead.withColumn("k", F.row_number().over(order)).where("k = 1").select("qid", "source_key", "id", "passes", (F.col("n") - 1).alias("n_siblings"))


def rerank(fused: DataFrame, scores: Callable[[DataFrame], DataFrame], alpha: float = RERANK_ALPHA, n: int = RERANK_TOP) -> DataFrame:
    """``fused`` (qid, source_key, rrf, ...) with ``final_rank``: the first ``n`` in the order of rerank score and fused
    score over its maximum, the rest as they were. ``scores`` adds ``rerank_score`` to the rows that it is given."""
    ranked = fused.withColumn("fused_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("rrf").desc(), "source_key")))
    head = scores(ranked.where(F.col("fused_rank") <= n))
    share = F.col("rrf") / F.max("rrf").over(Window.partitionBy("qid"))
    blended = head.withColumn("blend", F.round(alpha * F.col("rerank_score") + (1 - alpha) * F.when(F.max("rrf").over(Window.partitionBy("qid")) > 0, share).otherwise(1.0), 6))
    tail = ranked.where(F.col("fused_rank") > n).withColumns({"rerank_score": F.lit(None).cast("double"), "blend": F.lit(None).cast("double")})
    both = blended.unionByName(tail.select(*blended.columns))
    order = Window.partitionBy("qid").orderBy(F.col("blend").isNull(), F.col("blend").desc(), "fused_rank")
    return both.withColumn("final_rank", F.row_number().over(order))


def merge_variants(hits: DataFrame, k: int) -> DataFrame:
    """(qid, source_key, score, variant, rank) of (qid, variant, rank, source_key): a source counts by its best rank in any
    variant, the first variant wins ties."""
    best = hits.groupBy("qid", "source_key").agg(F.min(F.struct("rank", "variant")).alias("b"))
    scored = best.select("qid", "source_key", F.round(1 / (RRF_K + F.col("b.rank")), 6).alias("score"), F.col("b.variant").alias("variant"), F.col("b.rank").alias("best"))
    return top(scored, [F.col("best"), F.col("variant"), F.col("source_key")], k).drop("best")


def packed(sizes: Column, budget: int) -> Column:
    """For each of an array of sizes whether it is packed: in order, one that would overflow is skipped and later ones may still fit."""
    state = F.aggregate(
        sizes, F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("kept")),
        lambda s, x: F.struct(
            F.when(s["used"] + x <= budget, s["used"] + x).otherwise(s["used"]).alias("used"), F.concat(s["kept"], F.array(s["used"] + x <= budget)).alias("kept")
        ),
    )
    return state["kept"]


#: What a failed vector search is called in a result, and failures that are the store's and so never hidden.
DEGRADED = "vector_search_failed"
# Fixed values.
STORE_ERRORS = ("stale", "does not exist", "not found", "error finding id")


def vector_leg(search: Callable[[], DataFrame], lexical: DataFrame) -> tuple[DataFrame, str | None, str | None]:
    """The vector hits, worked out now; where that fails no hits, the word for it and the error: the words alone answer then.

    A failure that says that the store itself is stale or gone isn't hidden.
    """
    try:
        return staged(search(), "dense"), None, None
    except Exception as e:
        if any(x in str(e).lower() for x in STORE_ERRORS):
            raise
        none = lexical.where(F.lit(False)).select("qid", "id", "source_key", F.lit(0.0).alias("similarity"))
        return none, DEGRADED, str(e).splitlines()[0] if str(e) else type(e).__name__


def envelope(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, text, status, n_results, answer, returned_tokens) of each question: results with their texts, then candidates by title.

    hits: (qid, bucket, position, id, kind, title, project, date, document).
    """
    name = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))
    title = name("title", "(untitled)")
    full = F.concat(F.lit("["), name("kind", "doc"), F.lit("] "), title, F.lit(" | project: "), name("project", "?"), F.lit(" | date: "), name("date", "?"), F.lit(" | id: "), F.col("id"), F.lit("\n"), F.coalesce("document", F.lit("")))
    is_result = F.col("bucket") == "result"
    line = F.when(is_result, full).otherwise(F.concat(F.lit("- "), title, F.lit(" ("), F.col("id"), F.lit(")")))
    shown = hits.withColumn("line", line).groupBy("qid").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((~is_result).alias("later"), "position", "line"))), lambda x: x["line"]), "\n").alias("answer"),
        F.count_if(is_result).alias("n_results"), F.sum(F.when(is_result, tx.estimated_tokens(F.col("document"))).otherwise(0)).alias("returned_tokens"),
    )
    none = F.coalesce("n_results", F.lit(0))
    return queries.join(shown, "qid", "left").select(
        "qid", "text", F.when(none > 0, "ok").otherwise("insufficient_evidence").alias("status"), none.alias("n_results"), F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("returned_tokens", F.lit(0)).cast("long").alias("returned_tokens")
    )


def lines_with_siblings(hits: DataFrame, by: list[Column], similarity: Column, shown: int = 3) -> DataFrame:
    """(qid, source_key, id, line): each source's best hit in words, with the openings of its next ``shown`` hits and how many more
    there are. hits: (qid, source_key, id, kind, title, project, document, ...)."""
    w = Window.partitionBy("qid", "source_key")
    placed = hits.withColumn("__pos", F.row_number().over(w.orderBy(*by, "id"))).withColumn("__n", F.count("*").over(w))
    sibling = F.concat(F.lit("  - "), F.col("id"), F.lit(": "), F.left("document", F.lit(60)), F.lit("..."))
    near = placed.where(F.col("__pos") <= shown + 1).groupBy("qid", "source_key").agg(
        F.min_by(F.struct("id", F.concat(F.lit("["), F.col("kind"), F.lit("] "), F.col("title"), F.lit(" | project: "), F.col("project"), F.lit(" | similarity: "), F.format_string("%.2f", similarity), F.lit(" | id: "), F.col("id")).alias("head")), "__pos").alias("best"),
        F.sort_array(F.collect_list(F.when(F.col("__pos") > 1, F.struct("__pos", sibling.alias("line"))))).alias("rest"), F.max("__n").alias("n"),
    )
    rest = F.transform("rest", lambda x: x["line"])
    more = F.when(F.col("n") - 1 > shown, F.array(F.concat(F.lit("  - (... +"), (F.col("n") - 1 - shown).cast("string"), F.lit(")")))).otherwise(F.array().cast("array<string>"))
    return near.select("qid", "source_key", "best.id", F.array_join(F.concat(F.array("best.head"), rest, more), "\n").alias("line"))


def pack_context(hits: DataFrame, candidates: DataFrame, namespaces: tuple[str, ...], max_chars: int, most: int) -> DataFrame:
    """(qid, project, role, position, record): hits in order and then up to ``most`` candidates, as JSON records under a budget
    of ``max_chars``; one that would overflow is left out (``truncated``), later ones may still fit.

    Both: (qid, position, project, record: string). A row of another project than ``namespaces`` is an error.
    """
    both = hits.withColumn("role", F.lit("hit")).unionByName(candidates.where(F.col("position") <= most).withColumn("role", F.lit("candidate")))
    outside = F.when(~F.coalesce(F.col("project").isin(*namespaces), F.lit(False)), F.raise_error("a result is of another project")).otherwise(F.col("project"))
    rows = both.select("qid", outside.alias("project"), "role", "position", "record")
    packs = rows.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct((F.col("role") == "candidate").alias("later"), "position", "project", "role", "record"))).alias("h"))
    sizes = F.transform("h", lambda x: (F.length(x["record"]) + 2).cast("long"))
    kept = packs.select("qid", F.explode(F.arrays_zip("h", packed(sizes, max_chars).alias("k"))).alias("z"))
    return kept.select("qid", "z.h.project", "z.h.role", "z.h.position", "z.h.record", (~F.col("z.k")).alias("truncated"))
