"""The front's tools, model slots, reports and services."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import SearchEngine
from ..functions import models
from ..functions import text as tx
from ..operators import dense, lexical, retrieval, store
from ..sources import exports
from ..staging import scratch, staged
from .base import Data, query, sql
from .search_queries import _OVERLAP


@query("save_memory", """SELECT text AS document, 'T' || doc_id AS title, CASE lang WHEN 'en' THEN 'decision' WHEN 'fr' THEN 'summary' ELSE 'note' END AS kind, CASE WHEN doc_id % 3 = 0 THEN 'alpha' ELSE 'shared' END AS project,
 'save_memory' AS source, CAST(greatest(1, length(text) // 4) AS INTEGER) AS est_tokens, strftime(current_date, '%Y-%m-%d') AS date FROM documents""")
def _(d: Data) -> DataFrame:
    """Documents as notes: of known and unknown kinds, for all and for the current project."""
    e = SearchEngine(d.spark, scratch(d.spark, "kb"), "alpha", dimension=8)
    kind = F.when(F.col("lang") == "en", "decision").when(F.col("lang") == "fr", "summary").when(F.col("lang") == "de", "odd")
    e.save_memories(d.table("documents").select(F.col("text").alias("content"), F.concat(F.lit("T"), "doc_id").alias("title"), kind.alias("kind"), F.lit("").alias("tags"), F.lit("").alias("author"), (F.col("doc_id") % 3 == 0).alias("private")))
    return e.chunks().select("document", "title", "kind", "project", "source", "est_tokens", "date")


@query("delete_by_id", sql("SELECT id, project FROM chunks WHERE id NOT IN ('doc_1', 'doc_7')"))
def _(d: Data) -> DataFrame:
    e = SearchEngine(d.spark, scratch(d.spark, "kb"), dimension=8)
    e.upsert(d.chunks.drop("doc_id"))
    e.delete("doc_1", "doc_7", "doc_absent")
    return e.chunks().select("id", "project")


@query("html_escape", "SELECT page_id, replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages")
def _(d: Data) -> DataFrame:
    return d.table("pages").select("page_id", tx.html_escape(F.col("html")).alias("escaped"))


@query("report_figures", "SELECT source, format('{:,}', sum(n_chars)) AS chars, printf('%.1f%%', 100.0 * count(*) / (SELECT count(*) FROM documents)) AS share FROM documents GROUP BY source")
def _(d: Data) -> DataFrame:
    docs = d.table("documents")
    whole = docs.agg(F.count("*").alias("whole"))
    counted = docs.groupBy("source").agg(F.sum("n_chars").alias("chars"), F.count("*").alias("n")).crossJoin(F.broadcast(whole))
    return counted.select("source", tx.thousands(F.col("chars")).alias("chars"), tx.percent(F.col("n"), F.col("whole")).alias("share"))


@query("report_files", "SELECT '# Languages' AS line UNION ALL SELECT '' UNION ALL SELECT '| lang | n |' UNION ALL SELECT '| --- | --- |' UNION ALL SELECT '| ' || lang || ' | ' || count(*) || ' |' FROM documents GROUP BY lang")
def _(d: Data) -> DataFrame:
    """A report goes to files; the Markdown is read again."""
    path = scratch(d.spark, "report")
    exports.write_report(d.table("documents").groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang"), path, "Languages")
    return d.spark.read.text(f"{path}/report.md").select(F.col("value").alias("line"))


@query("stale_processes", "SELECT event_id FROM events WHERE epoch((SELECT max(ts) FROM events)) - epoch(ts) > 3600")
def _(d: Data) -> DataFrame:
    events = d.table("events").select("event_id", F.col("ts").alias("started"))
    now = events.agg(F.max("started").alias("now"))
    return store.stale(events.crossJoin(F.broadcast(now)), F.col("now")).select("event_id")


@query("pending_retry", """SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'store' ELSE 'index' END AS origin FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 4 = 0""")
def _(d: Data) -> DataFrame:
    """Keys whose writing was put off are written from the store; pending keys that the store lacks leave the index."""
    ids = d.table("documents").select(F.col("doc_id").alias("id"))
    live = ids.select("id", F.lit("store").alias("origin"))
    index = ids.where("id % 3 <> 0").unionByName(ids.select((F.col("id") + 1_000_000).alias("id")).where("id % 5 = 0")).select("id", F.lit("index").alias("origin"))
    pending = ids.where("id % 4 = 0").unionByName(ids.select((F.col("id") + 1_000_000).alias("id")))
    return store.retry_pending(index, pending, live)[0]


@query("score_pairs", sql(f"SELECT q.qid, c.id, round({_OVERLAP}, 6) AS rerank_score FROM kwtop k JOIN queries q USING (qid) JOIN chunks c USING (id) WHERE k.rank <= 10"))
def _(d: Data) -> DataFrame:
    hits = lexical.keyword_topk(d.queries, d.words, 10).select("qid", "id")
    pairs = hits.join(d.queries.select("qid", F.col("text").alias("question")), "qid").join(d.chunks.select("id", F.col("document").alias("text")), "id")
    return models.score_pairs(pairs).select("qid", "id", F.round("rerank_score", 6).alias("rerank_score"))


@query("vector_topk_ip", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS rank FROM (
 SELECT q.vec_id AS qid, e.vec_id AS id, round(list_dot_product(q.embedding::DOUBLE[], list_transform(e.embedding, lambda x: x::DOUBLE * (1 + e.vec_id % 3))), 6) AS similarity
 FROM (SELECT * FROM embeddings JOIN benchmark ON vec_id = item_id) q CROSS JOIN embeddings e) WHERE similarity >= 0.1) WHERE rank <= 50""")
def _(d: Data) -> DataFrame:
    """Vectors of other than unit length, by inner product."""
    scaled = d.vectors.select("id", F.transform("vector", lambda x: x.cast("double") * (1 + F.col("id") % 3)).alias("vector"))
    return dense.vector_topk(d.query_vectors, scaled, space="ip")


@query("nothing_asked", sql("SELECT 0 AS n_empty_question, 0 AS n_empty_index, count(*) AS n_terms FROM (SELECT DISTINCT term FROM qterms)"))
def _(d: Data) -> DataFrame:
    """An empty question finds nothing, and so does any question of an empty index."""
    blank = d.queries.select("qid", F.lit("  ?! ").alias("text"))
    one = lexical.keyword_topk(blank, d.words).agg(F.count("*").alias("n_empty_question"))
    two = lexical.keyword_topk(d.queries, d.kw_docs.where("false")).agg(F.count("*").alias("n_empty_index"))
    return one.crossJoin(two).crossJoin(lexical.query_terms(d.queries).agg(F.count_distinct("term").alias("n_terms")))


_SPACES = ("src1", "src2", "src3")
_IN = "('src1', 'src2', 'src3')"
_RECORD = "CAST(to_json({'id': id, 'title': title, 'project': project, 'text': document}) AS VARCHAR)"
_BRIEF = "CAST(to_json({'id': id, 'title': title, 'project': project}) AS VARCHAR)"


@query("context_namespaces", sql(f"""SELECT qid, project, role, position, NOT list_contains(kept, n) AS truncated FROM (SELECT *, list_reduce(list_prepend({{'used': 0::BIGINT, 'kept': []::BIGINT[]}}, list_transform(sizes, lambda x, i: {{'used': x, 'kept': [i]::BIGINT[]}})),
  lambda s, x: CASE WHEN s.used + x.used <= 10000 THEN {{'used': s.used + x.used, 'kept': list_concat(s.kept, x.kept)}} ELSE s END).kept AS kept
 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY later, position) AS n, list(length(record) + 2) OVER (PARTITION BY qid ORDER BY later, position ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS sizes FROM (
  SELECT qid, project, rank AS position, false AS later, 'hit' AS role, {_RECORD} AS record FROM allowed WHERE rank <= 5 UNION ALL SELECT qid, project, rank - 5, true, 'candidate', {_BRIEF} FROM allowed WHERE rank > 5 AND rank <= 8)))""".replace(
    "FROM allowed", f"FROM (SELECT b.qid, c.*, row_number() OVER (PARTITION BY b.qid ORDER BY score, c.id) AS rank FROM bm25 b JOIN chunks c USING (id) WHERE project IN {_IN})")))
def _(d: Data) -> DataFrame:
    """Hits of three namespaces with their texts, then three candidates by title, under a budget of characters."""
    open_ = d.chunks.where(F.col("project").isin(*_SPACES))
    hits = staged(lexical.keyword_topk(d.queries, d.index, 50, open_.select("id")).select("qid", "id", "rank").join(open_, "id"), "open")
    full, brief = (F.to_json(F.struct("id", "title", "project", *more)) for more in ([F.col("document").alias("text")], []))
    found = hits.where("rank <= 5").select("qid", F.col("rank").alias("position"), "project", full.alias("record"))
    others = hits.where("rank > 5").select("qid", (F.col("rank") - 5).alias("position"), "project", brief.alias("record"))
    return retrieval.pack_context(found, others, _SPACES, 10_000, 3).select("qid", "project", "role", "position", "truncated")
