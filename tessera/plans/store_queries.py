"""Mutation, synchronisation and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, lexical, snapshots, store, tree
from ..staging import scratch
from .base import Data, query, sql


def _manifest(d: Data, old: bool) -> DataFrame:
    """Two states of a corpus: the old one lacks some rows and has others, and some texts have changed since."""
    docs = d.table("documents")
    rows = docs.where("doc_id % 10 <> 1") if old else docs.where("doc_id % 10 <> 2")
    text = F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")) if not old else F.col("text")
    return rows.select(F.col("doc_id").alias("id"), *store.content_hashes(text, {"source": F.col("source")}))


_OLD = "SELECT doc_id AS id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 1"
_NEW = "SELECT doc_id AS id, sha256(CASE WHEN doc_id % 10 = 3 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 2"


@query("upsert_merge", "SELECT doc_id AS id, CASE WHEN doc_id % 10 = 3 THEN 'new2' ELSE 'old' END AS state, CASE WHEN doc_id % 10 = 3 THEN 2 ELSE 0 END AS at FROM documents WHERE doc_id % 10 <> 4 UNION ALL SELECT doc_id + 1000000, 'new2', 2 FROM documents WHERE doc_id % 50 = 0")
def _(d: Data) -> DataFrame:
    """Every new row comes twice; the later one counts."""
    ids = d.table("documents").select(F.col("doc_id").alias("id"))
    target = ids.where("id % 10 <> 4").select("id", F.lit("old").alias("state"), F.lit(0).alias("at"))
    new = ids.where("id % 10 = 3").unionByName(ids.where("id % 50 = 0").select((F.col("id") + 1_000_000).alias("id")))
    twice = new.select("id", F.lit("new2").alias("state"), F.lit(2).alias("at")).unionByName(new.select("id", F.lit("new1").alias("state"), F.lit(1).alias("at")))
    return store.upsert(target, twice, order="at")


@query("delete_where", "SELECT doc_id AS id FROM documents WHERE source <> 'src3' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def _(d: Data) -> DataFrame:
    docs = d.table("documents").select(F.col("doc_id").alias("id"), "source")
    return store.delete(docs, d.table("labels").where("quality = 0").select(F.col("doc_id").alias("id")), F.col("source") == "src3").select("id")


@query("replace_source", "SELECT doc_id AS id, source, 'old' AS state FROM documents WHERE source NOT IN ('src1', 'src2', 'src3') UNION ALL SELECT doc_id, source, 'new' FROM documents WHERE source IN ('src1', 'src2') AND doc_id % 2 = 0")
def _(d: Data) -> DataFrame:
    """Three sources were read again: two have half of their rows left, one became empty."""
    docs = d.table("documents").select(F.col("doc_id").alias("id"), "source")
    new = docs.where("source IN ('src1', 'src2') AND id % 2 = 0").withColumn("state", F.lit("new"))
    read = d.spark.createDataFrame([("src1",), ("src2",), ("src3",)], "source string")
    return store.replace_source(docs.withColumn("state", F.lit("old")), new, sources=read)


@query("prune_missing", "SELECT doc_id AS id FROM documents WHERE source IN (SELECT source FROM documents WHERE doc_id < 20)")
def _(d: Data) -> DataFrame:
    docs = d.table("documents").select(F.col("doc_id").alias("id"), "source")
    return store.prune(docs, docs.where("id < 20")).select("id")


@query("delete_by_shortcode", "SELECT doc_id AS id FROM documents WHERE doc_id % 7 <> 2")
def _(d: Data) -> DataFrame:
    """All chunks of a code go; chunks without one stay."""
    code = F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("S"), (F.col("doc_id") % 7).cast("string"))).otherwise(F.when(F.col("doc_id") % 7 == 2, "S2"))
    docs = d.table("documents").select(F.col("doc_id").alias("id"), code.alias("shortcode"))
    return store.delete(docs, condition=F.col("shortcode") == "S2").select("id")


@query("sync_diff", f"SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN 'delete' WHEN o.id IS NULL OR o.h <> n.h THEN 'upsert' ELSE 'unchanged' END AS action FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.id = n.id")
def _(d: Data) -> DataFrame:
    return store.sync_plan(_manifest(d, True), _manifest(d, False))


@query("tree_sync", f"SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN 'delete' ELSE 'upsert' END AS action FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.id = n.id WHERE o.h IS DISTINCT FROM n.h")
def _(d: Data) -> DataFrame:
    """The changes of :func:`sync_diff` by hash trees."""
    return tree.changes(*(tree.build(_manifest(d, old), scratch(d.spark, "tree")) for old in (True, False)))


@query("tree_verify", sql("SELECT CASE doc_id % 10 WHEN 2 THEN 'delete' ELSE 'upsert' END AS action, count(*) AS n, min(id) AS first FROM chunks WHERE doc_id % 10 IN (2, 3, 4) GROUP BY 1"))
def _(d: Data) -> DataFrame:
    """The stored index against a corpus that lacks some rows and has other words or another kind in some: metadata, numbers of words
    and postings are all in the tree."""
    n = F.col("doc_id") % 10
    corpus = d.chunks.where("doc_id % 10 <> 2").withColumns({"document": F.when(n == 3, F.concat(F.coalesce("document", F.lit("")), F.lit(" zzz"))).otherwise(F.col("document")), "kind": F.when(n == 4, "other").otherwise(F.col("kind"))})
    docs = lexical.kw_docs(corpus)
    says = ("meta", "token_count", "words")
    stored = tree.build(tree.index_state(d.index.docs, d.index.postings), scratch(d.spark, "tree"), says=says)
    anew = tree.build(tree.index_state(docs, lexical.postings(docs)), scratch(d.spark, "tree"), says=says)
    return tree.changes(stored, anew).groupBy("action").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query("drift", f'SELECT count(*) FILTER (WHERE o.id IS NULL) AS "new", count(*) FILTER (WHERE o.h <> n.h) AS modified, count(*) FILTER (WHERE n.id IS NULL) AS deleted, count(*) AS total FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.id = n.id')
def _(d: Data) -> DataFrame:
    return store.drift(_manifest(d, True), _manifest(d, False))


@query("anti_missing", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def _(d: Data) -> DataFrame:
    return store.missing(d.table("documents").select(F.col("doc_id").alias("id")), d.vectors)


@query("anti_excess", "SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)")
def _(d: Data) -> DataFrame:
    return store.missing(d.vectors, d.table("documents").select(F.col("doc_id").alias("id")))


@query("reconcile_plan", """SELECT doc_id AS id, 'add' AS action FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, 'drop' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)
 UNION ALL SELECT doc_id, 'rewrite' FROM labels WHERE doc_id IN (SELECT doc_id FROM documents) AND doc_id IN (SELECT vec_id FROM embeddings) AND toxic = 1""")
def _(d: Data) -> DataFrame:
    return store.reconcile(d.table("documents").select(F.col("doc_id").alias("id")), d.vectors, d.table("labels").where("toxic = 1").select(F.col("doc_id").alias("id")))


@query("verify_index", """SELECT 'expected' AS "check", count(*) AS n FROM documents UNION ALL SELECT 'actual', count(*) FROM documents WHERE doc_id % 10 <> 2 UNION ALL SELECT 'missing', count(*) FROM documents WHERE doc_id % 10 IN (2, 3) UNION ALL SELECT 'excess', count(*) FROM documents WHERE doc_id % 10 = 3""")
def _(d: Data) -> DataFrame:
    rows = d.table("documents").select("doc_id", "text")
    actual = rows.where("doc_id % 10 <> 2").select("doc_id", F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return store.verify(rows, actual)


@query("count_diff", f"SELECT coalesce(o.p, n.p) AS project, coalesce(o.n, 0) AS old_n, coalesce(n.n, 0) AS new_n FROM (SELECT source AS p, count(*) AS n FROM documents WHERE doc_id % 10 <> 1 GROUP BY 1) o FULL JOIN (SELECT source AS p, count(*) AS n FROM documents WHERE doc_id % 10 <> 2 GROUP BY 1) n ON o.p = n.p")
def _(d: Data) -> DataFrame:
    docs = d.table("documents").select(F.col("source").alias("project"), "doc_id")
    return docs.groupBy("project").agg(F.count_if(F.col("doc_id") % 10 != 1).alias("old_n"), F.count_if(F.col("doc_id") % 10 != 2).alias("new_n")).where("old_n > 0 OR new_n > 0")


@query("completeness", "SELECT (SELECT count(*) FROM documents WHERE doc_id % 10 <> 2) AS n_manifest, (SELECT count(*) FROM documents) AS n_rows, false AS complete")
def _(d: Data) -> DataFrame:
    ids = d.table("documents").select(F.col("doc_id").alias("id"))
    return audit.completeness(ids.where("id % 10 <> 2"), ids)


@query("sample_check", "SELECT doc_id, sha256(text) AS hash FROM documents ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id LIMIT 50")
def _(d: Data) -> DataFrame:
    """A sample is what this operator is for: the same fifty rows every time, by hash."""
    return d.table("documents").select("doc_id", F.sha2("text", 256).alias("hash")).orderBy(F.sha2(F.col("doc_id").cast("string"), 256), "doc_id").limit(50)


def _built(d: Data) -> tuple[str, DataFrame]:
    """An index of the documents, built with manifest and marker; where it is, and its rows."""
    rows = d.table("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("document"), "source")
    manifest = rows.select("id", *store.content_hashes(F.col("document"), {"source": F.col("source")}))
    root = scratch(d.spark, "store")
    snapshots.build(d.spark, rows, manifest, root, "first", {"model": "hashed", "dimension": 256}, store.corpus_hash(manifest).first()[0])
    return root, rows


@query("index_build", """SELECT 'complete' AS "check", true AS ok UNION ALL SELECT 'counts_agree', true UNION ALL SELECT 'identity_agrees', true UNION ALL SELECT 'other_identity_agrees', false UNION ALL SELECT 'published', true UNION ALL SELECT 'unchanged', true""")
def _(d: Data) -> DataFrame:
    root, rows = _built(d)
    found = snapshots.check(d.spark, root, {"model": "hashed", "dimension": 256})
    found["other_identity_agrees"] = snapshots.check(d.spark, root, {"model": "other"})["identity_agrees"]
    manifest = rows.select("id", *store.content_hashes(F.col("document"), {"source": F.col("source")}))
    found["unchanged"] = snapshots.unchanged(d.spark, root, {"model": "hashed", "dimension": 256}, store.corpus_hash(manifest).first()[0])
    return d.spark.createDataFrame(sorted(found.items()), 'check string, ok boolean')


@query("rollback", "SELECT doc_id AS id, source FROM documents")
def _(d: Data) -> DataFrame:
    """A second snapshot lacks a source; after the rollback all rows are there again."""
    root, rows = _built(d)
    snapshots.commit_snapshot(d.spark, rows.where("source <> 'src1'"), root, "second")
    snapshots.rollback(d.spark, root)
    return snapshots.current_snapshot(d.spark, root).select("id", "source")


@query("repair", "SELECT doc_id AS id, CASE WHEN doc_id % 10 = 3 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 2")
def _(d: Data) -> DataFrame:
    """An index of an old state is brought to the new one by its plan alone."""
    docs = d.table("documents").select(F.col("doc_id").alias("id"), "text")
    new = docs.where("id % 10 <> 2").withColumn("text", F.when(F.col("id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return store.repair(docs.where("id % 10 <> 1"), store.sync_plan(_manifest(d, True), _manifest(d, False)), new)


@query("store_health", "SELECT step, ok FROM (VALUES ('opened', true), ('columns', true), ('counted', true), ('queried', true)) AS t(step, ok)")
def _(d: Data) -> DataFrame:
    return store.health(d.spark, _built(d)[0]).select("step", "ok")


def _audited(d: Data) -> dict[str, DataFrame]:
    docs = d.table("documents")
    archive = d.table("labels").select(F.concat(F.lit("P"), (F.col("doc_id") * 2).cast("string")).alias("shortcode"), (F.col("quality") != 0).alias("usable"), (F.col("doc_id") % 3).alias("n_items"))
    chunks = docs.select(
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("id"), F.when(F.col("doc_id") % 4 != 3, F.concat(F.lit("P"), F.col("doc_id").cast("string"))).alias("shortcode"), (F.col("doc_id") % 5).alias("item"),
        F.concat("source", F.lit("/"), (F.col("doc_id") % 50).cast("string")).alias("source"), (F.length("text") / 5).cast("long").alias("token_count"),
    )
    return audit.findings(archive, chunks)


_A = "SELECT 'P' || (doc_id * 2) AS shortcode, quality <> 0 AS usable, doc_id % 3 AS n_items FROM labels"
_C = "SELECT 'c' || doc_id AS id, CASE WHEN doc_id % 4 <> 3 THEN 'P' || doc_id END AS shortcode, doc_id % 5 AS item, source || '/' || (doc_id % 50) AS source, CAST(floor(length(text) / 5) AS BIGINT) AS token_count FROM documents"
_AUDITS = {
    "usable_not_indexed": "SELECT shortcode AS id FROM a WHERE usable AND shortcode NOT IN (SELECT shortcode FROM c WHERE shortcode IS NOT NULL)",
    "unusable_indexed": "SELECT shortcode AS id FROM a WHERE NOT usable AND shortcode IN (SELECT shortcode FROM c)",
    "orphan_items": "SELECT c.id FROM c JOIN a USING (shortcode) WHERE usable AND item > n_items",
    "missing_archive": "SELECT DISTINCT shortcode AS id FROM c WHERE shortcode IS NOT NULL AND shortcode NOT IN (SELECT shortcode FROM a)",
    "duplicate_files": "SELECT min(id) AS id FROM c WHERE shortcode IS NULL GROUP BY source HAVING count(*) > 1",
    "long_chunks": "SELECT id FROM c WHERE token_count > 256",
}
_WITH = f"WITH a AS ({_A}), c AS ({_C}) "
for _name, _sql in _AUDITS.items():
    query(f"audit_{_name}", _WITH + _sql)(lambda d, n=_name: _audited(d)[n])


@query("audit_summary", _WITH + " UNION ALL ".join(f"""SELECT '{k}' AS "check", count(*) AS n FROM ({v})""" for k, v in _AUDITS.items()))
def _(d: Data) -> DataFrame:
    return audit.summary(_audited(d))
