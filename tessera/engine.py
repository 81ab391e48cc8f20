"""The library's front: a store of chunks that is written, listed and searched."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import identity as ids
from .constants import CHUNK, CONTEXT_CANDIDATES, CONTEXT_CHARS, KINDS, OPEN_NAMESPACES, RERANK_TOP, RESERVED_SCOPES, VECTOR_CANDIDATES
from .functions import models
from .functions.text import estimated_tokens
from .operators import dense, lexical, policy, retrieval, segments, snapshots, store
from .session import prepare
from .staging import staged

#: What a snapshot holds of a chunk: its columns, the words that it is found by and its vector, both made when it is written.
STORED = T.StructType([*CHUNK.fields, T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("vector", T.ArrayType(T.FloatType()))])
IDENTITY = "_identity.json"


def _words(rows: DataFrame) -> DataFrame:
    """What the index has of stored rows."""
    parent = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("parent_id", "shortcode", "source")), F.lit(""))
    return rows.select("id", "project", "kind", parent.alias("parent_id"), F.size("tokens").cast("long").alias("token_count"), "tokens")


class SearchEngine:
    """Chunks below ``root`` and the index of their words, in segments: a write adds what it brings and no more. Of two writers
    at once one gets a ``Conflict``; readers never wait.

    The first write states whose vectors the store holds (``identity``); an engine with another model can neither write nor
    search by vectors.
    """

    def __init__(self, spark: SparkSession, root: str, current_project: str = "shared", embedder: str = "hashed", **options):
        self.spark, self.root, self.project = prepare(spark), root, current_project
        self.embedder, self.options = embedder, options
        self.folder = snapshots.Folder(spark, root)
        self.store = segments.Store(spark, root, STORED, words=_words)

    # ---- the store

    @property
    def identity(self) -> ids.Identity:
        """Of the model in use."""
        return models.identity_of(self.embedder, **self.options)

    def check_identity(self) -> None:
        """Raise unless the store is new or holds vectors of the model in use."""
        if self.folder.exists(IDENTITY):
            ids.agree(ids.parse(json.loads(self.folder.read(IDENTITY))), self.identity)

    def chunks(self) -> DataFrame:
        return self.store.rows()

    def _completed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with all columns of the store; words and vectors are made for these rows alone. A row without id is an error."""
        have = [f for f in CHUNK.fields if f.name in rows.columns]
        missing = {f.name: F.lit(None).cast(f.dataType) for f in CHUNK.fields if f not in have}
        whole = rows.select(*(F.col(f.name).cast(f.dataType) for f in have))
        named = F.when(F.col("id").isNull(), F.raise_error("a chunk without id")).otherwise(F.col("id"))
        whole = store.last_of_each(whole.withColumn("id", named), "id").withColumns(missing)
        return models.embedded(whole.withColumn("tokens", lexical.tokens_of(whole)), "vector", self.embedder, **self.options).select(*STORED.names)

    def _write(self, rows: DataFrame | None, bury: DataFrame | None = None, based_on: int | None = None) -> segments.Segment:
        """One segment more; where there are too many by now, the last ones become one, and lists but the last few go."""
        made = self.store.write(rows, bury, based_on=based_on)
        if self.store.compact() is not None:
            self.store.retain()
        return made

    def upsert(self, rows: DataFrame) -> segments.Segment:
        """Rows of the chunk schema (missing columns are null) in place of those of equal id."""
        self.check_identity()
        if not self.folder.exists(IDENTITY):
            self.folder.put(IDENTITY, json.dumps(self.identity.as_dict(), sort_keys=True))
        return self._write(self._completed(rows))

    def replace_sources(self, rows: DataFrame, sources: Sequence[str]) -> None:
        """``rows`` are all that ``sources`` hold now: what they held before and lack now goes, even where nothing is left."""
        self.check_identity()
        based_on = self.store.version
        made = staged(self._completed(rows), "replaced")
        read = self.spark.createDataFrame([(x,) for x in sources], "source string").unionByName(made.select("source")).distinct()
        self._write(made, self.chunks().select("id", "source").join(read, "source", "left_semi").select("id"), based_on)

    def rollback(self) -> int:
        """Publish what was current before the last write again; its version."""
        return self.store.rollback()

    def save_memories(self, notes: DataFrame) -> segments.Segment:
        """Store notes (content, title, kind, tags, author, private; id if they have one) as one segment: an unknown kind is a note, a
        private note stays in the current project."""
        new = F.concat(F.lit("mem_"), F.left(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit(12)))
        return self.upsert(notes.select(
            (F.col("id") if "id" in notes.columns else new).alias("id"), F.col("content").alias("document"), "title", F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("note").alias("kind"), "tags", "author",
            F.lit("save_memory").alias("source"), F.when(F.col("private"), self.project).otherwise("shared").alias("project"), F.lit(datetime.now(timezone.utc).strftime("%Y-%m-%d")).alias("date"),
            estimated_tokens(F.coalesce("content", F.lit(""))).alias("est_tokens"),
        ))

    def save_memory(self, content: str, title: str, kind: str = "note", tags: str = "", author: str = "", private: bool = False) -> str:
        """Store one note and return its id, as :func:`save_memories` does with many."""
        row = (f"mem_{uuid.uuid4().hex[:12]}", content, title, kind, tags, author, private)
        self.save_memories(self.spark.createDataFrame([row], "id string, content string, title string, kind string, tags string, author string, private boolean"))
        return row[0]

    def list_memories(self, limit: int = 20) -> DataFrame:
        return store.newest(self.chunks().where(F.col("source") == "save_memory"), limit)

    def fetch(self, id: str) -> DataFrame:
        return self.chunks().where(F.col("id") == id)

    def delete(self, *chunk_ids: str) -> int:
        """Delete by id; how many went."""
        return self._delete(F.col("id").isin(*chunk_ids))

    def delete_by_shortcode(self, code: str) -> int:
        return self._delete(F.col("shortcode").eqNullSafe(code))

    def _delete(self, condition) -> int:
        based_on = self.store.version
        return self._write(None, self.chunks().where(condition).select("id"), based_on).dead

    def health(self) -> DataFrame:
        return store.health(self.spark, self.root, tuple(STORED.names), lambda: self.chunks() if self.store.version else None)

    # ---- search

    def _allowed(self, kind: str, project: str, projects: Sequence[str] | None) -> DataFrame:
        scope = {"project": {"$in": list(projects)}} if projects else policy.scope(project, self.project, kind)
        usable = ~F.coalesce(F.lower(F.trim("usable")).isin("false", "0", "no"), F.lit(False))
        rows = self.chunks().where(policy.where(scope) & usable)
        return rows.withColumn("source_key", policy.source_key({c: F.col(c) for c in ("id", "shortcode", "parent_id", "canonical_id", "source")}))

    def search(self, questions: Sequence[str], top_k: int = 5, kind: str = "", project: str = "current", projects: Sequence[str] | None = None, reranker: str | None = None, rerank_budget: float = 3.0) -> DataFrame:
        """(qid, bucket, position, source_key, id, title, document, rrf, n_siblings, degraded, rerank, rerank_reason): evidence
        first, the rest as related.

        Questions are rewritten into at most two variants; a source counts by its best rank in any of them. A question
        without results has insufficient evidence and no row in bucket ``result``. Where vectors can't be searched the words
        alone answer, and ``degraded`` says so. With a ``reranker`` the first sources' texts are scored against the question;
        if that fails or takes more than ``rerank_budget`` seconds the order stays, and ``rerank`` is ``unavailable``.
        """
        self.check_identity()
        keyed = self._allowed(kind, project, projects)
        variants = [(q * 2 + v, q, v, t) for q, question in enumerate(questions) for v, t in enumerate(policy.query_variants(question))]
        asked = self.spark.createDataFrame([(i, t) for i, _, _, t in variants], "qid long, text string")
        found = self.store.index(lexical.query_terms(asked).select("term").distinct())
        words_of = replace(found, postings=staged(found.postings, "postings"), terms=staged(found.terms, "terms"), stats=staged(found.stats, "stats"))
        words = lexical.keyword_topk(asked, words_of, allowed=keyed.select("id")).join(keyed.select("id", "source_key"), "id").select("qid", "id", "source_key", "score")
        words = staged(words, "words")

        def by_vectors() -> DataFrame:
            probes = models.embed(asked, self.embedder, "text", "qid", **self.options).select(F.col("id").cast("long").alias("qid"), F.col("embedding").alias("vector"))
            hits = dense.vector_topk(probes, keyed.select("id", "vector"), k=max(VECTOR_CANDIDATES, 5 * top_k), id_type="string")
            return hits.join(keyed.select("id", "source_key"), "id").select("qid", "id", "source_key", "similarity")

        near, degraded, _ = retrieval.vector_leg(by_vectors, words)
        legs = near.select("qid", "id", "source_key", F.lit(0).alias("leg"), (-F.col("similarity")).alias("pos")).unionByName(words.select("qid", "id", "source_key", F.lit(1).alias("leg"), F.col("score").alias("pos")))
        gate = retrieval.gate_hits(asked, legs, keyed, words_of).select("qid", "id", "passes")
        chosen = staged(retrieval.representatives(legs.join(gate, ["qid", "id"])).join(retrieval.rrf(near, words), ["qid", "source_key"]), "chosen")
        chosen, rerank, reason = self._reranked(chosen, asked, keyed, reranker, rerank_budget)
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("passes").desc(), "final_rank"))
        one = chosen.withColumn("place", place).withColumn("question", F.floor(F.col("qid") / 2))
        best = one.withColumn("n", F.row_number().over(Window.partitionBy("question", "source_key").orderBy(F.col("passes").desc(), "place", "qid"))).where("n = 1")
        final = F.row_number().over(Window.partitionBy("question").orderBy(F.col("passes").desc(), "place", "qid", "source_key"))
        bucket = F.when(F.col("passes") & (F.col("position") <= policy.clamp_top_k(top_k)), "result").otherwise("related")
        out = best.withColumn("position", final).select(F.col("question").alias("qid"), bucket.alias("bucket"), "position", "source_key", "id", "rrf", "n_siblings")
        said = [F.lit(x).cast("string").alias(n) for n, x in (("degraded", degraded), ("rerank", rerank), ("rerank_reason", reason))]
        return out.join(keyed.select("id", "title", "document", "kind", "project", "source", "date"), "id").select("qid", "bucket", "position", "source_key", "id", "title", "document", "rrf", "n_siblings", "kind", "project", "source", "date", *said)

    def _reranked(self, chosen: DataFrame, asked: DataFrame, keyed: DataFrame, reranker: str | None, budget: float) -> tuple[DataFrame, str, str | None]:
        """``chosen`` with final_rank, whether it was reranked, and why not."""
        fused = chosen.withColumn("final_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("rrf").desc(), "source_key")))
        if reranker is None:
            return fused, "off", None
        head = fused.where(F.col("final_rank") <= RERANK_TOP).select("qid", "id")
        pairs = head.join(asked.select("qid", F.col("text").alias("question")), "qid").join(keyed.select("id", F.col("document").alias("text")), "id")
        scores, reason = models.score_within(pairs.select("qid", "id", "question", "text"), reranker, budget)
        if scores is None:
            return fused, "unavailable", reason
        ranked = retrieval.rerank(chosen, lambda rows: rows.join(scores, ["qid", "id"]))
        return ranked.select(*fused.columns), "on", None

    def search_knowledge(self, questions: Sequence[str], top_k: int = 5, related: int = 5, **how) -> DataFrame:
        """(qid, text, status, n_results, answer, returned_tokens, whole_tokens, degraded): one row a question, with the tokens of
        its results and of the documents that they come from."""
        hits = staged(self.search(questions, top_k, **how), "hits")
        asked = self.spark.createDataFrame(list(enumerate(questions)), "qid long, text string")
        shown = retrieval.envelope(asked, hits.where((F.col("bucket") == "result") | (F.col("position") <= related)))
        keyed = self._allowed(how.get("kind", ""), how.get("project", "current"), how.get("projects"))
        sizes = keyed.groupBy("source_key").agg(F.sum(F.coalesce(F.col("est_tokens").cast("long"), F.greatest(F.lit(1), F.floor(F.length("document") / 4)))).alias("t"))
        whole = hits.where("bucket = 'result'").join(sizes, "source_key").groupBy("qid").agg(F.sum("t").alias("whole_tokens"))
        marks = hits.groupBy("qid").agg(F.max("degraded").alias("degraded"))
        return shown.join(whole, "qid", "left").join(marks, "qid", "left").withColumn("whole_tokens", F.coalesce("whole_tokens", F.lit(0)))

    def context(self, question: str, project: str, top_k: int = 5, max_chars: int = CONTEXT_CHARS) -> DataFrame:
        """(project, role, position, record, truncated): results of a project and of the open namespaces as JSON records, then
        candidates without their texts, packed into a budget of characters."""
        if project in RESERVED_SCOPES:
            raise ValueError(f"{project!r} is no project")
        namespaces = tuple(dict.fromkeys((project, *OPEN_NAMESPACES)))
        hits = staged(self.search([question], top_k, projects=namespaces), "hits")
        fields = ["id", "title", "project", "source", "date", "source_key"]
        brief = F.to_json(F.struct(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in fields)))
        full = F.to_json(F.struct(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in fields), F.coalesce("document", F.lit("")).alias("text"), F.lit(question).alias("matched_query")))
        found = hits.where("bucket = 'result'").select("qid", "position", "project", full.alias("record"))
        n = F.row_number().over(Window.partitionBy("qid").orderBy("position"))
        others = hits.where("bucket = 'related'").select("qid", n.alias("position"), "project", brief.alias("record"))
        return retrieval.pack_context(found, others, namespaces, max_chars, CONTEXT_CANDIDATES).drop("qid")
