"""How the engine's concepts are bound to the driver's tables, in Spark and in SQL side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import staging
from ..constants import BM25_B, BM25_K1
from ..functions import text as tx
from ..operators import impacts, index, ivf, lexical, ngrams
from ..session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: (application, directory, kind) -> where its index is.
_INDEXES: dict[tuple[str, ...], str] = {}
#: How the vector index is searched, and neighbours are sought.
IVF_SEARCH = {"probes": 32, "refine": 200}
DESCENT = {"k": 6, "width": 24}


def titled(text: Column) -> Column:
    """The first 40 signs of a text whose runs of spaces are one space each; no more of it is looked at than that takes."""
    start = F.regexp_extract(text, "^(?:[ \t\n\r]++|[^ \t\n\r]){0,40}", 0)
    return F.regexp_replace(start, "[ \t\n\r]+", " ")


class Data:
    """The bound tables of one directory; everything is lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        prepare(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def chunks(self) -> DataFrame:
        d = F.col("doc_id")
        two = lambda c: F.lpad(c.cast("string"), 2, "0")
        return self.table("documents").select(
            F.concat(F.lit("doc_"), d.cast("string")).alias("id"), "doc_id", F.col("text").alias("document"), F.col("source").alias("project"),
            F.when(F.col("lang") == "en", "note").when(F.col("lang") == "fr", "summary").when(F.col("lang") == "de", "decision").otherwise("doc").alias("kind"),
            titled(F.col("text")).alias("title"),
            F.concat(F.lit("p_"), F.floor(d / 4).cast("string")).alias("parent_id"),
            F.concat(F.lit("2026-"), two(d % 12 + 1), F.lit("-"), two(d % 28 + 1)).alias("date"),
        )

    @property
    def queries(self) -> DataFrame:
        """qid, text: the benchmark's items, whole."""
        return self.table("benchmark").select(F.col("item_id").alias("qid"), F.coalesce("text", F.lit("")).alias("text"))

    @property
    def kw_docs(self) -> DataFrame:
        return lexical.kw_docs(self.chunks)

    @property
    def words(self) -> index.Index:
        """The chunks' words and their statistics. They are written at the first use in a session and then read, as an index is."""
        return index.read_words(self.spark, self._stored("words", lambda path: index.of_docs(self.kw_docs).write_words(path)))

    @property
    def index(self) -> index.Index:
        """The stored index of the chunks: postings and terms beside :attr:`words`."""
        return index.read_postings(self.words, self._stored("index", lambda path: self.words.write_postings(path)))

    @property
    def impacts(self) -> impacts.Impacts:
        """The index's postings by impact, stored likewise."""
        return impacts.read(self.spark, self._stored("impacts", lambda path: impacts.build(self.index, path)))

    @property
    def vector_index(self) -> ivf.VectorIndex:
        return ivf.read(self.spark, self._stored("vectors", lambda path: ivf.build(self.vectors, path)))

    @property
    def grams(self) -> ngrams.Grams:
        """Titles (t:ID) and documents (d:ID) by their trigrams, stored likewise."""
        named = lambda mark, c: self.chunks.select(F.concat(F.lit(mark), "id").alias("id"), F.col(c).alias("text"))
        return ngrams.read(self.spark, self._stored("grams", lambda path: ngrams.build(named("t:", "title").unionByName(named("d:", "document")), path)))

    def _stored(self, kind: str, build: Callable[[str], object]) -> str:
        key = (self.spark.sparkContext.applicationId, self.dir, kind)
        if key not in _INDEXES:
            path = staging.scratch(self.spark, kind)
            build(path)
            _INDEXES[key] = path
        return _INDEXES[key]

    @property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))

    @property
    def query_vectors(self) -> DataFrame:
        """The vectors under the questions' numbers stand for the questions."""
        return self.table("embeddings").join(self.table("benchmark"), F.col("vec_id") == F.col("item_id")).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))

    @property
    def records(self) -> DataFrame:
        """Metadata in all its forms, made from documents: ids, parents, sources and codes of several kinds."""
        d, s = F.col("doc_id"), F.col("doc_id").cast("string")
        return self.table("documents").select(
            "doc_id", F.concat(F.lit("doc_"), s).alias("id"),
            F.when(d % 7 == 0, F.concat(F.lit("C"), s)).when(d % 7 == 1, F.lit("bad code!")).alias("shortcode"),
            F.when(d % 5 == 0, F.concat(F.lit("ig:P"), s, F.lit(":item:1"))).when(d % 5 == 1, F.lit("")).when(d % 5 == 2, F.concat(F.lit("par_"), (d % 10).cast("string"))).alias("parent_id"),
            F.when(d % 11 == 0, F.concat(F.lit("can_"), (d % 3).cast("string"))).alias("canonical_id"),
            F.when(d % 6 == 0, F.lit("save_memory")).when(d % 6 == 1, F.concat(F.lit("https://www.instagram.com/p/X"), s, F.lit("/"))).when(d % 6 == 2, F.concat(F.lit("C:\\x\\Promtlarim\\instagram\\z"), s, F.lit(".md"))).when(d % 6 == 3, F.lit("web_page")).otherwise(F.concat(F.lit("file"), (d % 4).cast("string"))).alias("source"),
        )

    @property
    def usable_flags(self) -> DataFrame:
        """doc_id, status: labels of poor quality are quarantined, documents without a label have no entry."""
        return self.table("labels").select("doc_id", (F.col("quality") != 0).alias("status"))


def wordpiece_vocabulary() -> list[str]:
    """A WordPiece vocabulary that follows by rule from a public one: each of its strings, without the mark of a word's end, as the
    first and as a continued piece."""
    import json

    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        strings = json.load(f)["model"]["vocab"]
    # the strings stand for bytes: each printable one by itself, the others by signs from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    out = {"[UNK]"}
    for s in strings:
        raw = bytes(byte[c] for c in s.removesuffix("</w>"))
        try:
            word = raw.decode()
        except UnicodeDecodeError:
            continue
        if word and not word.isspace():
            out |= {word, f"##{word}"}
    return sorted(out)


def query(name: str, sql: str | None = None):
    """Register a query; it gets the bound tables and returns a DataFrame."""

    def add(fn: Callable[[Data], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Data(spark, sf_dir))
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return add


def sql_normalize(c: str) -> str:
    return f"regexp_replace(lower({c}), '[''`’ʻʼ]', '''', 'g')"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '{tx.STRIP}', '\\1')"


def sql_tokens(c: str) -> str:
    pattern = tx.WORD.replace("'", "''")
    return f"list_transform(regexp_extract_all({sql_normalize(c)}, '{pattern}'), lambda t: {sql_strip('t')})"


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in tx.stop_list())


def sql_meaningful(tokens: str) -> str:
    kept = f"list_filter({tokens}, lambda t: t NOT IN ({_STOP}))"
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE {tokens} END"


_STEMMED = f"regexp_matches(w, '{tx.STEM}')"
_ROOT, _SUFFIX = f"regexp_extract(w, '{tx.STEM}', 1)", f"regexp_extract(w, '{tx.STEM}', 2)"
SQL_STEM_STEP = f"""CASE WHEN length(w) <= 3 THEN w
 WHEN {_STEMMED} THEN CASE WHEN {_SUFFIX} IN ('aymiz', 'aydi') THEN {_ROOT} || 'a' ELSE {_ROOT} END
 WHEN w LIKE '%mi' THEN CASE WHEN length(w) >= 5 THEN left(w, length(w) - 2) ELSE w END
 WHEN w LIKE '%i' AND length(w) >= 6 AND lower(substring(w, length(w) - 1, 1)) NOT IN ('a','e','i','o','u') THEN left(w, length(w) - 1)
 ELSE w END"""

#: Common table expressions by name, each built on those before it.
CTES = {
    "chunks": """SELECT 'doc_' || doc_id AS id, doc_id, text AS document, source AS project,
 CASE lang WHEN 'en' THEN 'note' WHEN 'fr' THEN 'summary' WHEN 'de' THEN 'decision' ELSE 'doc' END AS kind,
 left(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'), 40) AS title, 'p_' || (doc_id // 4) AS parent_id,
 '2026-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS date FROM documents""",
    "queries": "SELECT item_id AS qid, coalesce(text, '') AS text FROM benchmark",
    "kwdocs": f"SELECT *, len(tokens) AS token_count FROM (SELECT id, doc_id, project, kind, parent_id, {sql_tokens('title || chr(10) || document')} AS tokens FROM chunks)",
    "posts": "SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(tokens) AS term FROM kwdocs) GROUP BY ALL",
    "stats": "SELECT count(*) AS n_docs, avg(token_count) AS avgdl FROM kwdocs",
    "df": "SELECT term, count(*) AS df FROM posts GROUP BY term",
    "qterms": f"SELECT DISTINCT qid, unnest({sql_tokens('text')}) AS term FROM queries",
    "bm25": f"""SELECT qid, p.id, round(-sum(ln((n_docs - df + 0.5) / (df + 0.5) + 1) * (tf * ({BM25_K1} + 1)) / (tf + {BM25_K1} * (1 - {BM25_B} + {BM25_B} * (token_count / avgdl)))), 6) AS score
 FROM qterms JOIN posts p USING (term) JOIN df USING (term) JOIN kwdocs k ON k.id = p.id CROSS JOIN stats GROUP BY ALL""",
    "kwtop": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank FROM bm25) WHERE rank <= 50",
    "records": """SELECT doc_id, 'doc_' || doc_id AS id, CASE doc_id % 7 WHEN 0 THEN 'C' || doc_id WHEN 1 THEN 'bad code!' END AS shortcode,
 CASE doc_id % 5 WHEN 0 THEN 'ig:P' || doc_id || ':item:1' WHEN 1 THEN '' WHEN 2 THEN 'par_' || (doc_id % 10) END AS parent_id,
 CASE WHEN doc_id % 11 = 0 THEN 'can_' || (doc_id % 3) END AS canonical_id,
 CASE doc_id % 6 WHEN 0 THEN 'save_memory' WHEN 1 THEN 'https://www.instagram.com/p/X' || doc_id || '/' WHEN 2 THEN 'C:\\x\\Promtlarim\\instagram\\z' || doc_id || '.md'
  WHEN 3 THEN 'web_page' ELSE 'file' || (doc_id % 4) END AS source FROM documents""",
    "keyed": """SELECT *, CASE WHEN code IS NOT NULL THEN 'ig:' || code WHEN first IS NULL OR first IN ('save_memory', 'upload', 'web_search', 'web_page') THEN id ELSE first END AS source_key
 FROM (SELECT *, coalesce(nullif(parent_id, ''), nullif(canonical_id, ''), nullif(source, '')) AS first,
  coalesce(CASE WHEN regexp_full_match(shortcode, '[A-Za-z0-9_-]+') THEN shortcode END, nullif(regexp_extract(id, '^ig:([A-Za-z0-9_-]+)(?::|$)', 1), ''),
   nullif(regexp_extract(parent_id, '^ig:([A-Za-z0-9_-]+)(?::|$)', 1), ''), nullif(regexp_extract(canonical_id, '^ig:([A-Za-z0-9_-]+)(?::|$)', 1), ''),
   nullif(regexp_extract(source, '(?:instagram\\.com/(?:reel|p|tv)/|instagram-file:)([A-Za-z0-9_-]+)', 1), ''),
   nullif(regexp_extract(replace(source, '\\', '/'), '/Promtlarim/instagram/([A-Za-z0-9_-]+)\\.md$', 1), '')) AS code FROM records)""",
    "qvec": "SELECT vec_id AS qid, embedding AS vector FROM embeddings JOIN benchmark ON vec_id = item_id",
    "sims": """SELECT q.qid, e.vec_id AS id, round(list_dot_product(q.vector::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.vector::DOUBLE[], q.vector::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 6) AS similarity
 FROM qvec q CROSS JOIN embeddings e""",
    "vectop": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS rank FROM sims WHERE similarity >= 0.1) WHERE rank <= 50",
    "dense": "SELECT qid, 'doc_' || v.id AS id, c.parent_id AS source_key, similarity FROM vectop v JOIN chunks c ON c.doc_id = v.id",
    "lexical": "SELECT qid, k.id, c.parent_id AS source_key, score FROM kwtop k JOIN chunks c USING (id)",
    "legs": """SELECT qid, source_key, 1.0 / (60 + row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id)) AS part FROM (SELECT *, row_number() OVER (PARTITION BY qid, source_key ORDER BY similarity DESC, id) AS n FROM dense) WHERE n = 1
 UNION ALL SELECT qid, source_key, 0.2 / (60 + row_number() OVER (PARTITION BY qid ORDER BY score, id)) FROM (SELECT *, row_number() OVER (PARTITION BY qid, source_key ORDER BY score, id) AS n FROM lexical) WHERE n = 1""",
    "fused": "SELECT qid, source_key, round(sum(part), 6) AS rrf FROM legs GROUP BY ALL",
    "weights": f"""SELECT qid, term, round(greatest(0.01, ln((n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5) + 1)), 6) AS weight
 FROM (SELECT DISTINCT qid, unnest({sql_meaningful('tokens')}) AS term FROM (SELECT qid, {sql_tokens('text')} AS tokens FROM queries))
 LEFT JOIN (SELECT term, count(DISTINCT parent_id) AS df FROM (SELECT parent_id, unnest(tokens) AS term FROM kwdocs) GROUP BY term) USING (term) CROSS JOIN (SELECT count(DISTINCT parent_id) AS n FROM kwdocs)""",
    "pairs": "SELECT DISTINCT qid, k.id, c.parent_id, c.document || ' ' || c.title || ' ' || c.date AS evidence FROM (SELECT qid, id FROM kwtop UNION SELECT qid, id FROM dense) k JOIN chunks c USING (id)",
    "pairtokens": f"SELECT qid, id, parent_id, evidence, {sql_tokens('evidence')} AS tokens FROM pairs",
    "stemmed": f"SELECT term, w AS stem FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY i DESC) AS last FROM (WITH RECURSIVE s(term, w, i) AS (SELECT DISTINCT term, term, 0 FROM (SELECT unnest(tokens) AS term FROM pairtokens UNION ALL SELECT term FROM weights) UNION ALL SELECT term, {SQL_STEM_STEP}, i + 1 FROM s WHERE {SQL_STEM_STEP} <> w) SELECT * FROM s)) WHERE last = 1",
    "have": "SELECT DISTINCT qid, id, stem FROM (SELECT qid, id, unnest(tokens) AS term FROM pairtokens) JOIN stemmed USING (term)",
    "covered": """SELECT p.qid, p.id, coalesce(round(h.w / t.total, 6), 0.0) AS coverage, coalesce(h.matched, 0) AS matched FROM pairtokens p
 LEFT JOIN (SELECT qid, sum(weight) AS total FROM weights GROUP BY qid) t ON t.qid = p.qid
 LEFT JOIN (SELECT a.qid, h.id, sum(weight) AS w, count(*) AS matched FROM weights a JOIN stemmed s USING (term) JOIN have h ON h.qid = a.qid AND h.stem = s.stem GROUP BY a.qid, h.id) h ON h.qid = p.qid AND h.id = p.id""",
    "asked": f"""SELECT qid, raw, list_transform(list_concat(regexp_extract_all(text, '\\b(19[0-9][0-9]|20[0-9][0-9])\\b', 1), regexp_extract_all(text, '"([^"]+)"', 1)), lambda c: lower(c)) AS constraints,
 len(list_distinct(list_filter(raw, lambda t: t NOT IN ({_STOP})))) AS n_meaningful FROM (SELECT qid, text, {sql_tokens('text')} AS raw FROM queries)""",
    "gated": """SELECT p.qid, p.id, p.parent_id, coverage, matched, CASE WHEN len(raw) = 1 THEN list_contains(tokens, raw[1])
  ELSE len(list_filter(constraints, lambda c: NOT contains(lower(evidence), c))) = 0 AND coverage >= 0.65 AND matched >= CASE WHEN n_meaningful = 1 THEN 1 ELSE 2 END END AS passes
 FROM pairtokens p JOIN covered USING (qid, id) JOIN asked USING (qid)""",
    "planted": "SELECT item_id AS qid, count(d.doc_id) AS n_planted, min(d.doc_id) AS expected FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY item_id",
    "evalq": """SELECT qid, CASE qid % 3 WHEN 0 THEN 'uz' WHEN 1 THEN 'en' ELSE 'ru' END AS lang, CASE WHEN n_planted > 0 THEN 'answerable' WHEN qid % 2 = 0 THEN 'near_miss' ELSE 'unanswerable' END AS kind,
 CASE WHEN n_planted > 0 THEN 'p_' || (expected // 4) END AS expected, CAST((qid * 7) % 50 AS DOUBLE) + 0.5 AS latency_ms FROM planted""",
    "top10": "SELECT qid, id, rank, round(-score / (10 - score), 6) AS score FROM kwtop WHERE rank <= 10",
    "hits": "SELECT t.qid, t.rank, t.score, t.id FROM top10 t JOIN evalq e USING (qid) JOIN chunks c ON c.id = t.id WHERE c.parent_id = e.expected",
    "thresholds": """SELECT DISTINCT theta FROM (SELECT round(unnest(range(0, 20)) * 0.05::DOUBLE, 4) AS theta UNION ALL SELECT round(score, 4) FROM top10
 UNION ALL SELECT round(unnest(range(1, 51)) * m / 50, 5) FROM (SELECT max(round(score, 4)) AS m FROM top10) WHERE m < 0.1)""",
    "firsthit": "SELECT theta, qid, min(rank) AS first FROM thresholds JOIN hits ON score >= theta GROUP BY ALL",
    "sweep": """SELECT theta, round(avg(CASE WHEN kind = 'answerable' THEN CASE WHEN first <= 10 THEN 1.0 ELSE 0.0 END END), 4) AS r10,
 round(avg(CASE WHEN kind = 'answerable' THEN coalesce(1.0 / first, 0.0) END), 4) AS mrr, round(avg(CASE WHEN kind <> 'answerable' THEN CASE WHEN top >= theta THEN 1.0 ELSE 0.0 END END), 4) AS far
 FROM thresholds CROSS JOIN evalq LEFT JOIN (SELECT qid, max(score) AS top FROM top10 GROUP BY qid) USING (qid) LEFT JOIN firsthit USING (theta, qid) GROUP BY theta""",
    "edges": """SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, max(w) AS weight FROM (SELECT qid, id, similarity AS w, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS n FROM selfsims WHERE qid <> id) s
 JOIN (SELECT vec_id AS id FROM embeddings) a ON a.id = s.qid JOIN (SELECT vec_id AS id FROM embeddings) b ON b.id = s.id WHERE n <= 6 AND w >= 0.15 GROUP BY ALL""",
}
CTES["selfsims"] = CTES["sims"].replace("FROM qvec q", "FROM (SELECT vec_id AS qid, embedding AS vector FROM embeddings) q")
_ORDER = ["chunks", "queries", "kwdocs", "posts", "stats", "df", "qterms", "bm25", "kwtop", "records", "keyed", "qvec", "sims", "selfsims", "vectop", "dense", "lexical", "legs", "fused", "weights",
          "pairs", "pairtokens", "stemmed", "have", "covered", "asked", "gated", "planted", "evalq", "top10", "hits", "thresholds", "firsthit", "sweep", "edges"]


def sql(final: str) -> str:
    """``final`` after the common table expressions that it names, directly or through one another."""
    import re

    need: set[str] = set()
    todo = [final]
    while todo:
        words = set(re.findall(r"\b[a-z0-9]+\b", todo.pop()))
        for name in words & CTES.keys() - need:
            need.add(name)
            todo.append(CTES[name])
    names = [n for n in _ORDER if n in need]
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in names) + "\n" if names else "") + final.strip()
