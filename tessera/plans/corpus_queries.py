"""Sources, sinks, scalar functions, predicates, joins and sets over chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import wordpiece
from ..operators import ngrams, policy, store
from ..sources import chunking, exports, parse
from ..staging import scratch
from .base import SQL_STEM_STEP, Data, query, sql, sql_meaningful, sql_normalize, sql_strip, sql_tokens, wordpiece_vocabulary  # noqa: F401

_PATH = "source || CASE doc_id % 5 WHEN 0 THEN '/.venv/' WHEN 1 THEN '/kg_db/' ELSE '/docs/' END || doc_id || CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.rst' ELSE '.py' END"


def _paths(d: Data) -> DataFrame:
    """Documents as files: a path made of source and id."""
    return d.table("documents").select("doc_id", "text", F.expr(_PATH).alias("path"))


@query("scan_documents", f"SELECT doc_id, path FROM (SELECT doc_id, {_PATH} AS path FROM documents) WHERE regexp_matches(path, '\\.(md|txt|rst)$') AND NOT regexp_matches(path, '(^|/)(\\.venv|kg_db)/')")
def _(d: Data) -> DataFrame:
    return _paths(d).where(parse.scannable(F.col("path"))).select("doc_id", "path")


_REPO = "CASE doc_id % 7 WHEN 0 THEN 'dify' WHEN 1 THEN 'open-design' WHEN 2 THEN 'system_prompts_leaks' WHEN 3 THEN 'learn-claude-code' WHEN 4 THEN 'claude-code-best-practice' WHEN 5 THEN 'gstack' ELSE 'any' END"
_REL = """CASE doc_id % 11 WHEN 0 THEN 'README.md' WHEN 1 THEN 'docs/guide.md' WHEN 2 THEN 's01_intro/README.md' WHEN 3 THEN 'skills/x/SKILL.md' WHEN 4 THEN 'OpenAI/gpt.md' WHEN 5 THEN 'best-practice/a.md'
 WHEN 6 THEN '.claude/rules.md' WHEN 7 THEN 'docs/fr/guide.md' WHEN 8 THEN 'tests/README.md' WHEN 9 THEN 'README-zh.md' ELSE 'CHANGELOG.md' END"""


@query("curated_docs", f"""SELECT doc_id, repo, rel AS path FROM (SELECT doc_id, {_REPO} AS repo, {_REL} AS rel, octet_length(encode(text)) AS n FROM documents) WHERE n >= 50 AND repo <> 'dify' AND (
 rel = 'README.md' OR (rel = 'skills/x/SKILL.md' AND repo <> 'open-design') OR rel = '.claude/rules.md' OR (repo = 'open-design' AND rel = 'docs/guide.md') OR (repo = 'system_prompts_leaks' AND rel IN ('docs/guide.md', 'OpenAI/gpt.md', 'best-practice/a.md'))
 OR (repo = 'learn-claude-code' AND rel = 's01_intro/README.md') OR (repo = 'claude-code-best-practice' AND rel = 'best-practice/a.md'))""")
def _(d: Data) -> DataFrame:
    files = d.table("documents").select("doc_id", F.expr(_REPO).alias("repo"), F.expr(_REL).alias("path"), F.octet_length("text").alias("n"))
    return files.where(parse.curated(F.col("repo"), F.col("path"), F.col("n"))).select("doc_id", "repo", "path")


@query("get_all", sql("SELECT id, title, project FROM chunks"))
def _(d: Data) -> DataFrame:
    return d.chunks.select("id", "title", "project")


@query("get_by_ids", sql("SELECT id, title FROM chunks WHERE id IN ('doc_1', 'doc_7', 'doc_42', 'doc_absent')"))
def _(d: Data) -> DataFrame:
    return d.chunks.where(F.col("id").isin("doc_1", "doc_7", "doc_42", "doc_absent")).select("id", "title")


@query("get_where", sql("SELECT id, project, kind FROM chunks WHERE project = 'src3' AND kind = 'note'"))
def _(d: Data) -> DataFrame:
    return d.chunks.where(policy.where({"project": "src3", "kind": "note"})).select("id", "project", "kind")


@query("page", sql("SELECT id, title FROM chunks ORDER BY id LIMIT 20 OFFSET 40"))
def _(d: Data) -> DataFrame:
    return d.chunks.select("id", "title").orderBy("id").offset(40).limit(20)


@query("eav_pivot", "SELECT doc_id, max(v) FILTER (WHERE k = 'lang') AS lang, max(v) FILTER (WHERE k = 'source') AS source FROM (SELECT doc_id, 'lang' AS k, lang AS v FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents WHERE doc_id % 3 <> 0) GROUP BY doc_id")
def _(d: Data) -> DataFrame:
    docs = d.table("documents")
    eav = docs.select("doc_id", F.lit("lang").alias("k"), F.col("lang").alias("v")).unionByName(docs.where("doc_id % 3 <> 0").select("doc_id", F.lit("source").alias("k"), F.col("source").alias("v")))
    return store.eav_pivot(eav, "doc_id", "k", "v", ["lang", "source"])


_FRONT = "CASE doc_id % 4 WHEN 0 THEN '---' || chr(10) || 'shortcode: A' || doc_id || chr(10) || 'usable: ' || CASE doc_id % 3 WHEN 0 THEN 'false' WHEN 1 THEN '\"yes\"' ELSE 'maybe' END || chr(10) || '---' || chr(10) || text WHEN 1 THEN '---' || chr(10) || 'title: x' || chr(10) || '---' || chr(10) || 'shortcode: no' ELSE text END"


@query("frontmatter_flag", f"SELECT doc_id, starts_with(t, '---') AND regexp_matches(string_split(t, chr(10) || '---')[1], '(?m)^shortcode:') AS flag FROM (SELECT doc_id, {_FRONT} AS t FROM documents)")
def _(d: Data) -> DataFrame:
    return d.table("documents").select("doc_id", policy.has_front_matter(F.expr(_FRONT)).alias("flag"))


@query("frontmatter_usable", f"""SELECT doc_id, CASE WHEN starts_with(t, '---') AND f <> '' THEN f NOT IN ('false', '0', 'no') END AS usable
 FROM (SELECT doc_id, t, lower(regexp_extract(string_split(left(t, 8192), chr(10) || '---')[1], '(?mi)^usable:\\s*["'']?(false|true|0|1|no|yes)\\b', 1)) AS f FROM (SELECT doc_id, {_FRONT} AS t FROM documents))""")
def _(d: Data) -> DataFrame:
    return d.table("documents").select("doc_id", policy.front_matter_usable(F.expr(_FRONT)).alias("usable"))


# ---- conversations


def _as_files(d: Data, objects: DataFrame, name: str) -> str:
    """A folder of JSON arrays of the column ``object``, some in each file."""
    path = scratch(d.spark, name)
    rows = objects.groupBy(F.pmod(F.xxhash64("object"), F.lit(8)).alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("object"), ","), F.lit("]")).alias("value"))
    rows.write.partitionBy("part").text(path)
    return f"{path}/*"


def _project_files(d: Data) -> str:
    """The documents as projects, a JSON object in a file each. A file is written line by line, so no task holds one."""
    name = F.col("project")
    docs = d.chunks.select("project", F.col("doc_id").cast("long").alias("n"), F.lit(1).alias("place"), F.to_json(F.struct(F.col("id").alias("name"), F.col("document").alias("content"))).alias("value"))
    said = F.to_json(F.struct(F.concat(F.lit("u"), name).alias("uuid"), name.alias("name"), F.concat(F.lit("All of "), name).alias("description"), F.lit(" Keep it. ").alias("instructions")))
    names = d.table("documents").select(F.col("source").alias("project")).distinct()
    edge = lambda place, value: names.select("project", F.lit(None).cast("long").alias("n"), F.lit(place).alias("place"), value.alias("value"))
    lines = docs.unionByName(edge(0, F.concat(F.regexp_replace(said, r"\}$", ""), F.lit(',"docs":[')))).unionByName(edge(2, F.lit("]}")))
    before = F.lag("place").over(Window.partitionBy("project").orderBy("place", "n"))
    path = scratch(d.spark, "projects")
    lines.select("project", F.when((F.col("place") == 1) & (before == 1), F.concat(F.lit(","), "value")).otherwise(F.col("value")).alias("value")).write.partitionBy("project").text(path)
    return f"{path}/*"


_SPOKEN = "CASE WHEN role = 'user' THEN '**Human:**' ELSE '**Assistant:**' END || chr(10) || chr(10) || trim(text, E' \\n\\t\\r')"


@query("import_chats", f"SELECT 'c' || conv_id AS uuid, '2026-01-02' AS date, count(*) AS n, '# Chat ' || conv_id || chr(10) || chr(10) || 'Sana: 2026-01-02  ' || chr(10) || 'UUID: c' || conv_id || chr(10) || chr(10) || string_agg({_SPOKEN}, chr(10) || chr(10) ORDER BY turn) || chr(10) AS markdown FROM conversations WHERE trim(coalesce(text, ''), E' \n\t\r') <> '' GROUP BY conv_id")
def _(d: Data) -> DataFrame:
    """The conversations go through the files of an export."""
    sender = F.when(F.col("role") == "user", "human").otherwise("assistant")
    content = F.when(F.col("turn") % 2 == 1, F.array(F.struct(F.lit("text").alias("type"), F.concat(F.lit(" "), "text").alias("text"))))
    turns = d.table("conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", sender.alias("sender"), "text", content.alias("content")))), lambda m: F.struct(m["sender"].alias("sender"), m["text"].alias("text"), m["content"].alias("content"))).alias("chat_messages"))
    objects = turns.select(F.to_json(F.struct(F.concat(F.lit("c"), "conv_id").alias("uuid"), F.concat(F.lit("Chat "), "conv_id").alias("name"), F.lit("2026-01-02T03:04:05Z").alias("created_at"), "chat_messages")).alias("object"))
    return exports.read_chats(d.spark, _as_files(d, objects, "chats")).select("uuid", "date", "n", "markdown")


@query("render_markdown", "SELECT conv_id, '# Chat ' || conv_id || chr(10) || chr(10) || string_agg('**' || role || ':** ' || regexp_replace(text, '\\n{4,}', chr(10) || chr(10) || chr(10), 'g'), chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id")
def _(d: Data) -> DataFrame:
    return parse.render_markdown(d.table("conversations"))


_TITLE = "left(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), 60)"


_LOG_TITLE = f"CASE WHEN conv_id % 3 = 0 THEN 'Custom ' || conv_id WHEN conv_id % 3 = 1 THEN 'Made ' || conv_id ELSE coalesce(arg_min({_TITLE}, turn) FILTER (WHERE role = 'user'), 'chat') END"


def _session_logs(d: Data) -> str:
    """The conversations as session logs, a file each, with titles, folders, tools and a broken line."""
    c, user = F.col("conv_id"), F.col("role") == "user"
    blocks = F.concat(F.array(F.struct(F.lit("text").alias("type"), "text", F.lit(None).cast("string").alias("name"))), F.when(~user & (F.col("turn") % 2 == 0), F.array(F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("Bash").alias("name")))).otherwise(F.array()))
    said = F.to_json(F.struct(F.when(user, "user").otherwise("assistant").alias("type"), F.lit("2026-03-04T05:06:07Z").alias("timestamp"), F.concat(F.lit("s"), c).alias("sessionId"), F.when(F.col("turn") > 1, "/home").otherwise(F.concat(F.lit("/work/"), (c % 4).cast("string"))).alias("cwd"), F.struct(blocks.alias("content")).alias("message")))
    turns = d.table("conversations").select("conv_id", F.col("turn").alias("n"), said.alias("value"))
    ids = d.table("conversations").select("conv_id").distinct()
    line = lambda n, o: ids.select("conv_id", F.lit(n).cast("long").alias("n"), o.alias("value"))
    first = line(-2, F.to_json(F.struct(F.lit("note").alias("type"), F.concat(F.lit("/work/"), (c % 4).cast("string")).alias("cwd")))).unionByName(line(-1, F.to_json(F.struct(F.lit("note").alias("type"), F.lit("/home").alias("cwd")))))
    made = line(10_000, F.when(c % 3 != 2, F.to_json(F.struct(F.lit("ai-title").alias("type"), F.concat(F.lit("Made "), c).alias("aiTitle")))).otherwise("{broken"))
    custom = line(10_001, F.when(c % 3 == 0, F.to_json(F.struct(F.lit("custom-title").alias("type"), F.concat(F.lit("Custom "), c).alias("customTitle")))).otherwise("{broken"))
    path = scratch(d.spark, "sessions")
    lines = turns.unionByName(first).unionByName(made).unionByName(custom)
    lines.repartition("conv_id").sortWithinPartitions("conv_id", "n").select("conv_id", "value").write.partitionBy("conv_id").text(path)
    return f"{path}/*"


@query("import_sessions", f"""SELECT 's' || conv_id AS session_id, {_LOG_TITLE} AS title,
 '/work/' || (conv_id % 4) || ', /home' AS cwd, count(*) AS n_messages, count(*) FILTER (WHERE role <> 'user' AND turn % 2 = 0) AS n_tools FROM conversations WHERE trim(coalesce(text, ''), E' \\n\\t\\r') <> '' GROUP BY conv_id""")
def _(d: Data) -> DataFrame:
    return exports.read_sessions(d.spark, _session_logs(d)).select("session_id", "title", "cwd", "n_messages", "n_tools")


@query("session_pages", f"""SELECT 's' || conv_id AS session_id, regexp_replace('# ' || {_LOG_TITLE} || chr(10) || chr(10) || 'Sana: 2026-03-04  ' || chr(10) || 'Session ID: s' || conv_id || '  ' || chr(10) || 'CWD: /work/' || (conv_id % 4) || ', /home' || chr(10) || chr(10)
 || string_agg({_SPOKEN} || CASE WHEN role <> 'user' AND turn % 2 = 0 THEN chr(10) || chr(10) || '_[tools: Bash]_' ELSE '' END, chr(10) || chr(10) ORDER BY turn) || chr(10), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g') AS markdown FROM conversations WHERE trim(coalesce(text, ''), E' \\n\\t\\r') <> '' GROUP BY conv_id""")
def _(d: Data) -> DataFrame:
    """The pages that the logs become."""
    return exports.read_sessions(d.spark, _session_logs(d)).select("session_id", "markdown")


@query("import_projects", sql("""SELECT 'u' || project AS uuid, project AS name, count(*) AS n_docs, '# ' || project || chr(10) || chr(10) || 'UUID: u' || project || '  ' || chr(10) || 'All of ' || project || chr(10) || chr(10) || '## Project instructions' || chr(10) || chr(10) || 'Keep it.' || chr(10) || chr(10)
 || string_agg('## Hujjat: ' || id || chr(10) || chr(10) || trim(document, E' \\n\\t\\r'), chr(10) || chr(10) ORDER BY doc_id) || chr(10) AS markdown FROM chunks WHERE trim(document, E' \\n\\t\\r') <> '' GROUP BY project"""))
def _(d: Data) -> DataFrame:
    """Documents go through project files; a project is one page."""
    return exports.read_projects(d.spark, _project_files(d)).select("uuid", "name", "n_docs", "markdown")


@query("read_questions", sql("SELECT 'q' || qid AS id, text AS query, CASE qid % 3 WHEN 0 THEN 'uz' WHEN 1 THEN 'en' ELSE 'ru' END AS lang FROM queries WHERE trim(text) <> ''"))
def _(d: Data) -> DataFrame:
    q = F.col("qid")
    lang = F.when(q % 3 == 0, "uz").when(q % 3 == 1, "en").otherwise("ru")
    path = scratch(d.spark, "questions") + ".jsonl"
    d.queries.select(F.concat(F.lit("q"), "qid").alias("id"), F.col("text").alias("query"), lang.alias("lang")).write.json(path)
    return exports.read_questions(d.spark, path).select("id", "query", "lang")


@query("session_render", """SELECT user_id, step, coalesce(string_agg(event_type, ' ' ORDER BY event_id) FILTER (WHERE NOT says), '') AS tools, max(event_type) FILTER (WHERE says) AS said FROM (
 SELECT *, CAST(coalesce(sum(CAST(says AS INT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS step
 FROM (SELECT *, event_type IN ('purchase', 'signup', 'view') AS says FROM events)) GROUP BY ALL""")
def _(d: Data) -> DataFrame:
    return parse.session_render(d.table("events"))


@query("last_title", "SELECT user_id, arg_max(event_type, event_id) AS title FROM events WHERE coalesce(event_type, '') <> '' GROUP BY user_id")
def _(d: Data) -> DataFrame:
    return d.table("events").where(F.coalesce("event_type", F.lit("")) != "").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("title"))


@query("run_length_chain", """SELECT user_id, string_agg(CASE WHEN n > 1 THEN event_type || ' x' || n ELSE event_type END, ' -> ' ORDER BY first) AS chain FROM (
 SELECT user_id, event_type, run, count(*) AS n, min(event_id) AS first FROM (SELECT *, sum(change) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (
 SELECT user_id, event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS change FROM events)) GROUP BY ALL) GROUP BY user_id""")
def _(d: Data) -> DataFrame:
    return parse.run_lengths(d.table("events"), "user_id", "event_id", "event_type")


@query("dedupe_names", "SELECT doc_id, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS name FROM (SELECT doc_id, slug, row_number() OVER (PARTITION BY slug ORDER BY doc_id) AS n FROM (SELECT doc_id, lower(regexp_extract(text, '^[A-Za-z]+')) AS slug FROM documents))")
def _(d: Data) -> DataFrame:
    """Names are the first words, which many documents share."""
    return parse.dedupe_names(d.table("documents").select("doc_id", F.lower(F.regexp_extract("text", "^[A-Za-z]+", 0)).alias("slug")), "slug", "doc_id")


@query("post_items", """WITH items AS (SELECT doc_id, list_prepend(left(text, 200), list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS parts FROM documents)
 SELECT 'ig:P' || doc_id || CASE WHEN i = 1 THEN ':summary' ELSE ':item:' || (i - 1) END AS id, 'P' || doc_id AS shortcode, parts[i] AS document FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM items)""")
def _(d: Data) -> DataFrame:
    return parse.post_items(d.table("documents").select(F.concat(F.lit("P"), "doc_id").alias("shortcode"), "text"))


@query("eval_queries", sql("SELECT qid, lang, kind, expected FROM evalq"))
def _(d: Data) -> DataFrame:
    from .evaluation_queries import eval_queries

    return eval_queries(d).select("qid", "lang", "kind", "expected")


# ---- text


@query("normalize_text", f"SELECT doc_id, {sql_normalize('text')} AS text FROM documents")
def _(d: Data) -> DataFrame:
    return d.table("documents").select("doc_id", tx.normalize(F.col("text")).alias("text"))


@query("tokenize", f"SELECT doc_id, array_to_string({sql_tokens('text')}, ' ') AS tokens FROM documents")
def _(d: Data) -> DataFrame:
    return d.table("documents").select("doc_id", F.array_join(tx.tokenize(F.col("text")), " ").alias("tokens"))


@query("suffix_strip", f"SELECT DISTINCT w, {sql_strip('w')} AS root FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM documents)")
def _(d: Data) -> DataFrame:
    return d.table("documents").select(F.explode(F.split(F.lower("text"), " ")).alias("w")).distinct().select("w", tx.strip_suffix(F.col("w")).alias("root"))


@query("light_stem", sql(f"""SELECT term, arg_max(w, i) AS stem FROM (WITH RECURSIVE s(term, w, i) AS (SELECT DISTINCT term, term, 0 FROM posts UNION ALL SELECT term, {SQL_STEM_STEP}, i + 1 FROM s WHERE {SQL_STEM_STEP} <> w) SELECT * FROM s) GROUP BY term"""))
def _(d: Data) -> DataFrame:
    words = d.kw_docs.select(F.explode("tokens").alias("term")).distinct()
    return words.select("term", tx.light_stem(F.col("term")).alias("stem"))


@query("strict_constraints", """SELECT doc_id, array_to_string(list_transform(list_concat(regexp_extract_all(t, '\\b(19[0-9][0-9]|20[0-9][0-9])\\b', 1), regexp_extract_all(t, '"([^"]+)"', 1)), lambda c: lower(c)), '|') AS constraints
 FROM (SELECT doc_id, text || ' in 20' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') || ' "Source ' || source || '"' AS t FROM documents)""")
def _(d: Data) -> DataFrame:
    t = F.concat(F.col("text"), F.lit(" in 20"), F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"), F.lit(' "Source '), F.col("source"), F.lit('"'))
    return d.table("documents").select("doc_id", F.array_join(tx.strict_constraints(t), "|").alias("constraints"))


def _sql_slug(c: str) -> str:
    kept = f"lower(trim(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g')))"
    return f"coalesce(nullif(left(regexp_replace({kept}, '[\\s_]+', '-', 'g'), 60), ''), 'chat')"


@query("slugify", f"SELECT doc_id, {_sql_slug('text')} AS slug FROM documents")
def _(d: Data) -> DataFrame:
    return d.table("documents").select("doc_id", tx.slugify(F.col("text")).alias("slug"))


_FOLDER = "CASE doc_id % 4 WHEN 0 THEN 'D--claude-projects-' || source || '-App' WHEN 1 THEN 'D--claude-projects' WHEN 2 THEN 'C--Users-me-Desktop-' || source ELSE 'C--Users-' || source END"


@query("project_label", f"""SELECT doc_id, 'cc-' || {_sql_slug('base')} AS label FROM (SELECT doc_id, CASE WHEN below <> '' THEN below WHEN f = 'D--claude-projects' THEN 'claude-projects' WHEN desk <> '' THEN desk ELSE bare END AS base
 FROM (SELECT doc_id, f, regexp_extract(f, '(?i)^[A-Za-z]--claude-projects-(.+)$', 1) AS below, regexp_extract(f, '(?i)desktop-(.+)$', 1) AS desk, regexp_replace(f, '^[A-Za-z]--', '') AS bare FROM (SELECT doc_id, {_FOLDER} AS f FROM documents)))""")
def _(d: Data) -> DataFrame:
    return d.table("documents").select("doc_id", tx.project_label(F.expr(_FOLDER)).alias("label"))


@query("est_tokens", "SELECT doc_id, greatest(1, length(text) // 4) AS est_tokens FROM documents")
def _(d: Data) -> DataFrame:
    return d.table("documents").select("doc_id", tx.estimated_tokens(F.col("text")).alias("est_tokens"))


@query("token_count", f"SELECT doc_id, len({sql_tokens('text')}) AS token_count FROM documents")
def _(d: Data) -> DataFrame:
    return d.table("documents").select("doc_id", F.size(tx.tokenize(F.col("text"))).cast("long").alias("token_count"))


@query("normalize_source", "SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') OR url = 'save_memory' THEN lower(url) ELSE lower(replace(url, '\\', '/')) END AS source FROM pages")
def _(d: Data) -> DataFrame:
    return d.table("pages").select("page_id", parse.normalize_source(F.col("url")).alias("source"))


@query("parent_prefix", "SELECT doc_id, CASE WHEN c LIKE '%:' THEN c ELSE c || ':' END AS prefix FROM (SELECT doc_id, regexp_replace('doc:' || source || CASE doc_id % 3 WHEN 0 THEN ':' || doc_id WHEN 1 THEN ':' ELSE '' END, '^(.*):[0-9]+$', '\\1') AS c FROM documents)")
def _(d: Data) -> DataFrame:
    c = F.expr("'doc:' || source || CASE doc_id % 3 WHEN 0 THEN ':' || doc_id WHEN 1 THEN ':' ELSE '' END")
    return d.table("documents").select("doc_id", tx.parent_prefix(c).alias("prefix"))


@query("date_prefix", "SELECT event_id, left(strftime(ts, '%Y-%m-%dT%H:%M:%S'), 10) AS day FROM events")
def _(d: Data) -> DataFrame:
    return d.table("events").select("event_id", F.left(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(10)).alias("day"))


@query("chunk_id", "SELECT doc_id, 'file_' || left(sha1(source || '#' || doc_id), 16) AS chunk FROM documents")
def _(d: Data) -> DataFrame:
    return d.table("documents").select("doc_id", store.chunk_id(F.col("source"), F.col("doc_id")).alias("chunk"))


_META = "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS lang, CASE WHEN doc_id % 5 = 0 THEN source || ' \"x\"' ELSE source END AS source"
_HASHED = f"SELECT doc_id, sha256(text) AS doc_sha256, sha256(CAST(to_json({{'lang': lang, 'source': source}}) AS VARCHAR)) AS meta_sha256 FROM (SELECT doc_id, text, {_META} FROM documents)"


def _hashed(d: Data) -> DataFrame:
    """Some languages are null, some sources hold quotes."""
    lang, source = F.expr(_META.split(", CASE")[0].removesuffix(" AS lang")), F.expr("CASE" + _META.split(", CASE")[1].removesuffix(" AS source"))
    return d.table("documents").select("doc_id", *store.content_hashes(F.col("text"), {"lang": lang, "source": source}))


@query("content_hashes", _HASHED)
def _(d: Data) -> DataFrame:
    return _hashed(d)


_LEVELS = f"SELECT h, h AS p FROM (SELECT sha256(doc_id || ':' || doc_sha256 || ':' || meta_sha256) AS h FROM ({_HASHED}))"
for _n in (6, 4, 2, 0):
    _LEVELS = f"SELECT sha256(string_agg(h, '' ORDER BY h)) AS h, left(p, {_n}) AS p FROM ({_LEVELS}) GROUP BY left(p, {_n})"


@query("corpus_hash", f"SELECT h AS hash FROM ({_LEVELS})")
def _(d: Data) -> DataFrame:
    return store.corpus_hash(_hashed(d), "doc_id")


# ---- chunking


@query("chunk_windows", sql(f"SELECT doc_id, i AS chunk_index, array_to_string(list_slice(w, i * 182 + 1, i * 182 + 222), ' ') AS text, len(list_slice(w, i * 182 + 1, i * 182 + 222)) AS token_count FROM (SELECT doc_id, w, unnest(generate_series(0, greatest(0, CAST(ceil((len(w) - 222) / 182.0) AS BIGINT)))) AS i FROM (SELECT doc_id, {sql_tokens('text')} AS w FROM documents) WHERE len(w) > 0)"))
def _(d: Data) -> DataFrame:
    return parse.chunk_windows(d.table("documents"))


@query("chunk_budget")
def _(d: Data) -> DataFrame:
    return parse.chunk_by_budget(d.table("documents").select(F.col("doc_id").cast("string").alias("parent_id"), "text"))


@query("chunk_function")
def _(d: Data) -> DataFrame:
    """:func:`chunk_budget` by the table function, from SQL."""
    chunking.register(d.spark)
    return d.spark.sql("SELECT CAST(doc_id AS STRING) AS parent_id, c.* FROM {docs}, LATERAL chunk_text(text) c", docs=d.table("documents"))


@query("wordpiece_count")
def _(d: Data) -> DataFrame:
    return wordpiece.count_tokens(d.table("documents"), wordpiece.WordPiece(wordpiece_vocabulary()))


@query("chunk_wordpiece")
def _(d: Data) -> DataFrame:
    model = wordpiece.WordPiece(wordpiece_vocabulary())
    return parse.chunk_by_budget(d.table("documents").select(F.col("doc_id").cast("string").alias("parent_id"), "text"), count=model.count)


@query("long_chunks", f"SELECT source, count(*) FILTER (WHERE n > 256) AS n_long, count(*) AS n FROM (SELECT source, len({sql_tokens('text')}) AS n FROM documents) GROUP BY source")
def _(d: Data) -> DataFrame:
    n = F.size(tx.tokenize(F.col("text")))
    return d.table("documents").select("source", n.alias("n")).groupBy("source").agg(F.count_if(F.col("n") > 256).alias("n_long"), F.count("*").alias("n"))


# ---- projections and predicates


@query("memory_cards", sql("SELECT id, coalesce(nullif(title, ''), '(untitled)') AS title, kind, CASE WHEN doc_id % 9 = 0 THEN '?' ELSE date END AS date, project FROM chunks"))
def _(d: Data) -> DataFrame:
    return store.memory_cards(d.chunks.withColumn("date", F.when(F.col("doc_id") % 9 != 0, F.col("date"))))


@query("list_memories", sql("SELECT id, title, date FROM chunks WHERE doc_id % 6 = 0 ORDER BY date DESC, id LIMIT 20"))
def _(d: Data) -> DataFrame:
    return store.newest(d.chunks.where("doc_id % 6 = 0"), 20).select("id", "title", "date")


@query("fetch_json", sql("SELECT id, CAST(to_json({'id': id, 'title': title, 'text': document, 'metadata': {'project': project, 'kind': kind, 'date': date}}) AS VARCHAR) AS record FROM chunks"))
def _(d: Data) -> DataFrame:
    return d.chunks.select("id", F.to_json(F.struct("id", "title", F.col("document").alias("text"), F.struct("project", "kind", "date").alias("metadata"))).alias("record"))


@query("filter_eq", sql("SELECT id FROM chunks WHERE project = 'src5' AND kind = 'note'"))
def _(d: Data) -> DataFrame:
    return d.chunks.where((F.col("project") == "src5") & (F.col("kind") == "note")).select("id")


@query("filter_contains", sql("SELECT id FROM chunks WHERE contains(lower(title), 'tion') OR contains(lower(document), 'stthing')"))
def _(d: Data) -> DataFrame:
    return d.chunks.where(F.lower("title").contains("tion") | F.lower("document").contains("stthing")).select("id")


@query("ngram_filter", sql("SELECT id FROM chunks WHERE contains(lower(title), 'tion') OR contains(lower(document), 'stthing')"))
def _(d: Data) -> DataFrame:
    """:func:`filter_contains` by the trigram index."""
    asked = d.spark.createDataFrame([("t:", "tion"), ("d:", "stthing")], "sid string, text string")
    found = ngrams.containing(asked, d.grams)
    return found.where(F.col("id").startswith(F.col("sid"))).select(F.substring("id", 3, 1 << 20).alias("id")).distinct()


@query("ngram_contains", sql("SELECT item_id AS qid, id FROM benchmark b JOIN chunks c ON contains(lower(c.document), lower(substring(b.text, 5, 14)))"))
def _(d: Data) -> DataFrame:
    """A string of each question in all documents, as the constraints of the evidence gate are looked for."""
    found = ngrams.containing(d.queries.select(F.col("qid").alias("sid"), F.substring("text", 5, 14).alias("text")), d.grams)
    return found.where(F.col("id").startswith("d:")).select(F.col("sid").alias("qid"), F.substring("id", 3, 1 << 20).alias("id"))


@query("where_dsl_and", sql("SELECT id FROM records WHERE shortcode IS NOT DISTINCT FROM 'bad code!' AND source IN ('file0', 'file1', 'save_memory')"))
def _(d: Data) -> DataFrame:
    return d.records.where(policy.where({"$and": [{"shortcode": "bad code!"}, {"source": {"$in": ["file0", "file1", "save_memory"]}}]})).select("id")


@query("where_dsl_or", sql("SELECT id FROM records WHERE canonical_id IS NOT DISTINCT FROM 'can_1' OR shortcode IS NULL"))
def _(d: Data) -> DataFrame:
    return d.records.where(policy.where({"$or": [{"canonical_id": {"$eq": "can_1"}}, {"shortcode": None}]})).select("id")


@query("where_dsl_nin", sql("SELECT id FROM records WHERE (canonical_id IS NULL OR canonical_id NOT IN ('can_0', 'can_2')) AND shortcode IS DISTINCT FROM 'bad code!'"))
def _(d: Data) -> DataFrame:
    return d.records.where(policy.where({"canonical_id": {"$nin": ["can_0", "can_2"]}, "shortcode": {"$ne": "bad code!"}})).select("id")


@query("scope_filter", sql("SELECT id FROM chunks WHERE project IN ('src4', 'shared') AND kind = 'decision'"))
def _(d: Data) -> DataFrame:
    return d.chunks.where(policy.where(policy.scope("current", "src4", "decision"))).select("id")


@query("usable_filter", sql("SELECT id FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)"))
def _(d: Data) -> DataFrame:
    return policy.usable(d.chunks, d.usable_flags, ["doc_id"]).select("id")


@query("shortcode", sql("SELECT id, code FROM keyed"))
def _(d: Data) -> DataFrame:
    r = d.records
    return r.select("id", policy.shortcode({c: F.col(c) for c in r.columns if c != "doc_id"}).alias("code"))


@query("source_key", sql("SELECT id, source_key FROM keyed"))
def _(d: Data) -> DataFrame:
    r = d.records
    return r.select("id", policy.source_key({c: F.col(c) for c in r.columns if c != "doc_id"}).alias("source_key"))


# ---- joins and sets


@query("documentless", "SELECT e.vec_id, coalesce(d.text, '') AS document FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id * 3")
def _(d: Data) -> DataFrame:
    return d.table("embeddings").join(d.table("documents"), F.col("doc_id") == F.col("vec_id") * 3, "left").select("vec_id", F.coalesce("text", F.lit("")).alias("document"))


@query("semi_scope", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def _(d: Data) -> DataFrame:
    return d.table("orders").join(d.table("customer").where("c_nationkey < 5"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("project_lookup", "SELECT page_id, coalesce(n_name, 'shared') AS project FROM pages LEFT JOIN nation ON n_nationkey = page_id % 40")
def _(d: Data) -> DataFrame:
    return d.table("pages").join(d.table("nation"), F.col("n_nationkey") == F.col("page_id") % 40, "left").select("page_id", F.coalesce("n_name", F.lit("shared")).alias("project"))


@query("id_union", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 UNION SELECT doc_id FROM labels")
def _(d: Data) -> DataFrame:
    return d.table("documents").where("doc_id % 3 = 0").select("doc_id").union(d.table("labels").select("doc_id")).distinct()


@query("id_intersect", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 INTERSECT SELECT doc_id FROM labels")
def _(d: Data) -> DataFrame:
    return d.table("documents").where("doc_id % 3 = 0").select("doc_id").intersect(d.table("labels").select("doc_id"))


@query("id_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(d: Data) -> DataFrame:
    return d.table("documents").select("doc_id").subtract(d.table("labels").select("doc_id"))


@query("ordered_dedupe", "SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS words FROM (SELECT doc_id, w, min(p) AS p FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS p FROM documents) GROUP BY doc_id, w) GROUP BY doc_id")
def _(d: Data) -> DataFrame:
    return d.table("documents").select("doc_id", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("words"))


@query("distinct_projects", "SELECT DISTINCT source AS project FROM documents ORDER BY 1")
def _(d: Data) -> DataFrame:
    return d.table("documents").select(F.col("source").alias("project")).distinct().orderBy("project")


@query("project_counts", "SELECT source AS project, count(*) AS n FROM documents GROUP BY source")
def _(d: Data) -> DataFrame:
    return d.table("documents").groupBy(F.col("source").alias("project")).agg(F.count("*").alias("n"))


@query("majority_project", "SELECT lang, source AS project, n, n_projects FROM (SELECT lang, source, count(*) AS n, count(*) OVER (PARTITION BY lang) AS n_projects, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS k FROM documents GROUP BY lang, source) WHERE k = 1 AND n_projects > 1")
def _(d: Data) -> DataFrame:
    counted = d.table("documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    w = Window.partitionBy("lang")
    return counted.withColumn("n_projects", F.count("*").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.col("n").desc(), "source"))).where("k = 1 AND n_projects > 1").select("lang", F.col("source").alias("project"), "n", "n_projects")


@query("reduction_stats", "SELECT source, sum(length(text)) AS raw, sum(length(regexp_replace(text, '\\s+', ' ', 'g'))) AS kept, round(1 - sum(length(regexp_replace(text, '\\s+', ' ', 'g'))) / sum(length(text)), 6) AS saved FROM documents GROUP BY source")
def _(d: Data) -> DataFrame:
    raw, kept = F.sum(F.length("text")), F.sum(F.length(F.regexp_replace("text", r"\s+", " ")))
    return d.table("documents").groupBy("source").agg(raw.alias("raw"), kept.alias("kept"), F.round(1 - kept / raw, 6).alias("saved"))


@query("token_savings", "SELECT user_id, sum(would) AS would_have_tokens, sum(actual) AS actual_tokens, CAST(round_even(100.0 * (sum(would) - sum(actual)) / sum(would), 0) AS BIGINT) AS percent FROM (SELECT user_id, event_id % 1000 + 500 AS would, event_id % 300 AS actual FROM events) GROUP BY user_id")
def _(d: Data) -> DataFrame:
    would, actual = F.sum(F.col("event_id") % 1000 + 500), F.sum(F.col("event_id") % 300)
    return d.table("events").groupBy("user_id").agg(would.alias("would_have_tokens"), actual.alias("actual_tokens"), F.bround(100.0 * (would - actual) / would, 0).cast("long").alias("percent"))
