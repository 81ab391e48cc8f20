"""Readers of files, and the pages and reports that come of them."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.sources import exports, parse, sqlite


def test_documents_are_read_by_name(spark, tmp_path):
    for name in ("a.md", "b/c.txt", "b/d.rst", "e.py", ".venv/f.md", "kg_db/g.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"text of {name}\nline")
    got = {r.path.split(f"{tmp_path}/")[1]: r.text for r in parse.read_documents(spark, [str(tmp_path)]).collect()}
    assert got == {n: f"text of {n}\nline" for n in ("a.md", "b/c.txt", "b/d.rst")}


def test_chats(spark, tmp_path):
    blocks = [{"type": "text", "text": " hi "}, {"type": "tool_use", "name": "x"}, {"type": "text", "text": "there"}]
    chats = [
        {"uuid": "u1", "name": " A b ", "created_at": "2026-01-02T03", "chat_messages": [{"sender": "human", "text": "old", "content": blocks}, {"sender": "assistant", "text": " yo "}, {"sender": "human", "text": "  "}]},
        {"uuid": "u2", "name": None, "chat_messages": []},
    ]
    (tmp_path / "c.json").write_text(json.dumps(chats))
    got = {r.uuid: (r.name, r.n, r.markdown) for r in exports.read_chats(spark, str(tmp_path / "c.json")).collect()}
    assert got == {
        "u1": ("A b", 2, "# A b\n\nSana: 2026-01-02  \nUUID: u1\n\n**Human:**\n\nhi\n\nthere\n\n**Assistant:**\n\nyo\n"),
        "u2": ("chat", 0, "# Suhbat\n\nUUID: u2\n"),
    }


def test_projects(spark, tmp_path):
    projects = [{"name": "P", "description": "d", "created_at": "2026-01-02T", "archived": True, "instructions": " do ", "docs": [{"name": "n", "content": " c "}, {"content": ""}]}, {"name": "E", "docs": []}, {"name": "T", "prompt_template": " x "}]
    (tmp_path / "p.json").write_text(json.dumps(projects))
    got = {r["name"]: r.markdown for r in exports.read_projects(spark, str(tmp_path / "p.json")).collect()}
    assert got == {"P": "# P\n\nd  \nYaratilgan: 2026-01-02  \nHolat: arxivlangan\n\n## Project instructions\n\ndo\n\n## Hujjat: n\n\nc\n", "T": "# T\n\n## Project instructions\n\nx\n"}
    assert exports.read_projects(spark, str(tmp_path / "p.json"), include_empty=True).count() == 3


def test_no_task_of_the_jvm_gathers_a_project(spark, tmp_path):
    """Pages are those of whole projects in order, though neither their files nor their pages are gathered by an aggregate."""
    from tessera.plans import catalog

    texts = [(10, "b", "  second\u00a0\n"), (9, "b", "first, \"quoted\"\nline"), (3, "a/ b", None), (4, "a/ b", " \n"), (7, "a/ b", "x"), (1, "none", " ")]
    rows = [(i, t, "en", s) for i, s, t in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    df = catalog.QUERIES["import_projects"](spark, str(tmp_path))
    head = lambda p: f"# {p}\n\nUUID: u{p}  \nAll of {p}\n\n## Project instructions\n\nKeep it."
    assert sorted(map(tuple, df.collect())) == [
        ("ua/ b", "a/ b", 1, head("a/ b") + "\n\n## Hujjat: doc_7\n\nx\n"), ("ub", "b", 2, head("b") + '\n\n## Hujjat: doc_9\n\nfirst, "quoted"\nline\n\n## Hujjat: doc_10\n\nsecond\n'), ("unone", "none", 0, head("none") + "\n"),
    ]
    assert "Aggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_pages_of_projects_without_documents(spark, tmp_path):
    projects = [{"name": "W", "description": "ends \u2003\t", "docs": None}, {"uuid": "k", "docs": [{"filename": "f", "name": "n", "content": "c"}, None]}]
    (tmp_path / "p.json").write_text(json.dumps(projects))
    assert sorted(tuple(r) for r in exports.read_projects(spark, str(tmp_path / "p.json"), include_empty=True).select("name", "n_docs", "markdown").collect()) == [("W", 0, "# W\n\nends\n"), ("project", 1, "# Project\n\nUUID: k\n\n## Hujjat: f\n\nc\n")]


def test_design_chats(spark, tmp_path):
    for k, chat in enumerate(({"uuid": "d", "title": "chat", "project": {"name": "Pr"}, "messages": [{"role": "user", "content": {"content": " q "}}, {"role": "a", "content": "r"}, {"role": "a", "content": ""}]}, {"uuid": "e", "title": "", "project": "Own"})):
        (tmp_path / f"{k}.json").write_text(json.dumps(chat))
    got = {r.uuid: (r["name"], r.n, r.markdown) for r in exports.read_design_chats(spark, str(tmp_path)).collect()}
    assert got["d"] == ("Pr-chat", 2, "# chat\n\nUUID: d  \nLoyiha: Pr\n\n**Human:**\n\nq\n\n**Assistant:**\n\nr\n") and got["e"][1] == 0


def test_sessions(spark, tmp_path):
    use = lambda *names: {"type": "assistant", "cwd": "/b", "message": {"content": [{"type": "tool_use", "name": n} for n in names]}}
    lines = [
        {"type": "user", "timestamp": "2026-03-04T1", "cwd": "/a", "sessionId": "S", "message": {"content": " Hello   you "}}, "{broken", use("Bash"), use("Bash", "Read"),
        {"type": "assistant", "cwd": "/a", "message": {"content": [{"type": "text", "text": "done"}, "str", {"type": "tool_use"}, {"type": "thinking", "thinking": "x"}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "content": "z"}]}}, use("Grep"), {"type": "ai-title", "aiTitle": "AI"}, {"type": "ai-title", "aiTitle": "AI2"},
    ]
    (tmp_path / "x.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    (tmp_path / "y.jsonl").write_text(json.dumps({"type": "user", "message": {"content": "w " * 60}}))
    (tmp_path / "z.jsonl").write_text(json.dumps({"type": "custom-title", "customTitle": "T"}) + "\n" + json.dumps({"type": "ai-title", "aiTitle": "U"}))
    got = {r.session_id: r for r in exports.read_sessions(spark, str(tmp_path)).collect()}
    assert (got["S"].title, got["S"].date, got["S"].cwd, got["S"].n_messages, got["S"].n_tools) == ("AI2", "2026-03-04", "/a, /b", 5, 5)
    assert got["S"].markdown == "# AI2\n\nSana: 2026-03-04  \nSession ID: S  \nCWD: /a, /b\n\n**Human:**\n\nHello   you\n\n_[tools: Bash x2 -> Read]_\n\n**Assistant:**\n\ndone\n\nstr\n\n_[tools: tool]_\n\n_[tools: Grep]_\n"
    assert got["y"].title == ("w " * 60)[:60] and got["z"].title == "T" and got["z"].n_messages == 0


def test_questions(spark, tmp_path):
    rows = [{"id": "1", "query": "q", "expected_ids": ["a"]}, {"id": "2", "query": " "}]
    (tmp_path / "q.json").write_text(json.dumps(rows))
    (tmp_path / "q.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nbroken\n")
    for name in ("q.json", "q.jsonl"):
        assert [(r.id, r.query, r.expected_ids) for r in exports.read_questions(spark, str(tmp_path / name)).collect()] == [("1", "q", ["a"])]


def test_reports_and_their_figures(spark, tmp_path):
    exports.write_report(spark.createDataFrame([("a", 1, 0.5), (None, 2, 1.0)], "n string, k long, v double").coalesce(1), str(tmp_path / "r"), "T")
    assert [r.value for r in spark.read.text(str(tmp_path / "r/report.md")).collect()] == ["# T", "", "| n | k | v |", "| --- | --- | --- |", "| a | 1 | 0.5000 |", "|  | 2 | 1.0000 |"]
    assert spark.read.json(str(tmp_path / "r/report.json")).count() == 2
    one = spark.range(1).select(tx.html_escape(F.lit("<a href=\"x\">'&'</a>")), tx.thousands(F.lit(1234567)), tx.percent(F.lit(1), F.lit(8)), tx.percent(F.lit(1), F.lit(0))).first()
    assert tuple(one) == ("&lt;a href=&quot;x&quot;&gt;&#x27;&amp;&#x27;&lt;/a&gt;", "1,234,567", "12.5%", "0.0%")


def test_vector_store_file(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "store file.sqlite3")
    con = sqlite3.connect(path)
    con.executescript("""
      CREATE TABLE collections (id TEXT, name TEXT); CREATE TABLE segments (id TEXT, collection TEXT); CREATE TABLE embeddings (id INTEGER, segment_id TEXT, embedding_id TEXT);
      CREATE TABLE embedding_metadata (id INTEGER, key TEXT, string_value TEXT, int_value INTEGER, float_value REAL, bool_value INTEGER);
      INSERT INTO collections VALUES ('c1', 'kb'), ('c2', 'other'); INSERT INTO segments VALUES ('s1', 'c1'), ('s2', 'c2');
      INSERT INTO embeddings VALUES (1, 's1', 'a'), (2, 's1', 'b'), (3, 's2', 'c');
      INSERT INTO embedding_metadata VALUES (1, 'chroma:document', 'text', NULL, NULL, NULL), (1, 'n', NULL, 7, NULL, NULL), (1, 'ok', NULL, NULL, NULL, 1), (3, 'n', NULL, 9, NULL, NULL);
    """)
    con.commit()
    con.close()
    got = {r.id: (r.document, r.n, r.ok) for r in sqlite.read_collection(spark, path, "kb", ["n", "ok"]).collect()}
    assert got == {"a": ("text", "7", "true"), "b": (None, None, None)}
    with pytest.raises(Exception, match="unable to open"):
        sqlite.read_sqlite(spark, str(tmp_path / "absent"), "SELECT 1", "x long").collect()
