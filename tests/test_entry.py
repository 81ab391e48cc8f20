"""The driver's contract: names agree, and queries equal their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
FAST = (
    "import_chats import_sessions import_projects read_questions content_hashes corpus_hash index_build rollback repair upsert_merge replace_source result_lines search_knowledge rerank_blend "
    "search_degraded threshold_sweep dedupe_names ordered_dedupe fetch_json stream_ingest session_windows light_stem eval_queries config_verdict postings bm25 rrf_fusion vector_topk similarity_graph shortcode source_key sync_diff audit_summary run_length_chain chunk_windows ir_metrics where_dsl_nin hybrid_search"
).split()


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", FAST)
def test_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DIR):
        at = f"{DIR}/{f}"
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    df = entry.queries()[name](spark, DIR)
    want = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(df.columns)
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    order = sorted(cols)
    got = sorted(repr([norm(r[c]) for c in order]) for r in df.collect())
    assert got == sorted(repr([norm(r[cols.index(c)]) for c in order]) for r in want.fetchall())
