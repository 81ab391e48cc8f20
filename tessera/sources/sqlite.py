"""Rows of a SQLite file, read without ever writing to it."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows handed over at once.
BATCH = 5000


def read_sqlite(spark: SparkSession, path: str, sql: str, schema: str) -> DataFrame:
    """The rows that ``sql`` gives in the file at ``path``, as ``schema``.

    The file is opened read-only and read in one transaction, so a writer at the same time changes nothing of what is seen;
    a file that isn't there is an error, not a new file. One file is one task, which holds a batch at a time; the file must
    be where executors see it.
    """
    fields = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(fields)
        for batch in batches:
            for _ in range(batch.num_rows):
                con = sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)
                try:
                    con.execute("BEGIN")
                    found = con.execute(sql)
                    while rows := found.fetchmany(BATCH):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                finally:
                    con.close()

    return spark.range(0, 1, 1, 1).mapInArrow(run, fields)


def read_collection(spark: SparkSession, path: str, collection: str, keys: list[str]) -> DataFrame:
    """id, document and one column for each of ``keys`` of a collection in a vector store's SQLite file.

    Metadata is one row a key there; it is pivoted here. An embedding without any metadata keeps its row. Rows and metadata are
    two reads: where someone writes meanwhile, give a copy of the file.
    """
    from ..operators.store import eav_pivot

    name = collection.replace("'", "''")
    scope = f"segment_id IN (SELECT s.id FROM segments s JOIN collections c ON s.collection = c.id WHERE c.name = '{name}')"
    ids = read_sqlite(spark, path, f"SELECT id, embedding_id FROM embeddings WHERE {scope}", "__row long, id string")
    values = "coalesce(string_value, CAST(int_value AS TEXT), CAST(float_value AS TEXT), CASE bool_value WHEN 1 THEN 'true' WHEN 0 THEN 'false' END)"
    meta = read_sqlite(spark, path, f"SELECT id, key, {values} FROM embedding_metadata WHERE id IN (SELECT id FROM embeddings WHERE {scope})", "__row long, k string, v string")
    wide = eav_pivot(meta, "__row", "k", "v", ["chroma:document", *keys])
    return ids.join(wide, "__row", "left").drop("__row").withColumnRenamed("chroma:document", "document")
