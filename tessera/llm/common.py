"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Rows and bytes of one Arrow batch. A batch of whole texts is held in memory at once, so the defaults are too many; a
#: single longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def settled(spark: SparkSession) -> SparkSession:
    """The session, changed for good: with batches that fit memory, and without the guess that a union is partitioned as its children are
    (which lets repeated rows pass a later distinct)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; it is read by Spark alone, so any store that Spark reads will do."""
    return settled(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """Run ``fn`` over batches of ``df``: columns in, as Python lists, columns of ``schema`` out.

    ``fn`` must be picklable; it sees one bounded batch at a time and keeps nothing of it.
    """
    settled(df.sparkSession)
    names = [part.strip().split()[0] for part in _split(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = fn(dict(zip(batch.schema.names, (c.to_pylist() for c in batch.columns))))
            target = target or [_arrow_type(t) for t in types]
            yield pa.RecordBatch.from_arrays([pa.array(out[n], type=t) for n, t in zip(names, target)], names=names)

    types = [part.strip().split(None, 1)[1] for part in _split(schema)]
    return df.mapInArrow(run, schema)


def arrow_filter(df: DataFrame, columns: list[str], verdict: Callable[[dict], list[bool]]) -> DataFrame:
    """The rows of ``df``, whatever their other columns, for which ``verdict`` over ``columns`` is true."""
    settled(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(verdict({c: batch.column(c).to_pylist() for c in columns}), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def arrow_replace(df: DataFrame, columns: list[str], fn: Callable[[dict], dict]) -> DataFrame:
    """``df`` with the columns that ``fn`` gives in place of its own; other columns pass as they are."""
    settled(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                new = fn({c: batch.column(c).to_pylist() for c in columns})
                names = batch.schema.names
                yield pa.RecordBatch.from_arrays([pa.array(new[n], batch.schema.field(n).type) if n in new else batch.column(n) for n in names], schema=batch.schema)

    return df.mapInArrow(run, df.schema)


def arrow_add(df: DataFrame, columns: list[str], fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """``df`` with the columns of ``schema`` that ``fn`` makes of ``columns``; their names must be new."""
    settled(df.sparkSession)
    names = [part.strip().split()[0] for part in _split(schema)]
    types = [part.strip().split(None, 1)[1] for part in _split(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                new = fn({c: batch.column(c).to_pylist() for c in columns})
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(new[n], type=_arrow_type(t)) for n, t in zip(names, types))], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, StructType([*df.schema, *StructType.fromDDL(schema)]))


def _split(schema: str) -> list[str]:
    return [p for p in schema.split(",") if p.strip()]


def _arrow_type(name: str) -> pa.DataType:
    name = name.strip().lower()
    if name.startswith("array<"):
        return pa.list_(_arrow_type(name[6:-1]))
    return {
        "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(),
        "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
    }[name]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session may leave it unset, and gets
    a folder of its own; on a cluster that would be another disk for each machine, so there it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """The files at ``path`` go when the session's JVM ends."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: lineage ends there, and a lost executor loses nothing.

    The files go when the session's JVM ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    drop_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a :func:`staged` table that nothing reads any more."""
    spark = df.sparkSession
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_at)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)
