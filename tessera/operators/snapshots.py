"""Published snapshots of a table below a folder: numbered pointers, manifests, completion markers, rollback.

A snapshot is written once and never changed. What is current is the pointer of highest number; a pointer comes into being
by one rename that fails where its number is taken, so a reader sees the old snapshot or the new one, a crash leaves the
old one, and of two writers who started from one snapshot the second gets :class:`Conflict`.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTERS, MANIFESTS, MARKERS = "_pointers", "_manifests", "_complete"


class Conflict(RuntimeError):
    """Someone else has published since the snapshot was read."""


class Folder:
    """Files below a path of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop, self._conf = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self._conf)

    def path(self, name: str):
        return self._hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def put(self, name: str, text: str, overwrite: bool = False) -> None:
        """The file as a whole or not at all: written beside its place, then renamed."""
        beside = f"_writing/{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(beside), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.mkdirs(self.path(name).getParent())
        kinds = getattr(self._hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kinds, 1)
        options[0] = kinds.OVERWRITE if overwrite else kinds.NONE
        context = self._hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self._conf)
        try:
            context.rename(self.path(beside), self.path(name), options)
        except Exception as e:
            self.remove(beside)
            if "FileAlreadyExistsException" in str(e):
                raise Conflict(f"{name} exists") from e
            raise


def version(spark: SparkSession, root: str) -> int:
    """The number of the current pointer; 0 where nothing is published."""
    found = Folder(spark, root).names(POINTERS)
    return int(found[-1]) if found else 0


def current_name(spark: SparkSession, root: str, at: int | None = None) -> str | None:
    at = version(spark, root) if at is None else at
    folder, pointer = Folder(spark, root), f"{POINTERS}/{at:012d}"
    return folder.read(pointer) if at and folder.exists(pointer) else None


def current_snapshot(spark: SparkSession, root: str, at: int | None = None) -> DataFrame | None:
    """The published snapshot (or the one of version ``at``), or None."""
    name = current_name(spark, root, at)
    return None if name is None else spark.read.parquet(f"{root}/{name}")


def commit_snapshot(spark: SparkSession, df: DataFrame, root: str, name: str, based_on: int | None = None) -> str:
    """Write a snapshot below ``root`` and publish it. ``based_on`` is the version that ``df`` was made from; if another has
    been published since, nothing is and :class:`Conflict` is raised."""
    based_on = version(spark, root) if based_on is None else based_on
    df.write.mode("errorifexists").parquet(f"{root}/{name}")
    if version(spark, root) != based_on:
        raise Conflict(f"version {version(spark, root)} was published after {based_on}")
    Folder(spark, root).put(f"{POINTERS}/{based_on + 1:012d}", name)
    return name


def rollback(spark: SparkSession, root: str, to: int | None = None) -> str:
    """Publish the snapshot of an earlier version (the one before the current) again; its name."""
    now = version(spark, root)
    to = now - 1 if to is None else to
    if not 0 < to < now:
        raise ValueError(f"no version {to} before {now}")
    name = current_name(spark, root, to)
    folder = Folder(spark, root)
    if name is None or not folder.exists(name):
        raise ValueError(f"the files of version {to} are gone")
    folder.put(f"{POINTERS}/{now + 1:012d}", name)
    return name


def retain(spark: SparkSession, root: str, versions: int = 3) -> list[str]:
    """Remove the files of snapshots that none of the last ``versions`` pointers names; their names."""
    folder, now = Folder(spark, root), version(spark, root)
    kept = {current_name(spark, root, v) for v in range(max(1, now - versions + 1), now + 1)}
    gone = [n for n in folder.names("") if not n.startswith(("_", ".")) and n not in kept]
    for name in gone:
        folder.remove(name)
    for v in range(1, now - versions + 1):
        folder.remove(f"{POINTERS}/{v:012d}")
    return gone


def write_manifest(rows: DataFrame, root: str, name: str) -> DataFrame:
    """The manifest (id, hashes, ...) of a snapshot as JSON lines, read back."""
    path = f"{root}/{MANIFESTS}/{name}"
    rows.write.mode("overwrite").json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path)


def build(spark: SparkSession, rows: DataFrame, manifest: DataFrame, root: str, name: str, identity: dict, corpus_hash: str) -> dict:
    """Build and publish a snapshot with a manifest and a completion marker.

    The marker goes before anything changes and comes back last, when the rows that were written are as many as the
    manifest's: a build that breaks off leaves none.
    """
    folder = Folder(spark, root)
    folder.remove(f"{MARKERS}/{name}.json")
    based_on = version(spark, root)
    listed = write_manifest(manifest, root, name).count()
    commit_snapshot(spark, rows, root, name, based_on)
    written = spark.read.parquet(f"{root}/{name}").count()
    if written != listed:
        raise ValueError(f"{written} rows were written, the manifest lists {listed}")
    marker = {"name": name, "identity": identity, "corpus_hash": corpus_hash, "rows": written}
    folder.put(f"{MARKERS}/{name}.json", json.dumps(marker, sort_keys=True), overwrite=True)
    return marker


def completed(spark: SparkSession, root: str, name: str) -> dict | None:
    """The completion marker of a snapshot, or None."""
    folder = Folder(spark, root)
    return json.loads(folder.read(f"{MARKERS}/{name}.json")) if folder.exists(f"{MARKERS}/{name}.json") else None


def check(spark: SparkSession, root: str, identity: dict | None = None) -> dict[str, bool]:
    """What an index needs to be used: a pointer, a marker, as many rows as its manifest lists and the marker says, and the
    identity that is asked for."""
    name = current_name(spark, root)
    marker = completed(spark, root, name) if name else None
    folder = Folder(spark, root)
    rows = spark.read.parquet(f"{root}/{name}").count() if name and folder.exists(name) else -1
    listed = spark.read.text(f"{root}/{MANIFESTS}/{name}").count() if name and folder.exists(f"{MANIFESTS}/{name}") else -2
    return {
        "published": name is not None, "complete": marker is not None, "counts_agree": marker is not None and rows == listed == marker["rows"],
        "identity_agrees": marker is not None and (identity is None or marker["identity"] == identity),
    }


def unchanged(spark: SparkSession, root: str, identity: dict, corpus_hash: str) -> bool:
    """Whether the current snapshot was built completely, of this corpus, with this identity: then a rebuild may be skipped."""
    name = current_name(spark, root)
    marker = completed(spark, root, name) if name else None
    return marker is not None and marker["identity"] == identity and marker["corpus_hash"] == corpus_hash


def fingerprint(spark: SparkSession, root: str) -> DataFrame:
    """One row: files, bytes and a hash over names, sizes and contents of the files below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    line = F.concat(F.regexp_extract("path", r"([^/]+)$", 1), F.lit(":"), F.col("length").cast("string"), F.lit(":"), F.sha2("content", 256))
    hashes = files.select("length", F.sha2(line, 256).alias("h"))
    return hashes.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("hash"))
