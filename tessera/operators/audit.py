"""Audits of an index against the archive that it was made from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CHUNK_TOKENS


def findings(archive: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """Each category's ids. archive: (shortcode, usable, n_items); chunks: (id, shortcode, item, source, token_count)."""
    posts = chunks.where("shortcode is not null")
    listed = posts.select("shortcode").distinct()
    known = archive.select("shortcode")
    orphan = posts.join(archive, "shortcode").where("usable AND item > n_items").select("id")
    copies = chunks.where("shortcode is null").groupBy("source").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1").select("id")
    return {
        "usable_not_indexed": archive.where("usable").join(listed, "shortcode", "left_anti").select(F.col("shortcode").alias("id")),
        "unusable_indexed": archive.where("NOT usable").join(listed, "shortcode", "left_semi").select(F.col("shortcode").alias("id")),
        "orphan_items": orphan,
        "missing_archive": listed.join(known, "shortcode", "left_anti").select(F.col("shortcode").alias("id")),
        "duplicate_files": copies,
        "long_chunks": chunks.where(F.col("token_count") > CHUNK_TOKENS).select("id"),
    }


def summary(found: dict[str, DataFrame]) -> DataFrame:
    """(check, n), with 0 for a category without findings."""
    out = None
    for name, ids in found.items():
        one = ids.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def completeness(manifest: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """One row: lines of the manifest, rows of the store, and whether they are the same keys."""
    both = manifest.select(key).distinct().withColumn("m", F.lit(1)).join(rows.select(key).withColumn("r", F.lit(1)), key, "full_outer")
    return both.agg(F.count("m").alias("n_manifest"), F.count("r").alias("n_rows"), (F.count("*") == F.count(F.col("m") + F.col("r"))).alias("complete"))
