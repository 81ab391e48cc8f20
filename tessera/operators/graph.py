"""Similarity graph of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import GRAPH_MIN_WEIGHT, GRAPH_NEIGHBOURS
from .dense import all_topk


def knn_graph(vectors: DataFrame, k: int = GRAPH_NEIGHBOURS, least: float = GRAPH_MIN_WEIGHT) -> DataFrame:
    """Undirected edges (a < b, weight): each vector with its ``k`` nearest of at least this similarity, the larger weight kept."""
    near = all_topk(vectors, k, least, skip_self=True)
    return near.groupBy(F.least("qid", "id").alias("a"), F.greatest("qid", "id").alias("b")).agg(F.round(F.max("similarity"), 3).alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def crossing(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between projects; ``nodes``: (id, project)."""
    x, y = nodes.select(F.col("id").alias("a"), F.col("project").alias("pa")), nodes.select(F.col("id").alias("b"), F.col("project").alias("pb"))
    return edges.join(x, "a").join(y, "b").where("pa <> pb").select("a", "b", "weight")


def nodes(chunks: DataFrame) -> DataFrame:
    text = F.when(F.length("document") > 400, F.concat(F.left("document", F.lit(400)), F.lit("…"))).otherwise(F.col("document"))
    return chunks.select("id", "title", "kind", "project", "date", text.alias("content"))
