"""Cumulative-snapshot collapse and rendering of logged conversations, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What stands before and after a turn's text.
HEAD, TAIL = "<|{role}|>\n", "<|end|>\n"


def turn_rows(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the text's MD5; null roles and texts count as empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.md5(text.cast("binary")).alias("digest"))


def hashed_prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), n_turns and the running 128-bit hash of the conversation up to that turn.

    The hash of a prefix is the XOR of hashes of (pos, role, MD5 of the text), so it rolls along the window in one pass
    and two logs share it exactly where their turns agree one by one; texts themselves aren't shuffled for it. Turns sort
    by turn, role, MD5; a null turn sorts first, and rows without conv_id make one conversation.
    """
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "digest")
    run = by_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turn_rows(turns).drop("text").withColumn("pos", F.row_number().over(by_turn).cast("long")).withColumn("n_turns", F.count("*").over(Window.partitionBy("conv_id")))
    a, b = (F.bit_xor(F.xxhash64(F.lit(seed), "pos", "role", "digest")).over(run) for seed in (11, 29))
    return placed.select("conv_id", "pos", "n_turns", a.alias("h1"), b.alias("h2"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that are no prefix of a longer one; of equal ones the least id stays."""
    hashed = hashed_prefixes(turns)
    whole = hashed.where("pos = n_turns").groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    prefixes = hashed.where("pos < n_turns").select(F.col("pos").alias("n_turns"), "h1", "h2").distinct()
    return whole.join(prefixes, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns", "n_copies")


def rendered_text(head: str = HEAD, tail: str = TAIL) -> Column:
    """An aggregate over :func:`turn_rows`: the conversation as one string."""
    before, after = head.split("{role}")
    line = lambda t: F.concat(F.lit(before), t["role"], F.lit(after), t["text"], F.lit("\n" + tail))
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "digest", "text"))), line), "")


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, rendered of each maximal conversation.

    Extra columns of ``turns`` are ignored; an empty table gives an empty result. Texts are shuffled once.
    """
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key")
    keep = maximal_conversations(turns).select(key, "n_turns", "n_copies")
    rows = turn_rows(turns).select(key, "*").join(keep, "key")
    return rows.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("n_turns").alias("n_turns"), F.max("n_copies").alias("n_copies"), rendered_text().alias("rendered")).drop("key")


ORACLE = r"""
WITH base AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n_turns,
         string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '')
           OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text) ROWS UNBOUNDED PRECEDING) AS rendered
  FROM base
), whole AS (
  SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, rendered FROM placed WHERE pos = n_turns GROUP BY n_turns, rendered
)
SELECT conv_id, n_turns, n_copies, rendered FROM whole w
WHERE NOT EXISTS (SELECT 1 FROM placed p WHERE p.pos < p.n_turns AND p.pos = w.n_turns AND p.rendered = w.rendered)
"""
