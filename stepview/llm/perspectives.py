"""Multi-party perspective rotation of dialogues.

For every participant of a conversation, the whole conversation is given once with
that participant as the assistant: its turns have role ``assistant`` and count for
training, all others are users by name and are masked. The result has one row per
conversation, perspective and turn, ordered by ``turn``, so a conversation of any
length is spread over many rows and tasks; nothing is gathered.

A join of the turns with the conversation's participants makes it: each turn meets each
participant once, which is the result's own size.

Cases: a null role is a participant named ``unknown``; a null text is an empty turn;
null ids or turn numbers are kept as they are; repeated rows are turns of their own; an
empty table gives none; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepview.llm.shared import col, saved

NOBODY = "unknown"


def rotate(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """``conv_id``, ``perspective``, ``turn``, ``role``, ``name`` (of users), ``content``, ``rendered``, ``mask``.

    ``mask`` is 1 where the turn is trained on.
    """
    said = turns.select(
        col(conversation).alias("conv_id"),
        col(turn).alias("turn"),
        F.coalesce(col(speaker), F.lit(NOBODY)).alias("speaker"),
        F.coalesce(col(text), F.lit("")).alias("content"),
    )
    # Written first: then both sides of the join are plain shuffles, and a conversation with
    # very many turns can be split.
    parties = saved(said.groupBy("conv_id", F.col("speaker").alias("perspective")).agg(F.count(F.lit(1)).alias("n")).drop("n"), "parties")
    parties = parties.withColumnRenamed("conv_id", "of")
    each = said.join(parties, F.col("conv_id").eqNullSafe(F.col("of")))
    own = F.col("speaker") == F.col("perspective")
    return each.select(
        "conv_id",
        "perspective",
        "turn",
        F.when(own, "assistant").otherwise("user").alias("role"),
        F.when(~own, F.col("speaker")).alias("name"),
        "content",
        rendered(own, F.col("speaker"), F.col("content")).alias("rendered"),
        own.cast("int").alias("mask"),
    )


def rendered(own: Column, speaker: Column, content: Column) -> Column:
    """A turn as the template writes it."""
    head = F.when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), speaker, F.lit("|>\n")))
    return F.concat(head, content, F.lit("\n<|end|>\n"))


SQL = """
WITH said AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS content FROM conversations),
parties AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said)
SELECT said.conv_id, perspective, turn, CASE WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
  CASE WHEN speaker <> perspective THEN speaker END AS name, content,
  CASE WHEN speaker = perspective THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || speaker || '|>' || chr(10) END || content || chr(10) || '<|end|>' || chr(10) AS rendered,
  CAST(speaker = perspective AS INTEGER) AS mask
FROM said JOIN parties ON said.conv_id IS NOT DISTINCT FROM parties.conv_id
"""
