"""Exact histogram of encoded lengths, with answers for every context limit.

Documents are counted by their exact number of tokens. From the largest length
down, running sums of counts and of tokens give for each limit L how many
documents are longer, how many tokens remain if each is cut at L, and how many are
lost; running sums upwards give the share of documents that fit, hence every
quantile. Between two lengths that occur, all answers are linear in L
(``truncated_total``), so the rows of the histogram answer every limit.

The sums are made in two levels: within runs of lengths, and over the totals of the
runs, so no task gets all lengths.

Cases: a null or empty text has length 0; repeated rows count each; an empty
table gives no row; other columns are not read; ties are one row of the histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepview.llm import words
from stepview.llm.bpe import TOKENIZER
from stepview.llm.shared import col, saved

#: Lengths in a run.
RUN = 512


def encoded_lengths(docs: DataFrame, text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """``length`` of each row: the ids of its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = words.library_words(path)
        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            got = [len(table.ids(x.as_py())) // 4 for x in texts]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64())], names=["length"])

    return docs.select(col(text).alias("text")).mapInArrow(run, "length bigint")


def histogram(lengths: DataFrame, length: str = "length") -> DataFrame:
    """Per length that occurs: its documents and the sums from either end.

    ``n_docs``; ``n_up_to`` and ``tokens_up_to`` (documents of at most this length,
    and their tokens); ``n_longer`` and ``tokens_longer``; ``truncated_total`` (tokens
    that remain if every document is cut at this length) and ``lost``; ``share_up_to``
    (this length is the p-quantile for every p up to it, and above the row before).
    """
    counts = lengths.groupBy(col(length).cast("bigint").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))
    counts = saved(counts, "lengths")  # used twice below, and dear to count
    counts = counts.withColumn("tokens", F.col("length") * F.col("n_docs"))
    counts = counts.withColumn("run", F.floor(F.col("length") / RUN))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = counts.groupBy("run").agg(F.sum("n_docs").alias("n"), F.sum("tokens").alias("t"))
    runs = runs.select(
        "run",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "t")],
        *[F.sum(c).over(everything).alias(f"{c}_all") for c in ("n", "t")],
    )
    inside = Window.partitionBy("run").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    up = counts.join(runs, "run").select(
        "length",
        "n_docs",
        (F.col("n_before") + F.sum("n_docs").over(inside)).alias("n_up_to"),
        (F.col("t_before") + F.sum("tokens").over(inside)).alias("tokens_up_to"),
        "n_all",
        "t_all",
    )
    longer: Column = F.col("n_all") - F.col("n_up_to")
    remain: Column = F.col("tokens_up_to") + F.col("length") * longer
    return up.select(
        "length",
        "n_docs",
        "n_up_to",
        "tokens_up_to",
        longer.alias("n_longer"),
        (F.col("t_all") - F.col("tokens_up_to")).alias("tokens_longer"),
        remain.alias("truncated_total"),
        (F.col("t_all") - remain).alias("lost"),
        (F.col("n_up_to") / F.col("n_all")).alias("share_up_to"),
    )


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """``limit``, ``n_docs``, ``n_longer``, ``truncated_total`` and ``lost`` for each of a list of limits."""
    parts = []
    for at in limits:
        kept = F.least(F.col("length"), F.lit(at)) * F.col("n_docs")
        parts.append(F.struct(F.lit(at).cast("bigint").alias("limit"), F.sum(F.when(F.col("length") > at, F.col("n_docs")).otherwise(0)).alias("n_longer"), F.sum(kept).alias("truncated_total"), F.sum(F.col("length") * F.col("n_docs") - kept).alias("lost")))
    return hist.agg(F.sum("n_docs").alias("n_docs"), F.array(*parts).alias("parts")).select("n_docs", F.inline("parts"))


def quantile(hist: DataFrame, p: float) -> DataFrame:
    """The smallest length that at least the share ``p`` of the documents does not exceed."""
    return hist.where(F.col("share_up_to") >= p).agg(F.min("length").alias("length"))
