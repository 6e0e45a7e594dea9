"""Running totals and ranks within groups of any size, and exact quantiles.

A plain window over ``partitionBy(key)`` puts a whole group into one task. Here
the rows are range-partitioned on (key, order), so a big group spans many
chunks. Each chunk is numbered by itself and shifted by the sum of the chunks of
its group in front of it.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a new one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_dir()


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, columnar and prunable.

    The table goes away with the session.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stepview-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Let ``path`` go away with the session."""
    if getattr(spark, "_jvm", None) is not None:  # not with Spark Connect
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over ``spark.sql.shuffle.partitions`` tasks, for grouping by rows that are nearly all different.

    Partial sums of such rows only fill the memory in front of the shuffle, and of what is behind it AQE puts up to its
    advisory size into one task, of small rows many millions. A number that is asked for stays as it is.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _cut(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: Column, tag: str, partitions: int | None
) -> tuple[DataFrame, DataFrame]:
    """Rows with the number of their chunk, and the sum of each chunk's part of a group.

    The chunk numbers are written out before they are used twice: range bounds
    are sampled, so two evaluations could cut differently. The sums have
    one row per group and chunk: ``_sum``, ``_before`` (of the group's earlier
    chunks, 0 if none) and ``_all`` (of the whole group).
    """
    split = [*keys, *order]
    ranged = df.repartitionByRange(partitions, *split) if partitions else df.repartitionByRange(*split)
    chunked = materialize(ranged.withColumn("_chunk", F.spark_partition_id()), tag)
    group = Window.partitionBy(*keys)
    in_front = group.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    # A group has at most one row per chunk here, so these windows are short.
    sums = (
        chunked.groupBy(*keys, "_chunk")
        .agg(F.sum(weight).alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(in_front), F.lit(0)))
        .withColumn("_all", F.sum("_sum").over(group))
    )
    return chunked, sums


def _with_sums(chunked: DataFrame, sums: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """``chunked`` joined with its rows of ``sums``; NULL is a key like any other."""
    extra = [c for c in sums.columns if c not in (*keys, "_chunk")]
    named = sums.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_at"), *extra)
    same = [chunked[k].eqNullSafe(named[f"_{i}"]) for i, k in enumerate(keys)]
    same.append(chunked["_chunk"] == named["_at"])
    return chunked.join(named, functools.reduce(Column.__and__, same), how).select(chunked["*"], *extra)


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    weight: Column,
    into: str,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``into``: the sum of ``weight`` up to this row, per ``keys``, by ``order``.

    ``order`` names plain columns that put a group's rows in a total order.
    """
    chunked, sums = _cut(df, keys, order, weight, into, partitions)
    # Only the first group of a chunk can have begun in an earlier one, so this
    # has at most one row per chunk whatever the data: safe to broadcast.
    offsets = sums.where(F.col("_before") != 0).select(*keys, "_chunk", "_before")
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = chunked.withColumn(into, F.sum(weight).over(within))
    shifted = _with_sums(numbered, F.broadcast(offsets), keys, "left")
    return shifted.select(*df.columns, (F.col(into) + F.coalesce("_before", F.lit(0))).alias(into))


def rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    into: str,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``into``: the row's position in its group, from 1, as BIGINT."""
    return running_total(df, keys, order, F.lit(1).cast("bigint"), into, partitions)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    partitions: int | None = None,
) -> DataFrame:
    """One row per key with exact, linearly interpolated quantiles of ``value``.

    ``probs`` maps output names to probabilities. Equal values are counted on
    the map side and the counts cut into chunks by value. The chunks' sums
    tell which of them hold the wanted positions; only those are gone through,
    each by itself, so no task ever holds a group. NULL and NaN are left out.
    """
    known = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    counts = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    chunked, sums = _cut(counts, keys, [value], F.col("_n"), "quantiles", partitions)

    at = [F.lit(p) * (F.col("_all") - 1) for p in probs.values()]
    positions = F.array(*[edge(a) for a in at for edge in (F.floor, F.ceil)])
    begin, end = F.col("_before"), F.col("_before") + F.col("_sum")
    here = F.array_distinct(F.filter(positions, lambda k: (k >= begin) & (k < end)))
    wanted = sums.withColumn("_wanted", here).where(F.size("_wanted") > 0).drop("_sum")

    # Join and window share one shuffle on (keys, chunk).
    within = Window.partitionBy(*keys, "_chunk").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("_before") + F.sum("_n").over(within)
    searched = _with_sums(chunked, wanted, keys, "inner").withColumn("_upto", upto)
    hit = F.filter("_wanted", lambda k: (k >= F.col("_upto") - F.col("_n")) & (k < F.col("_upto")))
    hits = searched.select(*keys, "_all", value, F.explode(hit).alias("_k"))

    picks = []
    for i, a in enumerate(at):
        picks.append(F.min(F.when(F.col("_k") == F.floor(a), F.col(value))).alias(f"_lo{i}"))
        picks.append(F.min(F.when(F.col("_k") == F.ceil(a), F.col(value))).alias(f"_hi{i}"))
    found = hits.groupBy(*keys, "_all").agg(*picks)

    def between(i: int) -> Column:
        return F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (at[i] - F.floor(at[i]))

    return found.select(*keys, *[between(i).alias(name) for i, name in enumerate(probs)])
