"""Windows of epoched recordings.

Input has one row per channel and epoch: ``(<recording keys>, step_num,
epoch_idx, ch_idx, samples ARRAY<…>)``. All epochs of a recording are equally long.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_epoch(t_start: Column | float, period: Column | float, epoch_length: Column | float) -> Column:
    """Left binary search for ``t_start - period`` among the boundaries 0, L, 2L, ….

    The count of boundaries below a time is a division rounded up.
    """
    at = F.lit(t_start) - F.lit(period)
    return F.greatest(F.ceil(at / F.lit(epoch_length)), F.lit(0)).cast("bigint")


def first_boundary(boundaries: Column, time: Column) -> Column:
    """The same for an explicit sorted array of boundaries."""
    return F.size(F.filter(boundaries, lambda b: b < time)).cast("bigint")


def epoch_window(epochs: DataFrame, first: Column | int, n_epochs: int) -> DataFrame:
    first = F.lit(first)
    return epochs.where((F.col("epoch_idx") >= first) & (F.col("epoch_idx") < first + n_epochs))


def overlay_epochs(epochs: DataFrame, recording: Sequence[str]) -> DataFrame:
    """Each epoch with ``prev_samples``: same epoch and channel index, one step before."""
    at = [*recording, "step_num", "epoch_idx", "ch_idx"]
    previous = epochs.select(
        *recording, (F.col("step_num") + 1).alias("step_num"), "epoch_idx", "ch_idx", F.col("samples").alias("prev_samples")
    )
    return epochs.join(previous, at, "left")


def explode_epochs(epochs: DataFrame) -> DataFrame:
    """One row per sample; ``prev_value`` too if there are ``prev_samples``."""
    rest = [c for c in epochs.columns if c not in ("samples", "prev_samples")]
    if "prev_samples" not in epochs.columns:
        return epochs.select(*rest, F.posexplode("samples").alias("sample_idx", "value"))
    # The previous epoch may be longer; only what lies under this one is given.
    previous = F.slice(F.coalesce("prev_samples", F.array().cast(epochs.schema["prev_samples"].dataType)), F.lit(1), F.size("samples"))
    pairs = F.arrays_zip(F.col("samples").alias("value"), previous.alias("prev_value"))
    exploded = epochs.select(*rest, F.posexplode(pairs).alias("sample_idx", "_pair"))
    return exploded.select(*rest, "sample_idx", "_pair.*")


def concatenated(epochs: DataFrame, first: Column | int) -> DataFrame:
    """A window's epochs end to end, as blocks: ``start_sample`` counts from its start.

    Each epoch stays one row, so a long recording is not gathered in one array.
    """
    start = (F.col("epoch_idx") - F.lit(first)) * F.size("samples")
    return epochs.withColumn("start_sample", start.cast("bigint"))


def joined_traces(epochs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A window of few epochs as one array per channel, for one drawn trace."""
    return (
        epochs.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("epoch_idx", "samples"))).alias("_epochs"))
        .select(*keys, F.flatten(F.col("_epochs.samples")).alias("samples"))
    )
