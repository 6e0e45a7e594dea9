"""Windows, overlays and display scaling of multichannel signals.

Long form has one row per sample:
``(<recording keys>, step_num, ch_name, sample_idx, value)``. Stored form has
one row per channel and block:
``(…, ch_idx, ch_name, ch_type, start_sample, samples ARRAY<…>)``. The array
functions work on blocks before they are exploded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepview.operators.ranking import exact_quantiles

# ---------------------------------------------------------------- long form


def window(
    signal: DataFrame,
    start: int,
    stop: int | None = None,
    picks: Sequence[str] | Sequence[int] | None = None,
    channel: str = "ch_name",
) -> DataFrame:
    """Samples ``start`` up to, not including, ``stop`` (open if None) of the picked channels.

    ``picks`` are values of the column ``channel``: names or, with ``"ch_idx"``, indices.
    """
    inside = F.col("sample_idx") >= start
    if stop is not None:
        inside &= F.col("sample_idx") < stop
    if picks is not None:
        inside &= F.col(channel).isin(*picks)
    return signal.where(inside)


def overlay(signal: DataFrame, recording: Sequence[str], channel: str = "ch_idx", carried: Sequence[str] = ()) -> DataFrame:
    """Each sample with ``prev_value``, that of the step numbered one less, or NULL.

    Samples meet by channel and sample index. ``channel="ch_name"`` aligns by
    name instead. Each (recording, step, channel, sample) may occur
    once. Every sample is emitted under its own step and under the next, and the
    two halves meet in one aggregation: one scan, one shuffle, no sort.
    """
    value, num = F.col("value"), F.col("step_num")
    nothing = F.lit(None).cast(signal.schema["value"].dataType)
    own = [F.col(c).alias(c) for c in carried]
    blank = [F.lit(None).cast(signal.schema[c].dataType).alias(c) for c in carried]
    halves = F.array(
        F.struct(num.alias("step_num"), F.lit(True).alias("own"), value.alias("value"), nothing.alias("prev"), *own),
        F.struct((num + 1).alias("step_num"), F.lit(False).alias("own"), nothing.alias("value"), value.alias("prev"), *blank),
    )
    keys = [*recording, "step_num", channel, "sample_idx"]
    return (
        signal.select(*recording, channel, "sample_idx", F.explode(halves).alias("_half"))
        .select(*recording, channel, "sample_idx", "_half.*")
        .groupBy(*keys)
        .agg(
            F.max("own").alias("_own"),
            F.max("value").alias("value"),
            F.max("prev").alias("prev_value"),
            *[F.max(c).alias(c) for c in carried],
        )
        .where("_own")
        .drop("_own")
    )


def or_nan(value: Column) -> Column:
    """The placeholder for a trace that is not there."""
    return F.coalesce(value, F.lit(float("nan")))


def auto_scales(signal: DataFrame, keys: Sequence[str], partitions: int | None = None) -> DataFrame:
    """``scale`` per key: one over the interquartile range; 1 where that is 0."""
    quartiles = exact_quantiles(signal, keys, "value", {"_q1": 0.25, "_q3": 0.75}, partitions)
    spread = F.col("_q3") - F.col("_q1")
    return quartiles.select(*keys, F.when(spread > 0, 1 / spread).otherwise(1.0).alias("scale"))


def trace(value: Column, offset: Column, scale: Column) -> Column:
    return offset - value * scale


def clip_band(offset: Column, y_bottom: float, y_top: float, butterfly: bool = False) -> tuple[Column, Column]:
    """Lower and upper edge of the band a trace is clipped to.

    The y-axis points down: ``y_bottom`` is the larger limit.
    """
    half = 0.2 if butterfly else 0.5
    lo = F.greatest(offset - half, F.lit(float(y_top)))
    return lo, lo + F.least(F.lit(2 * half), F.lit(float(y_bottom)) - lo)


def clamp(y: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(F.least(y, hi), lo)


def display(
    samples: DataFrame,
    mode: str,
    scales: DataFrame | None = None,
    scale_keys: Sequence[str] = (),
    kind: str = "raw",
    y_limits: tuple[float, float] | None = None,
) -> DataFrame:
    """Add ``y``, the trace position, under a y-axis mode.

    ``overdraw`` leaves the values unscaled, ``normalize`` multiplies by
    ``scales``, ``clamp`` (or ``clip``) holds the trace in its band and
    applies to raw recordings only. ``samples`` needs ``ch_idx`` and ``value``.
    """
    if mode not in ("overdraw", "normalize", "clamp", "clip"):
        raise ValueError(f"unknown y-axis mode: {mode}")
    offset = F.col("ch_idx").cast("double")
    scale = F.lit(1.0)
    if mode == "normalize":
        samples = samples.join(scales.select(*scale_keys, F.col("scale").alias("_scale")), list(scale_keys), "left")
        scale = F.coalesce("_scale", F.lit(1.0))
    y = trace(F.col("value"), offset, scale)
    if mode in ("clamp", "clip") and kind == "raw":
        y = clamp(y, *clip_band(offset, *y_limits))
    return samples.withColumn("y", y).drop("_scale")


def decimation(decim: int, is_data: Column) -> Column:
    """Data channels by ``decim``, all others not at all."""
    return F.when(is_data, F.lit(decim)).otherwise(F.lit(1))


def decimate(samples: DataFrame, start: int, factor: Column) -> DataFrame:
    """Every ``factor``-th sample, counted from the start of the window."""
    return samples.where((F.col("sample_idx") - start) % factor == 0)


def sample_time(sample_idx: Column, sfreq: Column | float, first_time: Column | float = 0.0) -> Column:
    sfreq = sfreq if isinstance(sfreq, Column) else F.lit(float(sfreq))
    first_time = first_time if isinstance(first_time, Column) else F.lit(float(first_time))
    return sample_idx / sfreq + first_time


def extent(samples: DataFrame, keys: Sequence[str], sfreq: float, first_time: float = 0.0) -> DataFrame:
    """First and last sample time of the window, per key."""
    time = sample_time(F.col("sample_idx"), sfreq, first_time)
    return samples.groupBy(*keys).agg(F.min(time).alias("t_first"), F.max(time).alias("t_last"))


# -------------------------------------------------------------- stored form


def to_blocks(signal: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Long form to blocks of ``size`` samples that start at multiples of ``size``.

    ``keys`` name everything but the sample. Samples must be gapless
    within a block.
    """
    number = F.floor(F.col("sample_idx") / size).cast("bigint")
    return (
        signal.groupBy(*keys, number.alias("_block"))
        .agg(
            F.min("sample_idx").alias("start_sample"),
            F.array_sort(F.collect_list(F.struct("sample_idx", "value"))).alias("_sorted"),
        )
        .select(*keys, "start_sample", F.col("_sorted.value").alias("samples"))
    )


def reblock(blocks: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Blocks of another length, so that two steps share their boundaries."""
    return to_blocks(explode_blocks(blocks), keys, size)


def explode_blocks(blocks: DataFrame) -> DataFrame:
    rest = [c for c in blocks.columns if c not in ("start_sample", "samples")]
    return blocks.select(*rest, "start_sample", F.posexplode("samples").alias("_pos", "value")).select(
        *rest, (F.col("start_sample") + F.col("_pos")).alias("sample_idx"), "value"
    )


def window_blocks(
    blocks: DataFrame,
    start: int,
    stop: int | None = None,
    picks: Sequence[str] | Sequence[int] | None = None,
    size: int | None = None,
    channel: str = "ch_name",
) -> DataFrame:
    """``window`` on blocks: unneeded ones are dropped, those at the edges cut.

    With the block length ``size``, the lower bound becomes a plain comparison
    with ``start_sample``, which the Parquet reader uses to skip row groups.
    """
    first = F.col("start_sample")
    inside = first + F.size("samples") > start
    if size is not None:
        inside &= first > start - size
    if stop is not None:
        inside &= first < stop
    if picks is not None:
        inside &= F.col(channel).isin(*picks)
    skipped = F.greatest(F.lit(start) - first, F.lit(0)).cast("int")
    end = F.size("samples") if stop is None else F.least(F.size("samples"), (F.lit(stop) - first).cast("int"))
    return (
        blocks.where(inside)
        .withColumn("_skip", skipped)
        .withColumn("samples", F.slice("samples", F.col("_skip") + 1, end - F.col("_skip")))
        .withColumn("start_sample", first + F.col("_skip"))
        .drop("_skip")
    )


def overlay_blocks(blocks: DataFrame, recording: Sequence[str], channel: str = "ch_idx") -> DataFrame:
    """``overlay`` on blocks with common boundaries; adds ``prev_samples`` and ``status``.

    ``status`` is ``overlaid``, ``no_previous`` or, if the two recordings are
    of different ``kind`` (a column of ``blocks``), ``kind_mismatch`` with no
    overlay. An epoched signal also meets by ``epoch_idx``. One row
    stands for a whole block, so a join moves few rows.
    """
    at = [*recording, "step_num", channel, "start_sample"]
    previous = blocks.select(
        *recording,
        (F.col("step_num") + 1).alias("step_num"),
        channel,
        "start_sample",
        F.col("epoch_idx").alias("_epoch"),
        F.col("kind").alias("_kind"),
        F.col("samples").alias("_samples"),
    )
    same = [blocks[c] == previous[c] for c in at]
    same.append(blocks["epoch_idx"].eqNullSafe(previous["_epoch"]))
    matches = F.col("kind") == F.col("_kind")
    joined = blocks.join(previous, same, "left").select(blocks["*"], "_kind", "_samples")
    return joined.select(
        *blocks.columns,
        F.when(matches, F.col("_samples")).alias("prev_samples"),
        F.when(F.col("_kind").isNull(), "no_previous").when(matches, "overlaid").otherwise("kind_mismatch").alias("status"),
    )


def overlay_overlapping(blocks: DataFrame, recording: Sequence[str], cell: int, channel: str = "ch_idx") -> DataFrame:
    """``overlay`` of blocks of any lengths: pieces of them with ``prev_samples``, the samples of the step before under them.

    Blocks of both steps are cut at multiples of ``cell`` samples, as arrays, and what lies in one cell meets in one
    group, so nothing is unpacked and a group is no larger than its cell. ``prev_samples`` is as long as
    ``samples``, NULL where the step before has none, and NULL as a whole if it has none of this kind at all under the
    piece. Columns besides ``start_sample`` and ``samples`` stay. An epoched signal also meets by ``epoch_idx``.
    """
    first, size = F.col("start_sample"), F.size("samples")
    cells = F.sequence(F.floor(first / cell), F.floor((first + size - 1) / cell))
    begin = F.greatest(first, F.col("_cell") * cell)
    end = F.least(first + size, (F.col("_cell") + 1) * cell)
    rest = [c for c in blocks.columns if c not in (*recording, "step_num", channel, "epoch_idx", "start_sample", "samples")]
    pieces = (
        blocks.where(size > 0)
        .withColumn("_cell", F.explode(cells))
        .withColumn("samples", F.slice("samples", (begin - first + 1).cast("int"), (end - begin).cast("int")))
        .withColumn("start_sample", begin)
    )
    piece = F.struct("start_sample", "samples", *rest)
    sides = F.array(F.struct(F.col("step_num").alias("step_num"), F.lit(True).alias("own")), F.struct((F.col("step_num") + 1).alias("step_num"), F.lit(False).alias("own")))
    keys = [*recording, "step_num", channel, "epoch_idx", "_cell"]
    met = (
        pieces.select(*recording, channel, "epoch_idx", "_cell", piece.alias("_piece"), F.explode(sides).alias("_side"))
        .select(*recording, channel, "epoch_idx", "_cell", "_piece", "_side.*")
        .groupBy(*keys)
        .agg(
            F.collect_list(F.when(F.col("own"), F.col("_piece"))).alias("_own"),
            F.array_sort(F.collect_list(F.when(~F.col("own"), F.col("_piece")))).alias("_prev"),
        )
        .where(F.size("_own") > 0)
    )
    nothing = F.lit(None).cast(blocks.schema["samples"].dataType.elementType)

    def under(own: Column) -> Column:
        """The earlier pieces of the same kind laid end to end, gaps filled, and cut to what is under ``own``."""
        start, length = own["start_sample"], F.size(own["samples"])
        stop = start + length

        def fits(p: Column) -> Column:
            over = (p["start_sample"] < stop) & (p["start_sample"] + F.size(p["samples"]) > start)
            return over & (p["kind"] == own["kind"]) if "kind" in rest else over

        fit = F.filter("_prev", fits)
        cut = F.transform(
            fit,
            lambda p: F.struct(
                F.greatest(p["start_sample"], start).alias("at"),
                F.slice(p["samples"], (F.greatest(start - p["start_sample"], F.lit(0)) + 1).cast("int"), F.size(p["samples"])).alias("samples"),
            ),
        )

        def filled(made: Column, to: Column) -> Column:
            return F.concat(made, F.array_repeat(nothing, F.greatest(to - start - F.size(made), F.lit(0)).cast("int")))

        none = F.array().cast(blocks.schema["samples"].dataType)
        laid = F.aggregate(cut, none, lambda made, p: F.concat(filled(made, p["at"]), p["samples"]), lambda made: F.slice(filled(made, stop), F.lit(1), length))
        return F.when(F.size(fit) > 0, laid)

    joined = F.transform("_own", lambda o: F.struct(*[o[c].alias(c) for c in ("start_sample", "samples", *rest)], under(o).alias("prev_samples")))
    return met.select(*recording, "step_num", channel, "epoch_idx", F.inline(joined)).select(*blocks.columns, "prev_samples")


def decimate_blocks(blocks: DataFrame, start: int, factor: Column) -> DataFrame:
    """``decimate`` on blocks: rows ``(…, times ARRAY<BIGINT>, samples)`` of kept samples."""
    first = F.col("start_sample")
    positions = F.sequence(F.lit(0), F.size("samples") - 1)
    kept = F.filter(positions, lambda i: (first + i - start) % factor == 0)
    return (
        blocks.where(F.size("samples") > 0)
        .withColumn("_kept", kept)
        .withColumn("sample_idx", F.transform("_kept", lambda i: first + i))
        .withColumn("samples", F.transform("_kept", lambda i: F.element_at("samples", i + 1)))
        .drop("_kept", "start_sample")
    )


def trace_blocks(blocks: DataFrame, offset: Column, scale: Column) -> DataFrame:
    return blocks.withColumn("y", F.transform("samples", lambda v: trace(v, offset, scale)))
