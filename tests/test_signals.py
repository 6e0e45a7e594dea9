"""Signals and epochs: long and block form agree, and both agree with numpy."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepview.operators import epochs, signals

KEYS = ["participant", "step_num", "ch_idx", "ch_name", "ch_type"]
TYPES = {0: "eeg", 1: "eeg", 2: "misc"}
LENGTH = {1: 103, 2: 90}


def value(step, ch, i):
    return round(math.sin(i * (ch + 1) / 7) * step * 10, 4)


@pytest.fixture(scope="module")
def long(spark):
    rows = [
        (1, step, ch, f"c{ch}", TYPES[ch], i, value(step, ch, i))
        for step, n in LENGTH.items() for ch in TYPES for i in range(n)
    ]
    schema = "participant long, step_num long, ch_idx int, ch_name string, ch_type string, sample_idx long, value double"
    return spark.createDataFrame(rows, schema).cache()


@pytest.fixture(scope="module")
def blocks(long):
    return signals.to_blocks(long, KEYS, 16).cache()


def as_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


SAMPLE = ["step_num", "ch_idx", "sample_idx", "value"]


@pytest.mark.parametrize("start,stop,picks", [(0, None, None), (5, 40, ["c0", "c2"]), (16, 32, None), (95, 200, None), (50, 50, None)])
def test_window_of_blocks_is_window_of_samples(long, blocks, start, stop, picks):
    want = as_set(signals.window(long, start, stop, picks), *SAMPLE)
    for size in (None, 16):
        got = signals.explode_blocks(signals.window_blocks(blocks, start, stop, picks, size))
        assert as_set(got, *SAMPLE) == want
    if picks is not None:
        by_index = signals.window_blocks(blocks, start, stop, [int(p[1:]) for p in picks], channel="ch_idx")
        assert as_set(signals.explode_blocks(by_index), *SAMPLE) == want
    channels = [c for c in TYPES if picks is None or f"c{c}" in picks]
    end = {s: n if stop is None else min(n, stop) for s, n in LENGTH.items()}
    assert want == {(s, c, i, value(s, c, i)) for s in LENGTH for c in channels for i in range(start, end[s])}


def test_reblock(blocks, long):
    again = signals.reblock(blocks, KEYS, 25)
    assert as_set(signals.explode_blocks(again), *SAMPLE) == as_set(long, *SAMPLE)
    assert again.agg(F.max(F.size("samples"))).head()[0] == 25


@pytest.mark.parametrize("start", [0, 5, 17])
def test_decimation_counts_from_the_window(long, blocks, start):
    factor = signals.decimation(4, F.col("ch_type") == "eeg")
    want = as_set(signals.decimate(signals.window(long, start, 60), start, factor), *SAMPLE)
    kept = signals.decimate_blocks(signals.window_blocks(blocks, start, 60), start, factor)
    pairs = kept.select("step_num", "ch_idx", F.explode(F.arrays_zip("sample_idx", "samples")).alias("p"))
    assert as_set(pairs.select("step_num", "ch_idx", "p.*"), "step_num", "ch_idx", "sample_idx", "samples") == want
    assert {i for s, c, i, _ in want if (s, c) == (1, 0)} == set(range(start, 60, 4))
    assert {i for s, c, i, _ in want if (s, c) == (1, 2)} == set(range(start, 60))


def test_overlay(long):
    got = as_set(signals.overlay(signals.window(long, 80, 100), ["participant"]), *SAMPLE, "prev_value")
    want = {(1, c, i, value(1, c, i), None) for c in TYPES for i in range(80, 100)}
    want |= {(2, c, i, value(2, c, i), value(1, c, i)) for c in TYPES for i in range(80, 90)}
    assert got == want


def test_overlay_of_blocks(blocks):
    tagged = blocks.withColumn("kind", F.lit("raw")).withColumn("epoch_idx", F.lit(None).cast("bigint"))
    laid = signals.overlay_blocks(tagged, ["participant"]).collect()
    assert {r.status for r in laid if r.step_num == 1} == {"no_previous"}
    second = [r for r in laid if r.step_num == 2]
    assert len(second) == 18 and all(r.prev_samples[0] == value(1, r.ch_idx, r.start_sample) for r in second)
    mixed = tagged.withColumn("kind", F.when(F.col("step_num") == 2, "epochs").otherwise("raw"))
    laid = signals.overlay_blocks(mixed, ["participant"]).where("step_num = 2")
    assert as_set(laid, "status", "prev_samples") == {("kind_mismatch", None)}


def test_overlay_by_name_or_index(spark):
    schema = "participant long, step_num long, ch_idx int, ch_name string, sample_idx long, value double"
    rows = [(1, 1, 0, "a", 0, 10.0), (1, 1, 1, "b", 0, 20.0), (1, 2, 0, "b", 0, 1.0)]
    df = spark.createDataFrame(rows, schema)
    by_index = signals.overlay(df, ["participant"]).where("step_num = 2").head()
    by_name = signals.overlay(df, ["participant"], "ch_name").where("step_num = 2").head()
    assert by_index.prev_value == 10.0 and by_name.prev_value == 20.0


def test_auto_scale_is_the_interquartile_range(long):
    got = {(r.step_num, r.ch_type): r.scale for r in signals.auto_scales(long, ["step_num", "ch_type"]).collect()}
    for (step, kind), scale in got.items():
        values = [value(step, c, i) for c in TYPES if TYPES[c] == kind for i in range(LENGTH[step])]
        low, high = np.percentile(values, [25, 75])
        assert scale == pytest.approx(1 / (high - low))


@pytest.mark.parametrize("mode", ["overdraw", "normalize", "clamp", "clip"])
def test_display(long, mode):
    keys = ["participant", "step_num", "ch_type"]
    scales = signals.auto_scales(long, keys)
    shown = signals.display(signals.window(long, 3, 30), mode, scales, keys, y_limits=(2.5, -0.5)).collect()
    factors = {(r.step_num, r.ch_type): r.scale for r in scales.collect()}
    for r in shown:
        want = r.ch_idx - r.value * (factors[r.step_num, r.ch_type] if mode == "normalize" else 1)
        if mode in ("clamp", "clip"):
            want = min(max(want, r.ch_idx - 0.5), r.ch_idx + 0.5)
        assert r.y == pytest.approx(want)


def test_clamp_is_for_raw_only(long):
    one = signals.window(long, 3, 30)
    free = signals.display(one, "clamp", kind="epochs", y_limits=(2.5, -0.5))
    assert as_set(free, "y") == as_set(signals.display(one, "overdraw"), "y")
    with pytest.raises(ValueError):
        signals.display(one, "stretch")


@pytest.mark.parametrize(
    "offset,bottom,top,butterfly,want",
    [(0, 3.5, -0.5, False, (-0.5, 0.5)), (3, 3.2, -0.5, False, (2.5, 3.2)), (0, 5, -0.1, True, (-0.1, 0.3)), (1, 5, 0.9, True, (0.9, 1.3))],
)
def test_clip_band(spark, offset, bottom, top, butterfly, want):
    lo, hi = signals.clip_band(F.lit(float(offset)), bottom, top, butterfly)
    assert tuple(spark.range(1).select(lo, hi).head()) == pytest.approx(want)


def test_times(spark, long):
    got = spark.range(3).select(signals.sample_time(F.col("id"), 4.0, 1.5)).collect()
    assert [r[0] for r in got] == [1.5, 1.75, 2.0]
    assert tuple(signals.extent(signals.window(long, 5, 40), ["participant"], 10.0, 1.0).head()) == (1, 1.5, 4.9)


def test_placeholder_and_traces(spark, blocks):
    assert math.isnan(spark.range(1).select(signals.or_nan(F.lit(None).cast("double"))).head()[0])
    traced = signals.trace_blocks(blocks, F.col("ch_idx").cast("double"), F.lit(0.5)).head()
    assert traced.y == pytest.approx([traced.ch_idx - v * 0.5 for v in traced.samples])


# ------------------------------------------------------------------- epochs


@pytest.fixture(scope="module")
def epoched(spark):
    rows = [(1, s, e, c, [float(1000 * s + 100 * e + 10 * c + i) for i in range(5)]) for s in (1, 2) for e in range(6 - s) for c in (0, 1)]
    return spark.createDataFrame(rows, "participant long, step_num long, epoch_idx long, ch_idx int, samples array<double>")


@pytest.mark.parametrize("t_start", [0.0, 0.5, 1.0, 1.2, 1.24, 2.5, 99.0])
def test_first_epoch_is_a_left_search(spark, t_start):
    boundaries = np.arange(0, 7) * 0.5
    period = 0.01
    want = int(np.searchsorted(boundaries, t_start - period))
    df = spark.range(1)
    listed = F.array(*[F.lit(float(x)) for x in boundaries])
    assert df.select(epochs.first_boundary(listed, F.lit(t_start - period))).head()[0] == want
    closed = df.select(epochs.first_epoch(t_start, period, 0.5)).head()[0]
    assert closed == want or closed > 6 and want == 7


def test_epoch_window_and_concatenation(epoched):
    shown = epochs.epoch_window(epoched, 1, 3)
    joined = epochs.joined_traces(shown, ["step_num", "ch_idx"]).collect()
    for r in joined:
        want = np.concatenate([[1000 * r.step_num + 100 * e + 10 * r.ch_idx + i for i in range(5)] for e in (1, 2, 3)])
        assert list(r.samples) == list(want)
    long = signals.explode_blocks(epochs.concatenated(shown, 1))
    got = as_set(long, "step_num", "ch_idx", "sample_idx", "value")
    assert got == {(r.step_num, r.ch_idx, i, v) for r in joined for i, v in enumerate(r.samples)}


def test_overlay_epochs(epoched):
    got = epochs.explode_epochs(epochs.overlay_epochs(epoched, ["participant"])).collect()
    for r in got:
        assert r.prev_value == (r.value - 1000 if r.step_num == 2 else None)
    # The step before has one epoch more; the overlay follows the current step.
    assert {r.epoch_idx for r in got if r.step_num == 2} == set(range(4))


def test_overlay_of_blocks_with_gaps(spark):
    """Blocks of any lengths and with gaps, of both kinds, against sample by sample."""
    rng = random.Random(7)
    rows, samples = [], {}
    for step, ch, kind in itertools.product((1, 2, 3), (0, 1), ("raw", "epochs")):
        at = rng.randrange(5)
        while at < 60:
            size = rng.randrange(0, 12)
            if kind == "raw" or step < 3:
                rows.append(("P", step, ch, None if kind == "raw" else 4, kind, at, [float(1000 * step + 100 * ch + at + i) for i in range(size)]))
                samples |= {(step, ch, kind, at + i): 1000.0 * step + 100 * ch + at + i for i in range(size)}
            at += size + rng.choice([0, 0, 3])
    schema = "participant string, step_num long, ch_idx int, epoch_idx long, kind string, start_sample long, samples array<float>"
    for cell in (5, 64):
        laid = signals.overlay_overlapping(spark.createDataFrame(rows, schema), ["participant"], cell)
        assert laid.columns == [*schema.replace(",", "").split()[::2], "prev_samples"]
        got = {}
        for r in laid.collect():
            prev = r.prev_samples or [None] * len(r.samples)
            assert len(prev) == len(r.samples) and (r.prev_samples is None or set(prev) != {None})
            for i, pair in enumerate(zip(r.samples, prev)):
                assert got.setdefault((r.step_num, r.ch_idx, r.kind, r.start_sample + i), pair) == pair
        assert got == {(s, c, k, i): (v, samples.get((s - 1, c, k, i))) for (s, c, k, i), v in samples.items()}
    # A recording of the other kind is not laid under.
    mixed = spark.createDataFrame([("P", 1, 0, None, "epochs", 0, [1.0]), ("P", 2, 0, None, "raw", 0, [2.0])], schema)
    assert {r.prev_samples for r in signals.overlay_overlapping(mixed, ["participant"], 4).collect()} == {None}
