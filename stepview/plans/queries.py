"""The registered queries: operators applied to the given tables.

Each entry of ``QUERIES`` takes the session and a directory of tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepview.functions import labels, paths
from stepview.functions.natural import natural_key
from stepview.operators import catalog, changes, epochs, freshness, images, logs, qc, signals
from stepview.operators.prefix import prefix_join
from stepview.operators.ranking import delete_at_end, materialize, rank, shared_dir
from stepview.plans import views
from stepview.sources import bindings as b
from stepview.sources import registry, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# The window that the signal queries show.
START, STOP, DECIM = 5, 40, 3
PICKS = ["click", "purchase", "signup", "view"]


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register under the function's name, less a trailing underscore."""
    QUERIES[function.__name__.rstrip("_")] = function
    return function


# ---------------------------------------------------------------- catalogue


@query
def participants(spark, sf):
    return catalog.participants(catalog.step_files(b.step_manifest(spark, sf)))


@query
def participant_labels(spark, sf):
    counted = catalog.participants(b.step_files(spark, sf))
    label = labels.participant_label(F.col("participant"), F.col("n_files"))
    return counted.select("source", "participant", label.alias("label"))


@query
def steps(spark, sf):
    return catalog.steps(catalog.step_files(b.step_manifest(spark, sf)))


@query
def steps_for_participant(spark, sf):
    return catalog.steps_for_participants(b.step_files(spark, sf))


@query
def step_dedupe(spark, sf):
    return catalog.latest_dirs(b.step_files(spark, sf))


@query
def has_prev(spark, sf):
    return catalog.with_previous(b.step_files(spark, sf))


@query
def step_lookup(spark, sf):
    files = b.step_files(spark, sf)
    # Some files of the catalogue are taken to be gone.
    present = files.where(~F.col("step_dir").endswith("_r"))
    return catalog.step_lookup(b.step_requests(spark, sf), files, present)


@query
def step_rejects(spark, sf):
    """Names that look like steps: line items with digits, fractions or letters in front."""
    key = F.col("l_orderkey")
    name = (
        F.when(key % 5 == 0, F.concat(b.text("l_linenumber"), F.lit("abc_"), F.lower("l_returnflag")))
        .when(key % 5 == 1, F.concat(F.lit("½_"), F.lower("l_returnflag")))
        .when(key % 5 == 2, F.concat(F.lit("step_"), b.text("l_linenumber")))
        .otherwise(F.concat(b.text("l_linenumber"), F.lit("_"), F.lower("l_returnflag")))
    )
    names = b.table(spark, sf, "lineitem").select(
        b.site("l_orderkey").alias("source"), name.alias("name"), (key % 5 < 4).alias("is_dir")
    )
    return catalog.step_rejects(names.distinct())


@query
def overview(spark, sf):
    files = b.step_files(spark, sf)
    log = b.log_files(spark, sf)
    people = files.select("source", "participant").unionByName(
        log.select(F.col("site").alias("source"), F.col("owner").alias("participant"))
    )
    qc_named = b.qc_files(spark, sf).withColumn("name", paths.base_name(F.col("rel_path")))
    log_named = log.select(F.col("site").alias("source"), "name", "rel_path")
    return catalog.overview(people, files, qc_named, log_named)


# ------------------------------------------------- natural order and prefixes


@query
def natural_sort(spark, sf):
    keys = b.table(spark, sf, "part").select(F.col("p_brand").alias("key")).union(
        b.table(spark, sf, "documents").select("source")
    )
    ordered = keys.distinct().withColumn("_nat", natural_key(F.col("key")))
    return rank(ordered, [], ["_nat", "key"], "rank").drop("_nat")


@query
def natural_order_items(spark, sf):
    """Image paths in natural order within each source."""
    files = b.qc_files(spark, sf).withColumn("_nat", natural_key(F.col("rel_path")))
    return rank(files, ["source"], ["_nat", "rel_path"], "nat_rank").drop("_nat")


def _names_and_people(spark, sf):
    names = b.table(spark, sf, "orders").select(b.text("o_custkey").alias("name")).distinct()
    people = b.table(spark, sf, "events").select(b.text("user_id").alias("participant"))
    return names, people


@query
def prefix_join_(spark, sf):
    names, people = _names_and_people(spark, sf)
    return prefix_join(names, people).select("participant", "name")


@query
def prefix_join_longest(spark, sf):
    names, people = _names_and_people(spark, sf)
    return prefix_join(names, people, longest=True).select("participant", "name")


# --------------------------------------------------------------------- logs


@query
def logs_for_participant(spark, sf):
    return logs.logs_for_participants(b.log_files(spark, sf), b.log_participants(spark, sf), by=())


@query
def log_content(spark, sf):
    """Requested logs that are listed for their participant, with a digest of the text."""
    files = b.log_files(spark, sf)
    missing = F.concat(F.lit("logs/missing-"), b.text("doc_id"), F.lit(".log"))
    wrong_owner = F.concat("owner", F.lit("x"))
    asked = files.select(
        F.when(F.col("doc_id") % 5 == 1, wrong_owner).otherwise(F.col("owner")).alias("participant"),
        F.when(F.col("doc_id") % 5 == 0, missing).otherwise(F.col("rel_path")).alias("rel_path"),
    )
    listed = logs.logs_for_participants(files, b.log_participants(spark, sf), by=())
    granted = logs.listed_requests(asked, listed)
    # The digest is taken at the scan, so no text is shuffled.
    digests = files.select("rel_path", F.md5("content").alias("content_md5"))
    return granted.join(digests, "rel_path").select("participant", "rel_path", "content_md5")


@query
def content_base64(spark, sf):
    files = b.log_files(spark, sf)
    return files.select("rel_path", labels.base64_text(F.encode("content", "UTF-8")).alias("encoded"))


# ----------------------------------------------------------- quality control


def _qc_items(spark, sf):
    return qc.classified(b.qc_files(spark, sf), b.qc_participants(spark, sf))


@query
def qc_items(spark, sf):
    return qc.qc_items(b.qc_files(spark, sf), b.qc_participants(spark, sf))


@query
def qc_tree(spark, sf):
    return qc.qc_tree(_qc_items(spark, sf)).withColumnRenamed("bit", "stem")


@query
def qc_rejects(spark, sf):
    return qc.qc_rejects(b.qc_files(spark, sf))


@query
def qc_defaults(spark, sf):
    return qc.first_sets(qc.qc_defaults(_qc_items(spark, sf)))


@query
def qc_lookup(spark, sf):
    return qc.qc_lookup(b.qc_requests(spark, sf), _qc_items(spark, sf))


# ---------------------------------------------------------------- freshness


@query
def freshness_(spark, sf):
    return freshness.freshness(b.caches(spark, sf))


@query
def freshness_readable(spark, sf):
    """The same where some copies can't be read."""
    key = F.col("rec")
    known = b.caches(spark, sf).withColumns({"raw_readable": F.when(key % 4 > 0, key % 3 > 0), "epo_readable": key % 5 > 0})
    return freshness.freshness(known)


@query
def freshness_of_files(spark, sf):
    """The same from file names: copies are recognised beside their recordings."""
    return freshness.freshness(freshness.caches(b.cache_manifest(spark, sf)))


@query
def conversion_plan(spark, sf):
    return freshness.conversion_plan(freshness.freshness(b.caches(spark, sf)))


@query
def pending_recordings(spark, sf):
    """Orders with no line item shipped on or after the order's day."""
    recordings = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("rec"), F.col("o_orderdate").alias("mtime"))
    converted = (
        b.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("rec")).agg(F.max("l_shipdate").alias("mtime"))
    )
    return freshness.pending(recordings, converted, ["rec"]).select("rec")


# ------------------------------------------------------------------ signals

SAMPLE = ["participant", "step_num", "ch_name", "sample_idx"]


def _window(spark, sf, picks=None):
    return signals.window(b.signal_long(spark, sf), START, STOP, picks)


@query
def signal_window(spark, sf):
    return _window(spark, sf, PICKS).select(*SAMPLE, "value")


@query
def signal_window_blocks(spark, sf):
    """The same slice taken from stored blocks."""
    keys = ["participant", "step_num", "ch_name"]
    blocks = signals.to_blocks(b.signal_long(spark, sf).select(*keys, "sample_idx", "value"), keys, 16)
    return signals.explode_blocks(signals.window_blocks(blocks, START, STOP, PICKS, 16))


@query
def signal_scales(spark, sf):
    keys = ["participant", "step_num", "ch_type"]
    scales = signals.auto_scales(b.signal_long(spark, sf), keys)
    return scales.withColumn("scale", F.round("scale", 6))


@query
def signal_scaled(spark, sf):
    keys = ["participant", "step_num", "ch_type"]
    signal = b.signal_long(spark, sf)
    window = signals.window(signal, START, STOP)
    shown = signals.display(window, "normalize", signals.auto_scales(signal, keys), keys)
    return shown.select(*SAMPLE, F.round("y", 6).alias("y"))


@query
def signal_overdraw(spark, sf):
    return signals.display(_window(spark, sf), "overdraw").select(*SAMPLE, F.round("y", 6).alias("y"))


@query
def signal_clamped(spark, sf):
    shown = signals.display(_window(spark, sf), "clamp", y_limits=(4.2, -0.3))
    lo, hi = signals.clip_band(F.col("ch_idx").cast("double"), 4.2, -0.3)
    return shown.select(*SAMPLE, *[F.round(c, 6).alias(n) for c, n in ((F.col("y"), "y"), (lo, "lo"), (hi, "hi"))])


@query
def signal_decimated(spark, sf):
    factor = signals.decimation(DECIM, F.col("ch_type") == "data")
    kept = signals.decimate(_window(spark, sf), START, factor)
    return kept.select(*SAMPLE, signals.sample_time(F.col("sample_idx"), 1.0).alias("t"), "value")


@query
def signal_decimated_blocks(spark, sf):
    """The same on arrays, before they are exploded."""
    keys = ["participant", "step_num", "ch_name", "ch_type"]
    blocks = signals.to_blocks(b.signal_long(spark, sf).select(*keys, "sample_idx", "value"), keys, 16)
    shown = signals.window_blocks(blocks, START, STOP, size=16)
    kept = signals.decimate_blocks(shown, START, signals.decimation(DECIM, F.col("ch_type") == "data"))
    pairs = kept.select(*keys, F.explode(F.arrays_zip("sample_idx", "samples")).alias("_at"))
    return pairs.select(
        "participant",
        "step_num",
        "ch_name",
        "_at.sample_idx",
        signals.sample_time(F.col("_at.sample_idx"), 1.0).alias("t"),
        F.col("_at.samples").alias("value"),
    )


@query
def decimation_factors(spark, sf):
    """The distinct factors in use per recording."""
    factor = signals.decimation(DECIM, F.col("event_type").isin(*b.DATA_CHANNELS))
    return b.table(spark, sf, "events").select(
        F.col("user_id").alias("participant"), factor.cast("bigint").alias("decim")
    ).distinct()


@query
def signal_extent(spark, sf):
    return signals.extent(_window(spark, sf), ["participant", "step_num"], 1.0)


@query
def overlay(spark, sf):
    shown = signals.overlay(_window(spark, sf), b.RECORDING, "ch_name")
    return shown.select(*SAMPLE, "value", "prev_value")


@query
def overlay_blocks(spark, sf):
    """Blocks of a step beside those of the step before, as block totals.

    Events of odd users are taken for continuous recordings; of even users the
    last period counts as epoched, so that kinds differ between two steps.
    """
    keys = ["participant", "step_num", "ch_name"]
    blocks = signals.to_blocks(b.signal_long(spark, sf).select(*keys, "sample_idx", "value"), keys, 16)
    epoched = (F.col("participant") % 2 == 0) & (F.col("step_num") == 3)
    tagged = blocks.withColumn("kind", F.when(epoched, "epochs").otherwise("raw")).withColumn(
        "epoch_idx", F.lit(None).cast("bigint")
    )
    laid = signals.overlay_blocks(tagged, b.RECORDING, "ch_name")
    return laid.select(
        *keys,
        "start_sample",
        "status",
        F.size("samples").cast("bigint").alias("n"),
        F.array_max("samples").alias("highest"),
        F.array_max("prev_samples").alias("prev_highest"),
    )


@query
def overlay_overlapping(spark, sf):
    """Blocks of 4, 8 and 7 samples, by step, with the samples of the step before under them, and unpacked."""
    keys = ["participant", "step_num", "ch_name"]
    long = materialize(b.signal_long(spark, sf).select(*keys, "sample_idx", "value"), "long")
    cut = [signals.to_blocks(long.where(F.col("step_num") == n), keys, size) for n, size in ((1, 4), (2, 8), (3, 7))]
    blocks = cut[0].unionByName(cut[1]).unionByName(cut[2]).withColumn("epoch_idx", F.lit(None).cast("bigint"))
    laid = signals.overlay_overlapping(blocks, b.RECORDING, 8, "ch_name")
    none = F.array_repeat(F.lit(None).cast("double"), F.size("samples"))
    pairs = F.arrays_zip(F.col("samples").alias("value"), F.coalesce("prev_samples", none).alias("prev_value"))
    unpacked = laid.select(*keys, "start_sample", F.posexplode(pairs).alias("_pos", "_pair"))
    return unpacked.select(*keys, (F.col("start_sample") + F.col("_pos")).alias("sample_idx"), "_pair.value", "_pair.prev_value")


@query
def stored_view(spark, sf):
    """All recordings converted to a store; from it the scaled and overlaid window of one of them, by its stored scale."""
    keys = ["participant", "step_num", "ch_idx", "ch_name", "ch_type"]
    long = b.signal_long(spark, sf).select(*keys, "sample_idx", F.col("value").cast("float").alias("value"))
    named = {"source": F.lit("lab"), "participant": b.person("participant"), "step_dir": F.concat(b.text("step_num"), F.lit("_s")), "kind": F.lit("raw")}
    blocks = signals.to_blocks(long, keys, 8).withColumns(named).withColumn("epoch_idx", F.lit(None).cast("bigint"))
    blocks = materialize(blocks, "blocks")
    recordings = blocks.select(*store.RECORDING, "kind").distinct().withColumns({"mtime": F.timestamp_seconds(F.lit(1)), "sfreq": F.lit(1.0), "first_time": F.lit(0.0)})
    path = f"{shared_dir(spark)}/stepview-store-{uuid.uuid4().hex}"
    delete_at_end(spark, path)
    store.convert(recordings, blocks, path)
    return views.signal_view(spark, path, "lab", "P7", 2, START, STOP, "normalize", True, DECIM, data_types=("data",)).select(
        "ch_idx", "ch_name", "sample_idx", "t", "y", "prev_y"
    )


@query
def overlay_trace(spark, sf):
    """Overlay traces as drawn: placeholder for what is missing, clip band, decimated."""
    window = _window(spark, sf).withColumn("is_data", F.col("ch_type") == "data")
    shown = signals.overlay(window, b.RECORDING, "ch_name", carried=["ch_idx", "is_data"])
    kept = signals.decimate(shown, START, signals.decimation(DECIM, F.col("is_data")))
    offset = F.col("ch_idx").cast("double")
    lo, hi = signals.clip_band(offset, 4.2, -0.3, butterfly=True)
    y = signals.or_nan(signals.trace(F.col("prev_value"), offset, F.lit(0.01)))
    return kept.select(
        *SAMPLE,
        F.isnan(y).alias("missing"),
        F.round(F.when(~F.isnan(y), signals.clamp(y, lo, hi)), 6).alias("y"),
    )


# ------------------------------------------------------------------- epochs

EPOCH = ["participant", "step_num", "epoch_idx", "ch_idx", "sample_idx"]
N_EPOCHS = 4


def _first_epoch():
    # The view starts with the third epoch; one sample is one second.
    return epochs.first_epoch(2.0 * b.EPOCH_SAMPLES, 1.0, float(b.EPOCH_SAMPLES))


@query
def epoch_window(spark, sf):
    shown = epochs.epoch_window(b.epochs(spark, sf), _first_epoch(), N_EPOCHS)
    return epochs.explode_epochs(shown).select(*EPOCH, "value")


@query
def overlay_epochs(spark, sf):
    shown = epochs.epoch_window(b.epochs(spark, sf), _first_epoch(), N_EPOCHS)
    return epochs.explode_epochs(epochs.overlay_epochs(shown, b.RECORDING)).select(*EPOCH, "value", "prev_value")


@query
def epochs_concatenated(spark, sf):
    first = _first_epoch()
    joined = epochs.concatenated(epochs.epoch_window(b.epochs(spark, sf), first, N_EPOCHS), first)
    long = signals.explode_blocks(joined)
    return long.select("participant", "step_num", "ch_idx", "sample_idx", "value")


@query
def epoch_traces(spark, sf):
    """The window's epochs as one array per channel; its length is fixed by the window."""
    shown = epochs.epoch_window(b.epochs(spark, sf), _first_epoch(), N_EPOCHS)
    traces = epochs.joined_traces(shown, ["participant", "step_num", "ch_idx"])
    value = F.element_at("samples", -1)
    return traces.select(
        "participant", "step_num", "ch_idx", F.size("samples").cast("bigint").alias("n"), value.alias("last_value")
    )


# ------------------------------------------------------- images and registry


@query
def image_bbox(spark, sf):
    return images.pixel_boxes(b.pixels(spark, sf))


@query
def image_trim(spark, sf):
    """The same boxes from whole images, by the function that crops and encodes them."""
    cropped = images.trimmed(b.images(spark, sf))
    # The size that the PNG header states.
    width, height = (F.conv(F.hex(F.substring("png", p, 4)), 16, 10).cast("int") for p in (17, 21))
    return cropped.select(F.col("key").alias("image"), "x0", "y0", "x1", "y1", width.alias("width"), height.alias("height"))


@query
def listing_changes(spark, sf):
    """What two listings differ in, by kind of change and top folder, with how many participants that touches."""
    old, new = b.listing(spark, sf), b.listing(spark, sf, later=True)
    changed = materialize(changes.changes(old, new), "changed")
    people = b.table(spark, sf, "supplier").select(b.site("s_suppkey").alias("source"), b.person("s_suppkey").alias("participant"))
    touched = changes.touched(changed, people).groupBy("source").agg(F.count(F.lit(1)).alias("n_touched"))
    top = F.substring_index("rel_path", "/", 1)
    counts = changed.groupBy("source", top.alias("top"), "change").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(touched, "source", "left")


@query
def image_decode(spark, sf):
    """PNG files decoded, trimmed by alpha, encoded, and the pixels of what is left decoded again."""
    cropped = images.encoded_files(b.png_files(spark, sf), "content")
    again = images.decoded(cropped.withColumnRenamed("status", "file_status"), "png")
    pixels = F.lower(F.hex("data")).alias("pixels")
    return again.select("image", F.col("file_status").alias("status"), "x0", "y0", "x1", "y1", "width", "height", "n_channels", pixels)


@query
def qc_nested(spark, sf):
    """The drill-down as nested values, with every path in them replaced by content, and taken apart again."""
    items = qc.classified(b.qc_files(spark, sf), b.qc_participants(spark, sf))
    content = b.qc_files(spark, sf).withColumn("encoded", labels.base64_text(F.encode("rel_path", "UTF-8")))
    sets = qc.encode_nested(qc.nested_items(items), ["groups", "rest"], content, ["source"])
    ranges = F.array_join(F.transform("value.chs", lambda c: F.concat_ws(":", c["ch_start"], c["ch_end"], c["rel_path"])), " ")
    groups = sets.select(*qc.SET, F.explode("groups")).select(
        *qc.SET, F.lit(False).alias("is_rest"), F.col("key").alias("bit"), F.col("value.scalp.name").alias("name"), F.col("value.scalp.rel_path").alias("shown"), ranges.alias("ranges")
    )
    rest = sets.select(*qc.SET, F.explode("rest")).select(
        *qc.SET, F.lit(True).alias("is_rest"), F.col("key").alias("bit"), F.col("key").alias("name"), F.col("value").alias("shown"), F.lit("").alias("ranges")
    )
    return groups.unionByName(rest)


@query
def unique_names(spark, sf):
    return registry.unique_names(b.arrivals(spark, sf))


@query
def registry_lookup(spark, sf):
    """Directories of requested sources after one has been removed from the registry."""
    named = registry.unique_names(b.arrivals(spark, sf))
    sources = registry.without(named.select(F.col("unique_name").alias("name"), "directory"), "BUILDING-2")
    number = F.col("o_custkey") % 30
    asked = b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request"),
        F.when(number < 2, F.lit("BUILDING")).otherwise(F.concat(F.lit("BUILDING-"), b.text(number))).alias("source"),
    )
    return registry.with_directory(asked, sources).select("request", "source", "directory", "known")
