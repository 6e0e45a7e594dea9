"""The views of one source and participant, read from tables kept for all of them.

``refresh`` walks the sources and writes the tables; each view is then a filter
on them. Values that come from a request are ordinary arguments.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepview.functions.labels import base64_text
from stepview.functions.natural import natural_key
from stepview.operators import catalog, changes, epochs, freshness, images, logs, qc, signals
from stepview.operators.prefix import prefix_join
from stepview.operators.ranking import materialize
from stepview.sources import registry, store, versions
from stepview.sources.tree import manifest

TABLES = ("sources", "manifest", "step_files", "steps", "participants", "logs", "qc_images", "caches")


#: Keys by which rows of an earlier version are replaced; tables without are written anew each time.
KEYS = {"manifest": ["source", "rel_path"]} | {n: catalog.PARTICIPANT for n in ("step_files", "participants", "logs", "qc_images", "caches")}
SCHEMAS = "_schemas"
STATE = ["path", "is_dir", "mtime", "size"]
#: Share of the participants from which on a refresh writes all of them.
REWRITE = 0.25


def _tables(sources: DataFrame, listed: DataFrame, hit: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables; of those by participant the rows of ``hit`` only, if that is given."""
    files, caches = catalog.step_files(listed), freshness.caches(listed)
    if hit is not None:
        files, caches = (t.join(hit, catalog.PARTICIPANT, "left_semi") for t in (files, caches))
    files = materialize(files, "files")
    people = materialize(files.select(*catalog.PARTICIPANT).distinct(), "people")
    log = prefix_join(logs.log_files(listed), people, by=["source"])
    return {
        "sources": sources.select(F.col("name").alias("source"), "directory"),
        "manifest": listed,
        "step_files": files,
        "steps": catalog.step_dirs(listed),
        "participants": catalog.participants(files),
        "logs": log.select(*catalog.PARTICIPANT, "rel_path", "path"),
        "qc_images": qc.classified(qc.qc_files(listed), people),
        "caches": freshness.freshness(caches),
    }


def _write(table: DataFrame, name: str, folder: str) -> None:
    if "participant" in table.columns and name != "participants":
        # Ranges keep a participant's rows together; the digest of the row lets
        # them cut a big one.
        order = [F.col("source"), F.col("participant"), F.xxhash64(*table.columns)]
        table = table.repartitionByRange(*order).sortWithinPartitions("source", "participant")
    table.write.partitionBy("source").parquet(f"{folder}/{name}")
    # A table without rows has no file to tell its columns.
    where, files = versions.hadoop(table.sparkSession, f"{folder}/{SCHEMAS}/{name}")
    stream = files.create(where)
    stream.write(table.schema.json().encode())
    stream.close()


def refresh(sources: DataFrame, path: str) -> None:
    """Walk all ``sources(name, directory)`` once and write the tables below ``path``.

    They count together, once all of them are written.
    """
    tables = _tables(sources, materialize(manifest(sources), "manifest"))
    with versions.new_version(sources.sparkSession, path) as folder:
        for name in TABLES:
            _write(tables[name], name, folder)


def refresh_changed(sources: DataFrame, path: str) -> DataFrame:
    """Walk all ``sources`` and bring the tables below ``path`` up to date; what has changed: ``source, rel_path, change``.

    The result is that of ``refresh``. Only rows of changed entries, and of participants that they touch, are worked out and
    written, beside the version they add to; readers take them together. Once more than ``REWRITE`` of the participants have been
    touched since, all tables are written whole.
    """
    spark = sources.sparkSession
    last = versions.complete(spark, path)
    if not last:
        refresh(sources, path)
        return table(spark, path, "manifest").select("source", "rel_path", F.lit("added").alias("change"))
    base = versions.base_of(last[-1]) or int(last[-1][1:11])
    listed = materialize(manifest(sources), "manifest")
    changed = materialize(changes.changes(table(spark, path, "manifest"), listed, KEYS["manifest"], STATE), "changed")
    before = table(spark, path, "participants").select(*catalog.PARTICIPANT)
    people = before.unionByName(catalog.step_files(listed).select(*catalog.PARTICIPANT)).distinct()
    hit = materialize(changes.touched(changed, people), "hit")
    tables = _tables(sources, listed, hit)
    own = {name: changed.select(keys) if name == "manifest" else hit for name, keys in KEYS.items()}
    tables["manifest"] = listed.join(changed, KEYS["manifest"], "left_semi")
    replaced = {name: _replaced(spark, path, name).unionByName(keys).distinct() for name, keys in own.items()}
    whole = replaced["participants"].count() > REWRITE * before.count()
    with versions.new_version(spark, path, None if whole else base) as folder:
        for name in TABLES:
            if name not in KEYS:
                _write(tables[name], name, folder)
                continue
            kept = table(spark, path, name) if whole else _added(spark, path, name, tables[name].schema)
            _write(kept.join(own[name], KEYS[name], "left_anti").unionByName(tables[name]), name, folder)
            if not whole:
                replaced[name].write.parquet(f"{folder}/_keys/{name}")
    return changed


def _replaced(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Keys of the rows that the current version replaces in the one it adds to."""
    folder = versions.current(spark, path)
    schema = ", ".join(f"{k} string" for k in KEYS[name])
    if versions.base_of(folder) is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/_keys/{name}")


def _added(spark: SparkSession, path: str, name: str, schema: T.StructType) -> DataFrame:
    """Rows that the current version has beside the one it adds to."""
    folder = versions.current(spark, path)
    return spark.createDataFrame([], schema) if versions.base_of(folder) is None else _as_written(spark, f"{folder}/{name}")


def table(spark: SparkSession, path: str, name: str, source: str | None = None) -> DataFrame:
    """A table of the last ``refresh``; an unknown source is an error."""
    folder = versions.current(spark, path)
    if folder is None:
        raise ValueError(f"{path}: no tables, call refresh first")
    base = versions.base_of(folder)
    if base is None or name not in KEYS:
        df = _as_written(spark, f"{folder}/{name}")
    else:
        old = _as_written(spark, f"{versions.numbered(spark, path, base)}/{name}")
        df = old.join(_replaced(spark, path, name), KEYS[name], "left_anti").unionByName(_as_written(spark, f"{folder}/{name}"))
    if source is None:
        return df
    if _as_written(spark, f"{folder}/sources").where(F.col("source") == source).isEmpty():
        raise KeyError(source)
    return df.where(F.col("source") == source)


def _as_written(spark: SparkSession, path: str) -> DataFrame:
    """A partitioned table whose sources stay text, whatever they look like."""
    folder, name = path.rsplit("/", 1)
    schema = T.StructType.fromJson(json.loads(spark.read.text(f"{folder}/{SCHEMAS}/{name}", wholetext=True).head()[0]))
    return spark.read.schema(schema).parquet(path)


def participant_list(spark: SparkSession, path: str, source: str) -> DataFrame:
    return table(spark, path, "participants", source).orderBy(F.desc("n_files"), "participant")


def _own(spark: SparkSession, path: str, name: str, source: str, participant: str) -> DataFrame:
    return table(spark, path, name, source).where(F.col("participant") == participant)


def overview(spark: SparkSession, path: str, source: str, participant: str) -> DataFrame:
    """Steps, images and logs of one participant, each section in its order."""
    steps = _own(spark, path, "step_files", source, participant).select(
        F.lit(1).alias("_at"), F.lit("step").alias("section"), F.col("step_dir").alias("item"), "step_num"
    )
    shown = _own(spark, path, "qc_images", source, participant).select(
        F.lit(2).alias("_at"), F.lit("qc").alias("section"), F.col("rel_path").alias("item")
    )
    log = _own(spark, path, "logs", source, participant).select(
        F.lit(3).alias("_at"), F.lit("log").alias("section"), F.col("rel_path").alias("item")
    )
    every = steps.unionByName(shown, allowMissingColumns=True).unionByName(log, allowMissingColumns=True)
    natural = F.when(F.col("_at") < 3, natural_key(F.col("item")))
    return every.orderBy("_at", "step_num", natural, "item").select("section", "item")


def log_view(spark: SparkSession, path: str, source: str, participant: str, rel_path: str) -> DataFrame:
    """Text of one log that is listed for the participant; no row if it is not."""
    listed = _own(spark, path, "logs", source, participant).where(F.col("rel_path") == rel_path)
    return logs.read_logs(listed).select("rel_path", "content")


def _contents(wanted: DataFrame, sources: DataFrame, source: str) -> DataFrame:
    """``source, rel_path, encoded, file_status`` of listed images (``rel_path``) of a source: trimmed, as base64 of PNG files."""
    spark = wanted.sparkSession
    folder = f"{registry.normalized(registry.directory_of(sources, source))}/quality_control"
    files = wanted.select(F.lit(source).alias("source"), "rel_path", F.concat(F.lit(f"{folder}/"), "rel_path").alias("path"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = files.withColumn("file", F.col("path")).repartition(tasks, "path")
    shown = materialize(images.encoded_files(spread).withColumn("encoded", base64_text(F.col("png"))), "shown")
    # Kinds besides PNG are for Spark's own reader.
    rest = shown.where("status = 'other'").select("source", "rel_path", F.col("file").alias("path"))
    paths = [r["path"] for r in rest.select("path").toLocalIterator()]
    encoded = shown.where("status <> 'other'").select("source", "rel_path", "encoded", F.col("status").alias("file_status"))
    if not paths:
        return encoded
    read = images.located(images.encoded_images(images.read_images(spark, paths)), rest).withColumn("file_status", F.lit("ok"))
    return encoded.unionByName(rest.select("source", "rel_path").join(read, ["source", "rel_path"], "left"))


def peek_view(
    spark: SparkSession,
    path: str,
    sources: DataFrame,
    source: str,
    participant: str,
    root: str,
    set_name: str | None = None,
    bit: str | None = None,
) -> DataFrame:
    """The images of one bit, trimmed and encoded: ``status, rel_path, encoded``.

    Only the chosen files are opened. A listed image that can't be shown has ``missing``, ``unreadable`` or ``broken``
    for its status and no content.
    """
    request = [(0, source, participant, root, set_name, bit)]
    names = "request long, source string, participant string, root string, set_name string, bit string"
    found = qc.qc_lookup(spark.createDataFrame(request, names), _own(spark, path, "qc_images", source, participant))
    found = materialize(found.select("status", "rel_path"), "peek")
    wanted = found.where("rel_path is not null")
    if wanted.isEmpty():
        return found.withColumn("encoded", F.lit(None).cast("string"))
    encoded = _contents(wanted.select("rel_path").distinct(), sources, source)
    status = F.when(F.col("file_status") == "ok", F.col("status")).otherwise(F.coalesce("file_status", F.lit("broken")))
    named = wanted.withColumn("source", F.lit(source)).join(encoded, ["source", "rel_path"], "left").withColumn("status", status)
    unnamed = found.where("rel_path is null").withColumn("encoded", F.lit(None).cast("string"))
    return named.select("status", "rel_path", "encoded").unionByName(unnamed)


def peek_tree(spark: SparkSession, path: str, sources: DataFrame, source: str, participant: str, root: str) -> DataFrame:
    """The whole drill-down of one root, a row for each set as ``qc.nested_sets`` has it, with content in place of the paths."""
    own = materialize(_own(spark, path, "qc_images", source, participant).where(F.col("root") == root), "own")
    tree = materialize(qc.qc_tree(own), "drill")
    encoded = _contents(tree.select("rel_path").distinct(), sources, source)
    return qc.encode_nested(qc.nested_sets(tree), ["groups", "rest"], encoded, ["source"])


def _recordings(
    spark: SparkSession, store_path: str, source: str, participant: str, step: int, onionskin: bool
) -> DataFrame:
    """Stored blocks of a step and, for an overlay, of the one before it.

    Of a step number's directories only the last in natural order counts.
    """
    steps = [step - 1, step] if onionskin else [step]
    asked = (F.col("source") == source) & (F.col("participant") == participant) & F.col("step_num").isin(steps)
    dirs = catalog.latest_dirs(store.converted(spark, store_path).where(asked))
    return store.read_signal(spark, store_path).where(asked).join(dirs, store.RECORDING, "left_semi")


def _lengths(spark: SparkSession, store_path: str, source: str, participant: str, step: int, onionskin: bool) -> int | None:
    """Length of the longest block of these recordings; the answer is one row."""
    steps = [step - 1, step] if onionskin else [step]
    asked = (F.col("source") == source) & (F.col("participant") == participant) & F.col("step_num").isin(steps)
    return store.converted(spark, store_path).where(asked).agg(F.max("longest")).first()[0]


def _with_scale(spark: SparkSession, store_path: str, long: DataFrame, yaxis: str) -> DataFrame:
    """Add ``scale``: that of the whole recording and the channel's type as it was stored at conversion, or 1."""
    if yaxis != "normalize":
        return long.withColumn("scale", F.lit(1.0))
    scales = store.scales(spark, store_path).select(*store.RECORDING, "ch_type", "scale")
    return long.join(scales, [*store.RECORDING, "ch_type"], "left").withColumn("scale", F.coalesce("scale", F.lit(1.0)))


def _traces(long: DataFrame, yaxis: str, y_limits: tuple[float, float] | None, butterfly: bool) -> DataFrame:
    """Add ``y`` and ``prev_y`` to samples with ``value``, ``prev_value``, ``scale`` and ``kind``."""
    offset = F.col("ch_idx").cast("double")
    y, prev = (signals.trace(F.col(c).cast("double"), offset, F.col("scale")) for c in ("value", "prev_value"))
    if y_limits is not None:
        lo, hi = signals.clip_band(offset, *y_limits, butterfly)
        # The overlay is clipped in every mode, the trace itself if asked for.
        prev = F.when(prev.isNotNull(), signals.clamp(prev, lo, hi))
        if yaxis in ("clamp", "clip"):
            y = F.when(F.col("kind") == "raw", signals.clamp(y, lo, hi)).otherwise(y)
    return long.withColumn("y", y).withColumn("prev_y", prev)


def _unpacked(laid: DataFrame, place: Column, factor: Column) -> DataFrame:
    """A row for each sample that is shown, ``sample_idx, value, prev_value``: every ``factor``-th, counted by ``place`` of a block's first."""
    kept = F.filter(F.sequence(F.lit(0), F.size("samples") - 1), lambda i: (place + i) % factor == 0)
    samples = F.transform(
        kept,
        lambda i: F.struct(
            (F.col("start_sample") + i).alias("sample_idx"),
            F.get("samples", i).alias("value"),
            F.get(F.coalesce("prev_samples", F.array().cast("array<float>")), i).alias("prev_value"),
        ),
    )
    rest = [c for c in laid.columns if c not in ("samples", "prev_samples", "start_sample")]
    return laid.where(F.size("samples") > 0).select(*rest, F.inline(samples))


SHOWN = ["ch_idx", "ch_name", "epoch_idx", "sample_idx", "t", "y", "prev_y"]


def signal_view(
    spark: SparkSession,
    store_path: str,
    source: str,
    participant: str,
    step: int,
    start: int,
    stop: int | None = None,
    yaxis: str = "overdraw",
    onionskin: bool = False,
    decim: int = 1,
    picks: list[str] | None = None,
    data_types: tuple[str, ...] = ("eeg",),
    y_limits: tuple[float, float] | None = None,
    butterfly: bool = False,
) -> DataFrame:
    """Traces of one step over a window, with those of the step before if asked for.

    Rows ``ch_idx, ch_name, epoch_idx, sample_idx, t, y, prev_y``. Both steps come
    from one scan, cut down to the window; they are overlaid and decimated as arrays before any sample is unpacked.
    """
    own = _recordings(spark, store_path, source, participant, step, onionskin)
    # The longest block of these recordings: with it, both bounds of the window reach the reader.
    size = _lengths(spark, store_path, source, participant, step, onionskin)
    window = signals.window_blocks(own, start, stop, picks, size)
    if onionskin and size:
        # Two recordings may be cut into different blocks.
        laid = signals.overlay_overlapping(window, ["source", "participant"], size).where(F.col("step_num") == step)
    else:
        laid = window.where(F.col("step_num") == step).withColumn("prev_samples", F.lit(None).cast("array<float>"))
    long = _unpacked(laid, F.col("start_sample") - start, signals.decimation(decim, F.col("ch_type").isin(*data_types)))
    time = signals.sample_time(F.col("sample_idx"), F.col("sfreq"), F.col("first_time"))
    scaled = _with_scale(spark, store_path, long.withColumn("t", time), yaxis)
    return _traces(scaled, yaxis, y_limits, butterfly).select(*SHOWN).orderBy("ch_idx", "epoch_idx", "sample_idx")


def epoch_view(
    spark: SparkSession,
    store_path: str,
    source: str,
    participant: str,
    step: int,
    t_start: float,
    n_epochs: int,
    yaxis: str = "overdraw",
    onionskin: bool = False,
    decim: int = 1,
    picks: list[str] | None = None,
    data_types: tuple[str, ...] = ("eeg",),
    y_limits: tuple[float, float] | None = None,
    butterfly: bool = False,
) -> DataFrame:
    """``signal_view`` of an epoched recording: ``n_epochs`` epochs from time ``t_start``.

    ``t`` counts along the epochs laid end to end, and so does decimation, from the beginning of the window.
    """
    own = _recordings(spark, store_path, source, participant, step, onionskin).where("kind = 'epochs'")
    if picks is not None:
        own = own.where(F.col("ch_name").isin(*picks))
    length = F.size("samples") / F.col("sfreq")
    first = epochs.first_epoch(t_start, 1 / F.col("sfreq"), length)
    window = epochs.epoch_window(own, first, n_epochs)
    laid = epochs.overlay_epochs(window, ["source", "participant"]).where(F.col("step_num") == step)
    laid = laid.withColumn("_length", length).withColumn("start_sample", F.lit(0).cast("bigint"))
    place = (F.col("epoch_idx") - first) * F.size("samples")
    long = _unpacked(laid, place, signals.decimation(decim, F.col("ch_type").isin(*data_types)))
    time = F.col("epoch_idx") * F.col("_length") + F.col("sample_idx") / F.col("sfreq")
    scaled = _with_scale(spark, store_path, long.withColumn("t", time), yaxis)
    return _traces(scaled, yaxis, y_limits, butterfly).select(*SHOWN).orderBy("ch_idx", "epoch_idx", "sample_idx")
