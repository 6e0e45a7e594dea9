"""Converted signals as a Parquet store, brought up to date in bulk.

``<path>/signal`` holds blocks, ``<path>/recordings`` one row per conversion.
Conversions only append: blocks first, then the rows that make them count, for the
recordings that do have blocks. Each row holds a digest of its blocks, by which ``readable`` finds damaged copies, and
``<path>/scales`` the automatic scale of each channel type, so that views need not read whole recordings. A job that dies in between leaves blocks that no reader
sees, and what counted before still does. At last the files are deleted in which every
recording has a later conversion.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepview.operators import freshness, signals
from stepview.operators.ranking import materialize

#: Bytes of a row group of the signal.
ROW_GROUP = 16 << 20
RECORDING = ["source", "participant", "step_num", "step_dir"]
RECORDINGS = (
    "source string, participant string, step_num bigint, step_dir string, kind string, "
    "sfreq double, first_time double, mtime timestamp, batch string, converted timestamp, "
    "n_blocks bigint, n_samples bigint, longest int, digest string"
)
SCALES = "source string, participant string, step_num bigint, step_dir string, ch_type string, scale double, batch string"
SIGNAL = (
    "participant string, step_dir string, kind string, epoch_idx bigint, ch_idx int, ch_name string, "
    "ch_type string, start_sample bigint, samples array<float>, source string, step_num bigint, batch string"
)


def interleaved(*columns: Column, bits: int = 20) -> Column:
    """The lowest ``bits`` bits of whole numbers by turns, as BIGINT: near in all of them is near in this."""
    most = (1 << bits) - 1
    capped = [F.greatest(F.least(c.cast("bigint"), F.lit(most)), F.lit(0)) for c in columns]
    n = len(columns)
    placed = [F.shiftleft(F.shiftright(c, b).bitwiseAND(1), b * n + i) for b in range(bits) for i, c in enumerate(capped)]
    return functools.reduce(Column.bitwiseOR, placed)


def _read(spark: SparkSession, path: str, schema: str, damaged: bool = False) -> DataFrame:
    """The rows at ``path``, none if there is nothing; ``damaged``: what can be read of damaged files, instead of an error."""
    try:
        return spark.read.schema(schema).option("ignoreCorruptFiles", damaged).parquet(path)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def converted(spark: SparkSession, path: str) -> DataFrame:
    """The last conversion of each recording; ``longest`` is the length of its longest block."""
    log = _read(spark, f"{path}/recordings", RECORDINGS)
    last = F.max(F.struct("converted", "kind", "sfreq", "first_time", "mtime", "batch", "longest", "digest")).alias("_last")
    return log.groupBy(*RECORDING).agg(last).select(*RECORDING, "_last.*").drop("converted")


def read_signal(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of the last conversion of each recording, with ``sfreq`` and ``first_time``."""
    blocks = _read(spark, f"{path}/signal", SIGNAL)
    live = converted(spark, path).select(*RECORDING, "batch", "sfreq", "first_time")
    return blocks.join(live, [*RECORDING, "batch"]).drop("batch")


def scales(spark: SparkSession, path: str) -> DataFrame:
    """``RECORDING``, ``ch_type``, ``scale`` of the last conversion of each recording, over all of its samples."""
    live = converted(spark, path).select(*RECORDING, "batch")
    return _read(spark, f"{path}/scales", SCALES).join(live, [*RECORDING, "batch"]).drop("batch")


def _digests(blocks: DataFrame) -> DataFrame:
    columns = ["kind", "epoch_idx", "ch_idx", "ch_name", "ch_type", "start_sample", "samples"]
    return freshness.digest(blocks, [*RECORDING, "batch"], columns)


def readable(spark: SparkSession, path: str) -> DataFrame:
    """``RECORDING`` and ``readable``: are the blocks of its last conversion those that were written? Reads all of them.

    What shares a file with a damaged recording counts as damaged: the file has to go."""
    stored = _read(spark, f"{path}/signal", SIGNAL, damaged=True)
    wanted = converted(spark, path).select(*RECORDING, "batch", F.col("digest").alias("_digest"))
    same = F.coalesce(F.col("digest") == F.col("_digest"), F.lit(False))
    found = materialize(wanted.join(_digests(stored), [*RECORDING, "batch"], "left").select(*RECORDING, "batch", same.alias("same")), "found")
    files = stored.select(*RECORDING, "batch", F.col("_metadata.file_path").alias("_file")).distinct().join(found, [*RECORDING, "batch"])
    files = materialize(files.select(*RECORDING, "_file", "same"), "files")
    odd = files.where("not same").select("_file").distinct()
    beside = files.join(odd, "_file", "left_semi").select(*RECORDING, F.lit(True).alias("_beside")).distinct()
    good = F.col("same") & F.col("_beside").isNull()
    return found.join(beside, RECORDING, "left").select(*RECORDING, good.alias("readable"))


def statuses(recordings: DataFrame, path: str, check: bool = False) -> DataFrame:
    """``recordings`` with the ``status`` of their copies, as ``freshness.freshness`` has it; ``check`` reads the copies, too."""
    spark = recordings.sparkSession
    copies = converted(spark, path).select(*RECORDING, F.col("kind").alias("_kind"), F.col("mtime").alias("_copied"))
    good = F.lit(True)
    if check:
        copies, good = copies.join(readable(spark, path), RECORDING, "left"), F.col("readable")
    joined = recordings.join(copies.select(*RECORDING, "_kind", "_copied", good.alias("_good")), RECORDING, "left")
    of = {name: F.when(F.col("_kind") == kind, F.col("_copied")) for name, kind in (("raw", "raw"), ("epochs", "epochs"))}
    status = freshness.freshness_status(F.col("mtime"), of["raw"], of["epochs"], F.struct(F.col("_good").alias("raw"), F.col("_good").alias("epochs")))
    return joined.withColumn("status", status).select(*recordings.columns, "status")


def read_fresh(recordings: DataFrame, path: str, check: bool = False) -> DataFrame:
    """The forced mode: blocks of ``recordings`` from their copies alone; the job fails if one has no fresh (and good) copy."""
    # Written out, so that it fails here and not while a damaged copy is read.
    fresh = materialize(freshness.require_fresh(statuses(recordings, path, check)).select(*RECORDING, "status"), "fresh")
    return read_signal(recordings.sparkSession, path).join(fresh.drop("status").distinct(), RECORDING, "left_semi")


def convert(recordings: DataFrame, blocks: DataFrame, path: str, clean: bool = False, check: bool = False) -> DataFrame:
    """Convert what has no fresh conversion and report on all.

    ``recordings`` are rows of ``RECORDING``, ``kind``, ``mtime`` and, if known, ``sfreq``
    and ``first_time``; ``blocks`` their decoded signal. Returns ``RECORDING`` and ``status``: ``Caching``,
    ``Already cached``, or ``no_signal`` for those to be converted that have no block. ``clean`` does
    all given recordings again, and no others. ``check`` reads the copies, and does those again that are damaged.
    """
    spark = recordings.sparkSession
    batch = uuid.uuid4().hex
    for name in ("sfreq", "first_time"):
        if name not in recordings.columns:
            recordings = recordings.withColumn(name, F.lit(None).cast("double"))
    todo = recordings
    if check and not clean:
        todo = statuses(recordings, path, check).where(~F.col("status").isin(*freshness.FRESH))
    elif not clean:
        todo = freshness.pending(recordings, converted(spark, path), RECORDING)
    # Written out: the store changes below, and the report must not see that.
    todo = materialize(todo.select(*RECORDING, "kind", "sfreq", "first_time", "mtime"), "todo")
    done = todo.select(*RECORDING).limit(0)
    if not todo.isEmpty():
        # Ranges cut a source of any size into files of equal size. Within a recording blocks lie so that those near in time
        # and channel are near in the file: a window and a pick both leave row groups out.
        place = F.coalesce("epoch_idx", F.floor(F.col("start_sample") / F.greatest(F.size("samples"), F.lit(1))))
        order = ["source", "step_num", "participant", "step_dir", "_place", "start_sample", "ch_idx"]
        (
            blocks.join(todo, RECORDING, "left_semi")
            .withColumns({"batch": F.lit(batch), "_place": interleaved(place, F.col("ch_idx"))})
            .repartitionByRange(*order)
            .sortWithinPartitions(*order)
            .select(*T.StructType.fromDDL(SIGNAL).names)
            .write.mode("append")
            .option("parquet.block.size", ROW_GROUP)
            .partitionBy("source", "step_num", "batch")
            .parquet(f"{path}/signal")
        )
        size = F.size("samples")
        new = _read(spark, f"{path}/signal", SIGNAL).where(F.col("batch") == batch)
        written = new.groupBy(*RECORDING)
        written = written.agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(size.cast("bigint")).alias("n_samples"), F.max(size).alias("longest"))
        samples = new.select(*RECORDING, "ch_type", F.explode(F.col("samples").cast("array<double>")).alias("value"))
        scaled = signals.auto_scales(samples, [*RECORDING, "ch_type"]).withColumn("batch", F.lit(batch))
        scaled.select(*T.StructType.fromDDL(SCALES).names).write.mode("append").parquet(f"{path}/scales")
        done = todo.join(written, RECORDING).join(_digests(new).drop("batch", "n_rows"), RECORDING)
        done = done.withColumns({"batch": F.lit(batch), "converted": F.current_timestamp()})
        done = materialize(done.select(*T.StructType.fromDDL(RECORDINGS).names), "done")
        done.write.mode("append").parquet(f"{path}/recordings")
        _drop_superseded(spark, path, done, check)
    status = F.when(F.col("_done"), "Caching").when(F.col("_todo"), "no_signal").otherwise("Already cached")
    marked = todo.select(*RECORDING, F.lit(True).alias("_todo"))
    cached = done.select(*RECORDING, F.lit(True).alias("_done"))
    return recordings.join(marked, RECORDING, "left").join(cached, RECORDING, "left").select(*RECORDING, status.alias("status"))


def _drop_superseded(spark: SparkSession, path: str, done: DataFrame, check: bool) -> None:
    """Delete the files of finished batches in which no recording's last conversion is left.

    Only the partitions that ``done`` has written to are looked at. Blocks without a row
    in ``recordings`` may belong to a job that still runs, and stay.
    """
    finished = _read(spark, f"{path}/recordings", RECORDINGS).select("batch").distinct()
    live = converted(spark, path).select(*RECORDING, "batch", F.lit(True).alias("_live"))
    partitions = done.select("source", "step_num").distinct()
    blocks = _read(spark, f"{path}/signal", SIGNAL, damaged=check).select(*RECORDING, "batch", F.col("_metadata.file_path").alias("_file"))
    old = blocks.join(partitions, ["source", "step_num"], "left_semi").join(finished, "batch", "left_semi").distinct()
    files = old.join(live, [*RECORDING, "batch"], "left").groupBy("_file").agg(F.max("_live").alias("_live"))
    gone = {row["_file"] for row in files.where("_live is null").toLocalIterator()}
    if check:
        # A damaged file would fail every reader. Whoever had rows in it is converted again, so that what can still be read of
        # it is of no later use: files are kept for rows that count, or that may do so once a running job ends.
        every = _read(spark, f"{path}/signal", SIGNAL, damaged=True)
        # All columns are read, else damage to some would go unseen.
        row = F.xxhash64(*every.columns)
        rows = every.select(*RECORDING, "batch", F.col("_metadata.file_path").alias("_file"), row.alias("_row"))
        rows = rows.groupBy(*RECORDING, "batch", "_file").agg(F.bit_xor("_row").alias("_row")).where("_row is not null")
        ended = finished.withColumn("_finished", F.lit(True))
        needed = rows.join(live, [*RECORDING, "batch"], "left").join(ended, "batch", "left").where("_live or _finished is null")
        # The two are spelled differently, but for the decoded path.
        plain = lambda uri: spark._jvm.java.net.URI(uri).getPath()
        kept = {plain(row["_file"]) for row in needed.select("_file").distinct().toLocalIterator()}
        gone = {uri for uri in every.inputFiles() if plain(uri) not in kept}
    for uri in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(uri))
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, False)
