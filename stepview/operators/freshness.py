"""Which recordings have a fresh converted copy, and which must be converted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepview.functions import paths

FRESH = ("fresh_raw", "fresh_epochs")


def freshness_status(base: Column, raw: Column, epochs: Column, readable: Column | None = None) -> Column:
    """Status from the three modification times; a raw copy is looked at first.

    A copy as old as its recording is fresh. ``readable`` is a struct
    ``(raw BOOLEAN, epochs BOOLEAN)``; a fresh copy that cannot be read
    does not count.
    """
    new_raw, new_epochs = raw >= base, epochs >= base
    if readable is None:
        use_raw, use_epochs, broken = new_raw, new_epochs, F.lit(False)
    else:
        use_raw = new_raw & F.coalesce(readable["raw"], F.lit(True))
        use_epochs = new_epochs & F.coalesce(readable["epochs"], F.lit(True))
        broken = F.coalesce(new_raw, F.lit(False)) | F.coalesce(new_epochs, F.lit(False))
    return (
        F.when(use_raw, FRESH[0])
        .when(use_epochs, FRESH[1])
        .when(broken, "unreadable")
        .when(raw.isNotNull() | epochs.isNotNull(), "stale")
        .otherwise("missing")
    )


def freshness(caches: DataFrame) -> DataFrame:
    """``status`` for each row of ``caches(…, base_mtime, raw_mtime, epo_mtime)``.

    ``raw_readable`` and ``epo_readable`` (BOOLEAN) may be among the columns; a NULL there counts as readable.
    """
    known = [c for c in ("raw_readable", "epo_readable") if c in caches.columns]
    readable = F.struct(*[(F.col(c) if c in known else F.lit(None).cast("boolean")).alias(n) for c, n in (("raw_readable", "raw"), ("epo_readable", "epochs"))])
    status = freshness_status(F.col("base_mtime"), F.col("raw_mtime"), F.col("epo_mtime"), readable if known else None)
    return caches.withColumn("status", status).drop("base_mtime", "raw_mtime", "epo_mtime", *known)


def digest(blocks: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``keys``, number of rows and ``digest`` of all their values, whatever the order of the rows; partial results merge."""
    row = F.xxhash64(*columns)
    # The second sum tells rows that occur twice, which the exclusive or would take out.
    halves = F.sum(F.shiftrightunsigned(F.xxhash64(row), 32)) + F.sum(F.shiftright(F.xxhash64(F.lit(1), row), 32))
    return blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.concat_ws("-", F.hex(F.bit_xor(row)), F.hex(halves)).alias("digest"))


def caches(manifest: DataFrame) -> DataFrame:
    """Recordings of the numbered directories with their copies' times, or NULL.

    A recording and its two copies are siblings, so they are brought together
    by (source, folder, stem) in one aggregation instead of two joins.
    """
    path = F.col("rel_path")
    name = F.substring_index(path, "/", -1)
    base, raw = name.endswith(paths.RECORDING_SUFFIX), name.endswith(paths.RAW_COPY_ENDING)
    # The pattern has settled what each file is; its ending tells which.
    stem = F.when(base, paths.recording_stem(name)).otherwise(paths.copied_stem(name))
    return (
        manifest.where(path.rlike(paths.RECORDING_OR_COPY_PATH) & ~F.col("is_dir"))
        .select(
            "source",
            F.substring_index(path, "/", 1).alias("step_dir"),
            stem.alias("participant"),
            F.when(base, "base").when(raw, "raw").otherwise("epo").alias("_role"),
            "mtime",
        )
        .groupBy("source", "step_dir", "participant")
        .agg(*[F.max(F.when(F.col("_role") == r, F.col("mtime"))).alias(f"{r}_mtime") for r in ("base", "raw", "epo")])
        .where("base_mtime is not null")
    )


def conversion_plan(statuses: DataFrame, clean: bool = False) -> DataFrame:
    """What a bulk conversion reports for each recording; ``clean`` redoes them all."""
    fresh = F.col("status").isin(*FRESH) & F.lit(not clean)
    return statuses.withColumn("status", F.when(fresh, "Already cached").otherwise("Caching"))


def pending(recordings: DataFrame, converted: DataFrame, keys: list[str]) -> DataFrame:
    """Recordings without a conversion at least as new as they are."""
    new = converted.select(*keys, F.col("mtime").alias("_converted"))
    same = [recordings[k] == new[k] for k in keys]
    return recordings.join(new, [*same, new["_converted"] >= recordings["mtime"]], "left_anti")


def require_fresh(statuses: DataFrame) -> DataFrame:
    """The forced mode: the job fails on the first recording without a fresh copy."""
    message = F.concat(F.lit("no fresh copy: "), F.col("status"))
    checked = F.when(F.col("status").isin(*FRESH), F.col("status")).otherwise(F.raise_error(message))
    return statuses.withColumn("status", checked)
