"""What differs between two listings of the same trees, and who is touched by that."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepview.functions import paths
from stepview.operators import catalog
from stepview.operators.logs import log_files
from stepview.operators.prefix import prefix_join
from stepview.operators.qc import qc_files

ENTRY = ["source", "rel_path"]
STATE = ["is_dir", "mtime", "size"]


def changes(old: DataFrame, new: DataFrame, keys: list[str] = ENTRY, state: list[str] = STATE) -> DataFrame:
    """``keys`` and ``change`` (``added``, ``removed``, ``modified``) of all rows that differ; keys are unique in each listing."""
    before, after = (t.select(*keys, F.struct(*state).alias(n)) for t, n in ((old, "_old"), (new, "_new")))
    before, after = before.withColumn("_in", F.lit(True)), after.withColumn("_in", F.lit(True))
    # Columns of their own, so that a listing can be compared with itself.
    after = after.select(*[F.col(c).alias(c) for c in after.columns])
    same = functools.reduce(Column.__and__, [before[k].eqNullSafe(after[k]) for k in keys])
    change = (
        F.when(before["_in"].isNull(), "added")
        .when(after["_in"].isNull(), "removed")
        .when(~before["_old"].eqNullSafe(after["_new"]), "modified")
    )
    named = [F.when(before["_in"].isNull(), after[k]).otherwise(before[k]).alias(k) for k in keys]
    return before.join(after, same, "full_outer").select(*named, change.alias("change")).where("change is not null")


def touched(changed: DataFrame, people: DataFrame) -> DataFrame:
    """Participants with a row in any table that a changed entry can alter.

    Those whose recording, or a copy of it, has come, gone or changed; and of ``people``, those whose logs or images
    have. ``people`` are the participants of both listings.
    """
    path, name = F.col("rel_path"), F.substring_index("rel_path", "/", -1)
    entries = changed.select("source", "rel_path", path.alias("path"), name.alias("name"), F.lit(False).alias("is_dir"))
    stem = F.when(name.endswith(paths.RECORDING_SUFFIX), paths.recording_stem(name)).otherwise(paths.copied_stem(name))
    owners = entries.where(path.rlike(paths.RECORDING_OR_COPY_PATH)).select("source", stem.alias("participant"))
    files = log_files(entries).select("source", "name").unionByName(
        qc_files(entries).select("source", paths.base_name(path).alias("name"))
    )
    matched = prefix_join(files.distinct(), people.select(*catalog.PARTICIPANT).distinct(), by=["source"])
    return owners.unionByName(matched.select(*catalog.PARTICIPANT)).distinct()
