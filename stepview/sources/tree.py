"""Directory trees as a ``manifest`` relation."""

from __future__ import annotations

import itertools
import os
import random
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepview.functions import paths
from stepview.operators.ranking import materialize

ENTRY = "source string, path string, rel_path string, is_dir boolean, mtime timestamp, size bigint"
COLUMNS = ["source", "path", "rel_path", "is_dir", "mtime", "size"]
BATCH_ROWS = 5000
#: Entries of a folder that one unit of work looks at, and names kept to cut a larger folder by.
RANGE, SAMPLE = 20_000, 4096


def names(folder: str) -> Iterator[str]:
    """Names in a folder, not looked at any further; a folder that can't be listed has none."""
    try:
        entries = os.scandir(folder)
    except OSError:
        return
    with entries:
        for entry in entries:
            yield entry.name


def ranges(found: Iterator[str], most: int = RANGE) -> list[tuple[str | None, str | None]]:
    """Ranges (from, up to but without) of names with about ``most`` of them each; open at both ends, so that no name is left out.

    Of the names a sample of ``SAMPLE`` is kept, whatever their number."""
    rng, kept, n = random.Random(0), [], 0
    for n, name in enumerate(found, 1):
        if len(kept) < SAMPLE:
            kept.append(name)
        elif (at := rng.randrange(n)) < SAMPLE:
            kept[at] = name
    pieces = min(-(-n // most), len(kept)) or 1
    kept.sort()
    cuts = sorted({kept[len(kept) * i // pieces] for i in range(1, pieces)})
    return list(zip([None, *cuts], [*cuts, None], strict=True))


def entries(source: str, folder: str, rel: str, low: str | None = None, high: str | None = None) -> Iterator[tuple]:
    """Rows of ``ENTRY`` of a folder's entries with names in a range."""
    try:
        found = os.scandir(folder)
    except OSError:
        return
    with found:
        for entry in found:
            if (low is not None and entry.name < low) or (high is not None and entry.name >= high):
                continue
            try:
                stat = entry.stat()
            except OSError:  # gone meanwhile, or a dangling link
                continue
            # Whole microseconds: a float would round.
            seconds, rest = divmod(stat.st_mtime_ns // 1000, 1_000_000)
            mtime = datetime.fromtimestamp(seconds, timezone.utc).replace(microsecond=rest)
            rel_path = f"{rel}/{entry.name}" if rel else entry.name
            is_dir = entry.is_dir(follow_symlinks=not rel)  # deeper links could be cycles
            yield source, entry.path, rel_path, is_dir, mtime, None if is_dir else stat.st_size


def _cut_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each folder with its ranges of names."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            cut = ranges(names(row.path))
            yield pd.DataFrame([(row.source, row.path, row.rel_path, low, high) for low, high in cut], columns=[*batch.columns, "low", "high"])


def _list_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries of each range of a folder, in batches."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            found = entries(row.source, row.path, row.rel_path, row.low, row.high)
            while rows := list(itertools.islice(found, BATCH_ROWS)):
                yield pd.DataFrame(rows, columns=COLUMNS).astype({"size": "Int64"})


def _listed(folders: DataFrame) -> DataFrame:
    """One level below ``folders(source, path, rel_path)``: folders are cut into ranges of names, these are spread over all tasks."""
    tasks = int(folders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = folders.select("source", "path", "rel_path").repartition(tasks, "path")
    cut = spread.mapInPandas(_cut_folders, "source string, path string, rel_path string, low string, high string")
    return materialize(cut.repartition(tasks, "path", "low").mapInPandas(_list_ranges, ENTRY), "tree")


def manifest(sources: DataFrame, shallow: bool = False) -> DataFrame:
    """Everything below the directories of ``sources(name, directory)``.

    Directories, empty ones included, and hidden files are listed; Spark's file
    readers leave both out. The walk goes level by level, each level one job with
    a range of a folder's names as the unit of work, so neither the driver nor one task sees
    a whole tree or a whole large folder. Below the top only numbered directories, ``logs`` and
    ``quality_control`` are entered; ``shallow`` leaves the latter two out and
    stops below the former. The folders must be visible to all executors.
    """
    roots = sources.select(F.col("name").alias("source"), F.col("directory").alias("path"), F.lit("").alias("rel_path"))
    level = _listed(roots)
    found = level
    wanted = paths.is_numbered(F.col("rel_path"))
    if not shallow:
        wanted |= F.col("rel_path").isin("logs", "quality_control")
    folders = level.where(F.col("is_dir") & wanted)
    while not folders.isEmpty():
        level = _listed(folders)
        found = found.unionByName(level)
        if shallow:
            break
        # Steps are two levels deep; only the other two are walked to the bottom.
        folders = level.where(F.col("is_dir") & F.col("rel_path").rlike("^(logs|quality_control)/"))
    return described(found)


def described(entries: DataFrame) -> DataFrame:
    """The ``manifest`` columns for a listing made elsewhere (an object store's, say)."""
    name = paths.base_name(F.col("rel_path"))
    return entries.select(
        "source",
        "path",
        "rel_path",
        paths.parts(F.col("rel_path")).alias("parts"),
        name.alias("name"),
        paths.stem(name).alias("stem"),
        paths.suffix(name).alias("suffix"),
        paths.parent(F.col("rel_path")).alias("parent"),
        "is_dir",
        "mtime",
        "size",
    )
