"""The registry of sources: unique name and directory."""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepview.operators.ranking import materialize, rank
from stepview.sources import versions

SCHEMA = "name string, directory string"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry kept at ``path`` as JSON; values become strings."""
    return spark.read.schema(SCHEMA).json(versions.current(spark, path) or path)


def registry(spark: SparkSession, sources: dict[str, object] | None) -> DataFrame:
    """A registry from a mapping; none is an empty one."""
    return spark.createDataFrame([(str(k), normalized(str(v))) for k, v in (sources or {}).items()], SCHEMA)


def write_registry(sources: DataFrame, path: str) -> None:
    """Keep ``sources`` at ``path``, also if they were read from there."""
    with versions.new_version(sources.sparkSession, path) as folder:
        sources.select("name", "directory").write.json(folder)


def normalized(directory: str, home: str | None = None) -> str:
    """A directory's plain form: ``~`` filled in, no double or trailing slash, no ``.``.

    ``..`` stays: behind a link it does not lead back to where the link is.
    """
    if directory == "~" or directory.startswith("~/"):
        directory = (home or os.path.expanduser("~")) + directory[1:]
    if not directory:
        return directory
    plain = "/".join(p for p in directory.split("/") if p not in ("", "."))
    return f"/{plain}" if directory.startswith("/") else plain or "."


def _normalized(rows: DataFrame) -> DataFrame:
    """``rows`` with plain directories; ``~`` is the home of who calls."""
    home = os.path.expanduser("~")

    def plain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(directory=[None if d is None else normalized(d, home) for d in batch["directory"]])

    return rows.mapInPandas(plain, rows.schema)


def directory_of(sources: DataFrame, name: str) -> str:
    """The directory of one source; an unknown name is an error."""
    found = sources.where(F.col("name") == name).select("directory").head()
    if found is None:
        raise KeyError(name)
    return found["directory"]


def with_directory(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """``requests(source, …)`` with their directory and ``known`` (BOOLEAN)."""
    named = sources.select(F.col("name").alias("source"), "directory")
    return requests.join(named, "source", "left").withColumn("known", F.col("directory").isNotNull())


def without(sources: DataFrame, name: str) -> DataFrame:
    """The registry without ``name``; nothing happens if it is not in there."""
    return sources.where(F.col("name") != name)


def checked(arrivals: DataFrame) -> DataFrame:
    """``arrivals`` with ``is_dir``: false ones are to be rejected. Checked by the executors."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(is_dir=[os.path.isdir(d) for d in batch["directory"]])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in arrivals.schema)
    return _normalized(arrivals).mapInPandas(look, f"{columns}, is_dir boolean")


def default_name(name, directory):
    """The name asked for, else the directory's last segment, else the directory."""
    bare = F.regexp_replace(directory, r"/+$", "")
    last = F.substring_index(bare, "/", -1)
    given = F.when(name != "", name)
    return F.trim(F.coalesce(given, F.when(last != "", last), directory))


def _taken_in_turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Unique names of rows that come by family and arrival: each gets the first name that is free or its own directory's.

    For every name that has been numbered, the numbers in use point to the next one that may be free.
    """
    family: object = None
    taken: dict[str, str] = {}
    after: dict[str, dict[int, int]] = {}
    held: dict[tuple[str, str], int] = {}

    def free(base: str) -> int:
        used, k, passed = after.setdefault(base, {}), 2, []
        while k in used:
            passed.append(k)
            k = used[k]
        for p in passed:
            used[p] = k
        return k

    for batch in batches:
        given = []
        for row in batch.itertuples(index=False):
            if row.family != family:
                family, taken, after, held = row.family, {}, {}, {}
            name = row.name
            if taken.get(name, row.directory) != row.directory:
                name = f"{name}-{min(free(name), held.get((name, row.directory), sys.maxsize))}"
            given.append(name)
            if name in taken:
                continue
            taken[name] = row.directory
            if made := re.fullmatch("(.*)-([2-9]|[1-9][0-9]+)", name, re.DOTALL):
                base, k = made[1], int(made[2])
                after.setdefault(base, {})[k] = k + 1
                held[base, row.directory] = min(k, held.get((base, row.directory), k))
        yield batch[["name", "directory"]].assign(unique_name=given)


def unique_names(arrivals: DataFrame) -> DataFrame:
    """Names made unique: ``(name, directory, unique_name)`` for ``arrivals(name, directory, arrival)``.

    Directories are compared in their plain form. A name taken by another directory becomes ``name-2``, ``name-3``, …; the same
    name and directory again make no new entry. ``arrival`` is a number
    unique to a row. A numbered name may also have been given as such (``x-2``): then the earlier arrival keeps it,
    and the later one's name skips that number. Where that can't happen, as all names of a family (but for numbers at
    the end) are the same, names are numbered by rank, in many tasks. The other families depend on the order of
    their arrivals from one to the next, so each of them goes through one task, row by row.
    """
    rows = _normalized(arrivals.select("name", "directory", "arrival")).groupBy("name", "directory").agg(F.min("arrival").alias("arrival"))
    family = F.regexp_replace("name", r"(-[1-9][0-9]*)+$", "")
    rows = materialize(rows.withColumn("family", family), "arrivals")
    mixed = rows.groupBy("family").agg(F.min("name").alias("low"), F.max("name").alias("high")).where("low <> high")
    mixed = mixed.select("family")
    ranked = rank(rows.join(mixed, "family", "left_anti"), ["name"], ["arrival"], "k")
    slot = F.when(F.col("k") == 1, F.col("name")).otherwise(F.concat_ws("-", "name", "k"))
    turns = rows.join(mixed, "family", "left_semi").repartition("family").sortWithinPartitions("family", "arrival")
    settled = turns.mapInPandas(_taken_in_turn, "name string, directory string, unique_name string")
    return ranked.select("name", "directory", slot.alias("unique_name")).unionByName(materialize(settled, "names"))
