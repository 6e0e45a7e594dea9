"""Log files of participants and their contents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepview.operators.prefix import prefix_join


def log_files(manifest: DataFrame) -> DataFrame:
    """Files anywhere below ``logs/``; ``rel_path`` is relative to the source."""
    return manifest.where(~F.col("is_dir") & F.col("rel_path").startswith("logs/")).select(
        "source", "name", "rel_path", "path"
    )


def logs_for_participants(
    logs: DataFrame, participants: DataFrame, by: tuple[str, ...] = ("source",), longest: bool = False
) -> DataFrame:
    """Every participant's logs, in path order."""
    keep = [*by, "name", "rel_path"]
    matched = prefix_join(logs.select(*keep), participants, by=by, longest=longest)
    return matched.select(*by, "participant", "rel_path").orderBy(*by, "participant", "rel_path")


def listed_requests(requests: DataFrame, listed: DataFrame) -> DataFrame:
    """Requests for a log that is among the participant's listed ones."""
    keys = [c for c in ("source", "participant", "rel_path") if c in listed.columns]
    return requests.join(listed, keys, "left_semi")


def read_logs(listed: DataFrame) -> DataFrame:
    """Add ``content``, the whole text, to rows with the ``path`` of a log file.

    The executors open the paths, so these must lie on a folder they all see.
    Spark's own text reader is not used as it leaves out names that start with
    ``_`` or ``.``.
    """
    columns = listed.columns
    # A split of a listing holds few bytes but many files: spread by count.
    tasks = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.iloc[i : i + 1]
                with open(row["path"].iat[0], encoding="utf-8", errors="replace") as file:
                    yield row.assign(content=file.read())

    schema = T.StructType([*listed.schema.fields, T.StructField("content", T.StringType())])
    return listed.repartition(tasks, "path").mapInPandas(read, schema).select(*columns, "content")
