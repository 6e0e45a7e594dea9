"""A source's directory tree as a Spark data source.

``spark.dataSource.register(TreeSource)`` once, then
``spark.read.format("stepview_tree").option("source", "lab").load("/data/lab")`` gives the rows of ``tree.ENTRY``, which
``tree.described`` makes a manifest of. Partitions are ranges of names within folders: the source's own, its numbered
ones, and those that begin ``logs`` and ``quality_control``, whose folders are walked by the task that finds them.
``tree.manifest`` lists many sources, and every level of a deep tree, in jobs; this is for one source in one scan.
"""

from __future__ import annotations

import dataclasses
import os
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from stepview.functions import paths
from stepview.sources import tree

_DEEP = ("logs", "quality_control")


@dataclasses.dataclass
class Range(InputPartition):
    """Names of a folder in ``[low, high)``; with ``deep``, also all that is below them."""

    path: str
    rel_path: str
    low: str | None
    high: str | None
    deep: bool


class TreeSource(DataSource):
    """Options: ``path``, ``source`` (its name), ``shallow`` (leave out logs and images), ``range`` (entries of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "stepview_tree"

    def schema(self) -> str:
        return tree.ENTRY

    def reader(self, schema: StructType) -> DataSourceReader:
        return TreeReader(self.options)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/") or "/"
        self.source = options.get("source", os.path.basename(self.root))
        self.shallow = options.get("shallow", "false").lower() == "true"
        self.most = int(options.get("range", tree.RANGE))

    def partitions(self) -> list[InputPartition]:
        """Only names are looked at here; of a folder with many, a sample of them is kept."""

        def cut(rel_path: str, deep: bool) -> list[InputPartition]:
            path = f"{self.root}/{rel_path}" if rel_path else self.root
            return [Range(path, rel_path, low, high, deep) for low, high in tree.ranges(tree.names(path), self.most)]

        def entered(name: str) -> bool:
            wanted = re.match(paths.NUMBERED_PATTERN, name) or (name in _DEEP and not self.shallow)
            return bool(wanted) and os.path.isdir(f"{self.root}/{name}")

        found = cut("", False)
        for name in filter(entered, tree.names(self.root)):
            found += cut(name, name in _DEEP)
        return found

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        found = tree.entries(self.source, partition.path, partition.rel_path, partition.low, partition.high)
        waiting = [found]
        while waiting:
            row = next(waiting[-1], None)
            if row is None:
                waiting.pop()
                continue
            yield row
            if partition.deep and row[3]:
                waiting.append(tree.entries(self.source, row[1], row[2]))
