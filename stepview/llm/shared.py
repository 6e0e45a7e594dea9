"""Tables between steps, and the small things every operator here needs."""

from __future__ import annotations

import contextlib
import contextvars
import functools
import pathlib
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tables of the open scopes, innermost last; each thread (and each context) has its own.
_open: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=())
_shipped: set[str] = set()
_shipping = threading.Lock()


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-llm-")


def folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a new one, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, tag: str, outer: bool = False) -> str:
    """A path in the shared folder that goes away with the session, or with the enclosing ``scope`` (``outer``: the one around that)."""
    path = f"{folder(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"
    where, system = _hadoop(spark, path)
    system.deleteOnExit(where)
    scopes = _open.get()[:-1] if outer else _open.get()
    if scopes:
        scopes[-1].append(path)
    return path


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables saved inside are deleted at the end, but for those saved as ``outer``; what is used later must not read them."""
    mine: list[str] = []
    before = _open.set((*_open.get(), mine))
    try:
        yield
    finally:
        _open.reset(before)
        for path in mine:
            drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    where, system = _hadoop(spark, path)
    system.delete(where, True)


def saved(df: DataFrame, tag: str, outer: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, lost executors lose nothing."""
    path = new_path(df.sparkSession, tag, outer)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they start; once for each Spark application."""
    with _shipping:
        if spark.sparkContext.applicationId in _shipped:
            return
        package = pathlib.Path(__file__).resolve().parents[1]
        path = pathlib.Path(tempfile.mkdtemp(prefix="spark-llm-")) / f"{package.name}.zip"
        with zipfile.ZipFile(path, "w") as file:
            for module in sorted(package.rglob("*.py")):
                file.write(module, module.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(path))
        _shipped.add(spark.sparkContext.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def beside(docs: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, int, int]:
    """Columns ``keep`` of ``docs`` and ``text`` among or behind them: the table, the place of the text, how many to keep."""
    if text in keep:
        return docs.select(*map(col, keep)), keep.index(text), len(keep)
    return docs.select(*map(col, keep), col(text).alias("\0text")), len(keep), len(keep)


def map_batches(df: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for columns of any name: it can't take names with dots."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, schema)


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, each lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
