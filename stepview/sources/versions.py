"""Folders whose content is replaced as a whole.

A new version is written beside the old ones and counts once it has its mark. Whoever
reads meanwhile has the version before, and a job that dies leaves it untouched.
"""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

MARK, CLAIMS = "_COMPLETE", "_claims"


def hadoop(spark: SparkSession, path: str):
    """The path and its file system, as Hadoop has them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def complete(spark: SparkSession, path: str) -> list[str]:
    """Names of the versions below ``path`` that count, oldest first."""
    where, files = hadoop(spark, path)
    if not files.exists(where):
        return []
    names = [s.getPath().getName() for s in files.listStatus(where) if s.isDirectory()]
    return sorted(n for n in names if re.fullmatch("v[0-9]{10}-.*", n) and files.exists(hadoop(spark, f"{path}/{n}/{MARK}")[0]))


def current(spark: SparkSession, path: str) -> str | None:
    """The folder that counts now."""
    names = complete(spark, path)
    return f"{path}/{names[-1]}" if names else None


def base_of(name: str) -> int | None:
    """Number of the version that the version of this name only adds to."""
    found = re.search(r"\.on-([0-9]{10})$", name)
    return int(found[1]) if found else None


def numbered(spark: SparkSession, path: str, number: int) -> str:
    """The folder of the version with this number."""
    return next(f"{path}/{n}" for n in complete(spark, path) if int(n[1:11]) == number)


def _claims(spark: SparkSession, path: str) -> list[int]:
    where, files = hadoop(spark, f"{path}/{CLAIMS}")
    return [int(s.getPath().getName()) for s in files.listStatus(where)] if files.exists(where) else []


@contextlib.contextmanager
def new_version(spark: SparkSession, path: str, base: int | None = None) -> Iterator[str]:
    """A folder to write into; it counts from the end of the block on, unless that fails: then it is deleted.

    With ``base`` the version only adds to the one of that number. The version before is kept for its readers, and
    whatever it or the new one adds to; all others are deleted. Each number can be claimed once: of two writers that
    began with the same version the second raises ``RuntimeError``, instead of undoing what the first has written.
    """
    before = complete(spark, path)
    number = max([0, *(int(n[1:11]) for n in before), *_claims(spark, path)]) + 1
    folder = f"{path}/v{number:010d}-{uuid.uuid4().hex}" + (f".on-{base:010d}" if base else "")
    try:
        yield folder
        claim, files = hadoop(spark, f"{path}/{CLAIMS}/{number:010d}")
        if not files.createNewFile(claim):
            raise RuntimeError(f"{path}: version {number} was written by someone else meanwhile")
    except BaseException:
        half, files = hadoop(spark, folder)
        files.delete(half, True)
        raise
    mark, files = hadoop(spark, f"{folder}/{MARK}")
    files.create(mark).close()
    needed = {base_of(folder), *map(base_of, before[-1:])}
    for name in before[:-1]:
        if int(name[1:11]) not in needed:
            old, files = hadoop(spark, f"{path}/{name}")
            files.delete(old, True)
    for old_number in _claims(spark, path):
        if old_number < number - 1:
            old, files = hadoop(spark, f"{path}/{CLAIMS}/{old_number:010d}")
            files.delete(old, False)
