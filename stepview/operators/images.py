"""Border trimming and encoding of images."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from stepview.functions.labels import base64_text
from stepview.operators import png

# Output of one batch; ``spark.sql.execution.arrow.maxBytesPerBatch`` limits its input.
BATCH_BYTES = 32 << 20
TRIMMED = "x0 int, y0 int, x1 int, y1 int, png binary"
DECODED = "status string, height int, width int, n_channels int, by_alpha boolean, data binary"
#: What becomes of a file: its pixels are there, it is not there, it can't be opened, it is of another kind, it is damaged.
STATUSES = ("ok", "missing", "unreadable", "other", "broken")


def read_images(spark: SparkSession, files: list[str]) -> DataFrame:
    """Spark's ``image`` rows for files and for all below folders, of any kind that Java reads; others are left out."""
    plain = [re.sub(r"([*?\[\]{}\\])", r"\\\1", f) for f in files]
    return spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(plain)


def pixel_boxes(pixels: DataFrame) -> DataFrame:
    """Trim box per image of ``pixels(image, x, y, v)``; right and bottom exclusive.

    The box holds the pixels that differ from the top-left one; the whole
    image if none does. Pixels are first reduced to one box per colour on the
    map side, so an image is only brought together after that.
    """
    x, y = F.col("x"), F.col("y")
    corner = F.max((x == 0) & (y == 0))
    boxes = [F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1")]
    colours = pixels.groupBy("image", "v").agg(*boxes, corner.alias("_corner"))
    differs = ~F.col("_corner")

    def edge(pick, name: str):
        return F.coalesce(pick(F.when(differs, F.col(name))), pick(F.col(name)))

    return colours.groupBy("image").agg(
        edge(F.min, "x0").alias("x0"),
        edge(F.min, "y0").alias("y0"),
        (edge(F.max, "x1") + 1).alias("x1"),
        (edge(F.max, "y1") + 1).alias("y1"),
    )


def _extent(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    rows, columns = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    if not rows.size:
        return None
    return int(columns[0]), int(rows[0]), int(columns[-1]) + 1, int(rows[-1]) + 1


def trim_box(pixels: np.ndarray, by_alpha: bool = True) -> tuple[int, int, int, int]:
    """Box to crop a (height, width, channel) array to.

    With an alpha channel (2 or 4 channels) the pixels that are not fully
    transparent count; if there are none, or without alpha, those whose
    colour differs from the top-left pixel's; if there are none, all.
    Without ``by_alpha`` the alpha channel is left aside.
    """
    has_alpha = pixels.shape[2] in (2, 4)
    box = _extent(pixels[:, :, -1] != 0) if has_alpha and by_alpha else None
    if box is None:
        colour = pixels[:, :, :-1] if has_alpha else pixels
        box = _extent((colour != colour[0, 0]).any(axis=2))
    return box or (0, 0, pixels.shape[1], pixels.shape[0])


def png_bytes(pixels: np.ndarray) -> bytes:
    """A PNG file of a (height, width, channel) array in BGR(A) or gray(+alpha) order."""
    return png.encode(_turned(pixels))


def _turned(pixels: np.ndarray) -> np.ndarray:
    """BGR(A) to RGB(A) order, or back."""
    return pixels if pixels.shape[2] < 3 else pixels[:, :, [2, 1, 0, 3][: pixels.shape[2]]]


def trimmed(images: DataFrame) -> DataFrame:
    """Trim box and cropped PNG for rows ``(key, height, width, n_channels, data)``.

    Images reach and leave the function in batches limited by their bytes.
    """
    key = images.schema["key"].dataType.simpleString()
    columns = ["key", "x0", "y0", "x1", "y1", "png"]

    def crop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for row in batch.itertuples(index=False):
                shape = (row.height, row.width, row.n_channels)
                pixels = np.frombuffer(row.data, dtype=np.uint8).reshape(shape)
                x0, y0, x1, y1 = trim_box(pixels)
                rows.append((row.key, x0, y0, x1, y1, png_bytes(pixels[y0:y1, x0:x1])))
                size += len(rows[-1][-1])
                if size > BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return images.select("key", "height", "width", "n_channels", "data").mapInPandas(crop, f"key {key}, {TRIMMED}")


def encoded_images(images: DataFrame) -> DataFrame:
    """Spark ``image`` rows to ``(origin, encoded)``: trimmed, as base64 of a PNG file."""
    flat = images.select(
        F.col("image.origin").alias("key"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("n_channels"),
        F.col("image.data").alias("data"),
    )
    return trimmed(flat).select(F.col("key").alias("origin"), base64_text(F.col("png")).alias("encoded"))


def _content(path: str) -> tuple[str, bytes | None]:
    try:
        with open(path, "rb") as file:
            return "ok", file.read()
    except (FileNotFoundError, NotADirectoryError):
        return "missing", None
    except OSError:
        return "unreadable", None


def _pixels(status: str, content: bytes | None) -> tuple[str, np.ndarray | None, bool]:
    if content is None:
        return ("missing" if status == "ok" else status), None, False
    if not png.is_png(content):
        return "other", None, False
    try:
        return "ok", *png.decode(content)
    except png.Broken:
        return "broken", None, False


def _row_by_row(files: DataFrame, last: str, schema: str, made: Callable[[str, np.ndarray | None, bool], tuple]) -> DataFrame:
    """Columns of ``files`` but for ``last``, a path or a file's content, with those that ``made`` makes of each file's pixels.

    One image at a time is decoded, and batches go out as soon as they have ``BATCH_BYTES``."""
    keep = [c for c in files.columns if c != last]
    by_path = files.schema[last].dataType.simpleString() == "string"
    out = T.StructType([*(files.schema[c] for c in keep), *T.StructType.fromDDL(schema).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, begin = [], 0, 0
            for i, value in enumerate(batch.column(len(keep))):
                given = value.as_py()
                status, content = ("ok", given) if given is None or not by_path else _content(given)
                held.append(made(*_pixels(status, content)))
                size += len(held[-1][-1] or b"")
                if size > BATCH_BYTES or i + 1 == batch.num_rows:
                    columns = [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(zip(*held), out.fields[len(keep) :])]
                    kept = batch.slice(begin, i + 1 - begin).columns[: len(keep)]
                    yield pa.RecordBatch.from_arrays([*kept, *columns], names=out.names)
                    held, size, begin = [], 0, i + 1

    return files.select(*keep, last).mapInArrow(run, out)


def decoded(files: DataFrame, last: str = "path") -> DataFrame:
    """``files`` with the pixels of each PNG file instead of its ``path`` or ``content``: ``DECODED``.

    ``last`` names a column of paths, which are opened by the tasks whatever their names are, or of contents. ``status`` is
    one of ``STATUSES``; what has no pixels keeps its row. ``data`` is as in Spark's ``image`` rows, with gray alpha kept.
    ``by_alpha``: stored with an alpha channel; one that comes from a palette or a transparent colour is not.
    """

    def made(status: str, pixels: np.ndarray | None, by_alpha: bool) -> tuple:
        return (status, None, None, None, None, None) if pixels is None else (status, *pixels.shape, by_alpha, _turned(pixels).tobytes())

    return _row_by_row(files, last, DECODED, made)


def encoded_files(files: DataFrame, last: str = "path") -> DataFrame:
    """``files`` with ``status``, trim box and ``png``, the cropped file, instead of ``last``; as ``decoded``, in one pass."""

    def made(status: str, pixels: np.ndarray | None, by_alpha: bool) -> tuple:
        if pixels is None:
            return status, None, None, None, None, None
        x0, y0, x1, y1 = trim_box(pixels, by_alpha)
        return status, x0, y0, x1, y1, png.encode(pixels[y0:y1, x0:x1])

    return _row_by_row(files, last, f"status string, {TRIMMED}", made)


def _path_of(origin: Column) -> Column:
    """File path of an origin, a URI: percent-encoded, with a scheme in front."""
    return F.regexp_replace(F.url_decode(F.replace(origin, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def with_path(images: DataFrame) -> DataFrame:
    """Spark ``image`` rows with the ``path`` they were read from."""
    return images.withColumn("path", _path_of(F.col("image.origin")))


def located(encoded: DataFrame, files: DataFrame) -> DataFrame:
    """``encoded`` with the ``source`` and ``rel_path`` of the ``files`` the images came from."""
    at = encoded.withColumn("path", _path_of(F.col("origin")))
    return at.join(files.select("source", "rel_path", "path"), "path").select("source", "rel_path", "encoded")
