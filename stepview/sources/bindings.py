"""The given tables seen as the relations that the operators work on.

Each function takes the session and a directory of Parquet tables. Whole tables
are read; column pruning and filters reach the scans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepview.operators import png
from stepview.operators.ranking import rank, spread

# The channels in index order, those that hold data, and the
# shape of an epoch in one embedding vector.
CHANNELS = ["click", "error", "purchase", "signup", "view"]
DATA_CHANNELS = ["click", "purchase", "view"]
EPOCH_CHANNELS = 4
EPOCH_SAMPLES = 16

# How the pieces of ``signal`` and ``epochs`` are identified.
RECORDING = ["participant"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("string")


def site(number: str) -> Column:
    return F.concat(F.lit("site"), text(F.col(number) % 4))


def person(number: str) -> Column:
    return F.concat(F.lit("P"), text(number))


def step_files(spark: SparkSession, sf: str) -> DataFrame:
    # Distinct before the texts are put together: the same rows, cheaper to compare.
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.lower("l_returnflag").alias("flag"))
    return spread(lines, *lines.columns).distinct().select(
        site("l_orderkey").alias("source"),
        person("l_orderkey").alias("participant"),
        F.col("l_linenumber").cast("bigint").alias("step_num"),
        F.concat(text("l_linenumber"), F.lit("_"), "flag").alias("step_dir"),
    )


def step_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """``step_files`` as paths, to be parsed back."""
    name = F.concat("participant", F.lit(".set"))
    return step_files(spark, sf).select(
        "source", F.concat("step_dir", F.lit("/"), name).alias("rel_path"), F.lit(False).alias("is_dir")
    )


def step_requests(spark: SparkSession, sf: str) -> DataFrame:
    """One request per order; every tenth step is no number, every thirteenth empty."""
    key = F.col("o_orderkey")
    number = text(key % 9)
    return table(spark, sf, "orders").select(
        key.alias("request"),
        site("o_orderkey").alias("source"),
        person("o_orderkey").alias("participant"),
        F.when(key % 10 == 0, F.concat(F.lit("x"), number))
        .when(key % 13 == 0, "")
        .when(key % 3 == 0, F.concat(F.lit(" +"), number))
        .otherwise(number)
        .alias("step_text"),
        F.when(key % 2 == 0, "onionskin").alias("overlay_text"),
    )


def qc_files(spark: SparkSession, sf: str) -> DataFrame:
    kind, line = F.col("l_partkey") % 3, F.col("l_linenumber")
    # What a path is made of, so that distinct rows here are distinct paths.
    pieces = table(spark, sf, "lineitem").select(
        "l_suppkey",
        F.lower("l_returnflag").alias("flag"),
        F.when(F.col("l_orderkey") % 97 != 0, line).alias("set_no"),
        kind.alias("kind"),
        F.when(kind == 1, F.col("l_quantity").cast("int")).alias("low"),
        F.when(kind == 2, line).alias("hist"),
    )
    who, low = person("l_suppkey"), F.col("low")
    name = (
        F.when(F.col("kind") == 0, F.concat(who, F.lit("-badChan-scalp.png")))
        .when(F.col("kind") == 1, F.concat(who, F.lit("-chs"), text(low), F.lit("-"), text(low + 31), F.lit(".png")))
        .otherwise(F.concat(who, F.lit("-hist"), text("hist"), F.lit(".png")))
    )
    folder = F.coalesce(F.concat(F.lit("set"), text("set_no")), F.lit("misc"))
    rel_path = F.concat(F.lit("peek_"), "flag", F.lit("/"), folder, F.lit("/"), name)
    return pieces.distinct().select(site("l_suppkey").alias("source"), rel_path.alias("rel_path"))


def qc_participants(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        site("s_suppkey").alias("source"), person("s_suppkey").alias("participant")
    )


def qc_requests(spark: SparkSession, sf: str) -> DataFrame:
    """One drill-down request per order, with and without set and bit."""
    key, number = F.col("o_orderkey"), F.col("o_custkey") % 100
    who = F.concat(F.lit("P"), text(number))
    root = F.when(key % 11 == 0, "").when(key % 7 == 0, "peek_x").otherwise(
        F.concat(F.lit("peek_"), F.element_at(F.array(F.lit("a"), F.lit("n"), F.lit("r")), (key % 3 + 1).cast("int")))
    )
    return table(spark, sf, "orders").select(
        key.alias("request"),
        F.concat(F.lit("site"), text(number % 4)).alias("source"),
        who.alias("participant"),
        root.alias("root"),
        F.when(key % 4 > 0, F.concat(F.lit("set"), text(key % 9))).alias("set_name"),
        F.when(key % 5 == 1, who)
        .when(key % 5 == 2, F.concat(who, F.lit("-hist"), text(key % 9), F.lit(".png")))
        .when(key % 5 == 3, F.concat(who, F.lit("-none.png")))
        .alias("bit"),
    )


def log_files(spark: SparkSession, sf: str) -> DataFrame:
    """``content`` is only read where it is used: the scan is pruned."""
    docs = table(spark, sf, "documents")
    name = F.concat("source", F.lit("-"), text("doc_id"), F.lit(".log"))
    return docs.select(
        name.alias("name"),
        F.concat(F.lit("logs/"), F.col("lang"), F.lit("/"), name).alias("rel_path"),
        F.col("text").alias("content"),
        site("doc_id").alias("site"),
        "doc_id",
        F.col("source").alias("owner"),
    )


def log_participants(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("source").alias("participant")).distinct()


def caches(spark: SparkSession, sf: str) -> DataFrame:
    shipped, status = F.col("l_shipdate"), F.col("l_linestatus")
    copies = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.min(F.when(status == "O", shipped)).alias("raw_mtime"),
        F.min(F.when(status == "F", shipped)).alias("epo_mtime"),
    )
    orders = table(spark, sf, "orders")
    return orders.join(copies, orders.o_orderkey == copies.l_orderkey, "left").select(
        F.col("o_orderkey").alias("rec"), F.col("o_orderdate").alias("base_mtime"), "raw_mtime", "epo_mtime"
    )


def cache_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Recordings (orders) and their hidden copies (line items) as one listing of files."""
    base = table(spark, sf, "orders").select(
        site("o_orderkey").alias("source"),
        F.concat(F.lit("1_load/"), person("o_orderkey"), F.lit(".set")).alias("rel_path"),
        F.col("o_orderdate").alias("mtime"),
    )
    ending = F.when(F.col("l_linestatus") == "O", "-raw.fif").otherwise("-epo.fif")
    copies = (
        table(spark, sf, "lineitem")
        .select(
            site("l_orderkey").alias("source"),
            F.concat(F.lit("1_load/."), person("l_orderkey"), ending).alias("rel_path"),
            F.col("l_shipdate").alias("mtime"),
        )
        .groupBy("source", "rel_path")
        .agg(F.min("mtime").alias("mtime"))
    )
    return base.unionByName(copies).select(
        "*", F.lit(False).alias("is_dir"), F.substring_index("rel_path", "/", -1).alias("name")
    )


def signal_long(spark: SparkSession, sf: str) -> DataFrame:
    """Events as samples: user, ten-day period and type are participant, step and channel."""
    samples = table(spark, sf, "events").select(
        F.col("user_id").alias("participant"),
        (F.floor((F.dayofmonth("ts") - 1) / 10) + 1).cast("bigint").alias("step_num"),
        F.col("event_type").alias("ch_name"),
        "ts",
        "event_id",
        "value",
    )
    numbered = rank(samples, ["participant", "step_num", "ch_name"], ["ts", "event_id"], "_pos")
    return numbered.select(
        "participant",
        "step_num",
        "ch_name",
        (F.array_position(F.array(*[F.lit(c) for c in CHANNELS]), F.col("ch_name")).cast("int") - 1).alias("ch_idx"),
        F.when(F.col("ch_name").isin(*DATA_CHANNELS), "data").otherwise("misc").alias("ch_type"),
        (F.col("_pos") - 1).alias("sample_idx"),
        "value",
    )


def epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector is one epoch: a row per channel with its samples."""
    vectors = table(spark, sf, "embeddings").select(
        F.col("label").alias("participant"), (F.col("vec_id") % 3 + 1).alias("step_num"), "vec_id", "embedding"
    )
    numbered = rank(vectors, ["participant", "step_num"], ["vec_id"], "_pos")
    channels = F.array(
        *[
            F.struct(F.lit(c).alias("ch_idx"), F.slice("embedding", c * EPOCH_SAMPLES + 1, EPOCH_SAMPLES).alias("samples"))
            for c in range(EPOCH_CHANNELS)
        ]
    )
    return numbered.select(
        "participant", "step_num", (F.col("_pos") - 1).alias("epoch_idx"), F.explode(channels).alias("_ch")
    ).select("participant", "step_num", "epoch_idx", "_ch.*")


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    lit = (F.col("v") > 0.25) & (F.col("i") > 0)
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).select(
        F.col("vec_id").alias("image"),
        (F.col("i") % 8).alias("x"),
        F.floor(F.col("i") / 8).cast("int").alias("y"),
        lit.cast("int").alias("v"),
    )


def images(spark: SparkSession, sf: str) -> DataFrame:
    """The same pictures as whole 8 x 8 gray images, one byte per pixel."""
    byte = F.transform("embedding", lambda v, i: F.when((v > 0.25) & (i > 0), "FF").otherwise("00"))
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("key"),
        F.lit(8).alias("height"),
        F.lit(8).alias("width"),
        F.lit(1).alias("n_channels"),
        F.unhex(F.array_join(byte, "")).alias("data"),
    )


def listing(spark: SparkSession, sf: str, later: bool = False) -> DataFrame:
    """Recordings (orders), logs and images (line items) as a listing; later, some have gone, come or changed."""
    key = F.col("o_orderkey")
    recordings = table(spark, sf, "orders").select(
        site("o_custkey").alias("source"),
        F.concat(text(key % 7), F.lit("_s/"), person("o_custkey"), F.lit("-"), text(key), F.lit(".set")).alias("rel_path"),
        key.alias("key"),
    )
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    name = F.concat(person("l_suppkey"), F.lit("-"), text("l_orderkey"), F.lit("."), text("l_linenumber"))
    folder = F.when(line % 2 == 0, F.lit("logs/")).otherwise(F.lit("quality_control/R/set1/"))
    files = table(spark, sf, "lineitem").select(site("l_suppkey").alias("source"), F.concat(folder, name).alias("rel_path"), line.alias("key"))
    every = recordings.unionByName(files.distinct())
    state = F.when(F.col("key") % 97 == 0, F.lit(1)).otherwise(0) if later else F.lit(0)
    kept = every.where(F.col("key") % 101 != 0) if later else every.where(F.col("key") % 103 != 0)
    return kept.select("source", "rel_path", F.lit(False).alias("is_dir"), F.timestamp_seconds(state).alias("mtime"), F.col("key").alias("size"))


def png_files(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector as a PNG file: gray with alpha for even ids, colours with alpha for others, every line filtered its own way."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image"), F.col("embedding").cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = []
            for image, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = row.values.to_numpy()
                shape = (4, 8, 2) if image % 2 == 0 else (4, 4, 4)
                pixels = (np.floor(np.abs(v) * 1000) % 256).astype(np.uint8).reshape(shape)
                pixels[:, :, -1] = np.where(v.reshape(shape)[:, :, -1] > 0.25, 255, 0)
                files.append(png.encode(pixels, (np.arange(4) + image) % 5))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], names=["image", "content"])

    return vectors.mapInArrow(run, "image bigint, content binary")


def arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """Directories to be registered, in order of arrival."""
    return table(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(
        F.min("c_custkey").alias("arrival")
    ).select(
        F.col("c_mktsegment").alias("name"),
        F.concat(F.lit("/data/"), text("c_nationkey")).alias("directory"),
        "arrival",
    )
