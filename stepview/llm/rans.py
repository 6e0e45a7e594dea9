"""Token ids in files, compressed by a static range asymmetric numeral system.

One table of symbol frequencies, counted over all ids, is shared by all blocks. A
block holds whole documents in ascending order of their key; its ids are dealt out
to ``LANES`` interleaved coders, so that one step of numpy arithmetic codes as many
ids. Every ``EVERY`` steps the states of the lanes and the place in the stream are
kept as a checkpoint: decoding can begin at any of them, in parallel. A CRC-32 of
the block's ids is checked after decoding.

A file is a folder ``part=N`` of rows, one for each block: documents and their
lengths, stream, checkpoints, checksum. Parts hold ascending ranges of keys, blocks
ascend within a part, documents within a block, so reading in (part, block) order
gives back the order of the keys. The table lies beside them in ``frequencies``.

Cases: documents with a null or empty text have the end id only; null keys come
first; rows with equal keys are ordered by their ids and stay rows of their own; an
empty table makes a table of frequencies without rows and no blocks; other columns are
not read. A document longer than a block is a block of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepview.llm import words
from stepview.llm.bpe import TOKENIZER
from stepview.llm.shared import col, new_path, saved, scope

#: Interleaved coders; steps between checkpoints; ids in a block, about.
LANES, EVERY, BLOCK = 1024, 64, 1 << 18
#: Bits of the frequency table's total; the least state; bits of a word of the stream.
BITS, LOW, WORD = 20, np.uint64(1 << 31), np.uint64(32)
#: Text bytes in a part, and the most parts there are (beyond, parts grow).
PART, MOST = 32 << 20, 1 << 14

BLOCKS = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("block", T.IntegerType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("lengths", T.ArrayType(T.IntegerType())),
        T.StructField("n_ids", T.LongType()),
        T.StructField("stream", T.BinaryType()),
        T.StructField("states", T.BinaryType()),
        T.StructField("places", T.ArrayType(T.IntegerType())),
        T.StructField("crc32", T.LongType()),
    ]
)


class Table:
    """Frequencies scaled to a total of 2**BITS, at least one for each symbol that occurs."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray):
        self.frequency, self.begin = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.symbol = np.zeros(0, np.uint32)
        if len(symbols) == 0:
            return
        if len(symbols) > 1 << (BITS - 1):
            raise ValueError("too many symbols for the table")
        order = np.argsort(symbols)
        symbols, counts = symbols[order], counts[order].astype(np.float64)
        scaled = np.maximum(1, np.floor(counts * ((1 << BITS) / counts.sum()))).astype(np.int64)
        left = (1 << BITS) - int(scaled.sum())
        while left:  # what rounding left over, or took too much, goes to the most frequent
            top = np.argsort(-scaled, kind="stable")[: max(1, abs(left))]
            step = np.where(scaled[top] > 1, 1, 0) if left < 0 else np.full(len(top), max(1, left // len(top)))
            scaled[top] += step if left > 0 else -step
            left = (1 << BITS) - int(scaled.sum())
        size = int(symbols[-1]) + 1
        self.frequency, self.begin = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.frequency[symbols] = scaled
        self.begin[symbols] = np.concatenate([[0], np.cumsum(scaled)[:-1]])
        self.symbol = np.repeat(symbols, scaled).astype(np.uint32)


def encode_block(ids: np.ndarray, table: Table) -> tuple[bytes, bytes, list[int]]:
    """Stream of 32-bit words, states at the checkpoints, and where in the stream each begins to read.

    Id ``i`` belongs to step ``i // LANES`` and lane ``i % LANES``. Coding runs from the
    last step to the first, so that decoding runs forward.
    """
    steps = -(-len(ids) // LANES)
    state = np.full(LANES, LOW, np.uint64)
    chunks: list[np.ndarray] = []
    states: list[np.ndarray] = []
    sizes: list[int] = []
    bits, limit = np.uint64(BITS), np.uint64((1 << 63 >> BITS))
    for step in range(steps - 1, -1, -1):
        now = ids[step * LANES : (step + 1) * LANES]
        x, f = state[: len(now)], table.frequency[now]
        full = x >= f * limit
        out = x[full]
        chunks.append((out & np.uint64(0xFFFFFFFF)).astype("<u4"))
        x[full] = out >> WORD
        whole = x // f
        x[:] = (whole << bits) + (x - whole * f) + table.begin[now]
        sizes.append(len(out))
        if step % EVERY == 0:
            states.append(state.copy())
    places = np.concatenate([[0], np.cumsum(sizes[::-1])])[:-1:EVERY] if steps else np.zeros(0, np.int64)
    stream = b"".join(c.tobytes() for c in reversed(chunks))
    return stream, b"".join(s.astype("<u8").tobytes() for s in reversed(states)), places.tolist()


def decode_steps(stream: bytes, states: bytes, places: list[int], n: int, table: Table, checkpoint: int, until: int | None = None) -> np.ndarray:
    """Ids from a checkpoint up to another one, or to the end of the block of ``n`` ids."""
    state = np.frombuffer(states, "<u8").reshape(-1, LANES)[checkpoint].copy()
    data, at = np.frombuffer(stream, "<u4"), places[checkpoint]
    first, last = checkpoint * EVERY * LANES, n if until is None else min(n, until * EVERY * LANES)
    out = np.empty(last - first, np.uint32)
    bits, mask = np.uint64(BITS), np.uint64((1 << BITS) - 1)
    for begin in range(0, len(out), LANES):
        k = min(LANES, len(out) - begin)
        x = state[:k]
        slot = x & mask
        now = table.symbol[slot]
        out[begin : begin + k] = now
        x[:] = table.frequency[now] * (x >> bits) + slot - table.begin[now]
        low = x < LOW
        need = int(low.sum())
        x[low] = (x[low] << WORD) | data[at : at + need]
        at += need
    return out


def decode_block(stream: bytes, states: bytes, places: list[int], n: int, table: Table, crc: int) -> np.ndarray:
    """All ids of a block, checked."""
    ids = decode_steps(stream, states, places, n, table, 0) if n else np.zeros(0, np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("checksum of a block differs")
    return ids


def parts(docs: DataFrame, key: str, text: str, part: int = PART) -> list[int]:
    """Keys at which a new part begins, so that parts hold about ``part`` bytes of text each."""
    whole = docs.agg(F.sum(F.octet_length(col(text))).alias("b")).first()["b"] or 0
    n = min(int(whole // part) + 1, MOST)
    if n == 1:
        return []
    at = F.percentile_approx(col(key), [i / n for i in range(1, n)], 50 * n).alias("at")
    return sorted(set(docs.agg(at).first()["at"] or []))


def tokenized(docs: DataFrame, key: str, text: str, end: int | None, path: str, begins: list[int]) -> DataFrame:
    """Number of the part, key and ids (little-endian, 16 or 32 bits) of each document."""
    kind = width(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = words.library_words(path)
        last = b"" if end is None else np.array([end], "<u4").tobytes()
        for batch in batches:
            keys = batch.column(0).to_pandas()
            at = np.searchsorted(np.array(begins, np.int64), keys.fillna(np.iinfo(np.int64).min).to_numpy(np.int64), side="right")
            for k in range(0, batch.num_rows, 256):
                texts = batch.column(1).slice(k, 256).cast(pa.binary())
                ids = [np.frombuffer(table.ids(x.as_py()) + last, "<u4").astype(kind).tobytes() for x in texts]
                yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 256], pa.int32()), batch.column(0).slice(k, 256), pa.array(ids, pa.binary())], names=["part", "doc_id", "ids"])

    return docs.select(col(key).cast("bigint").alias("doc_id"), col(text).alias("text")).mapInArrow(run, "part int, doc_id bigint, ids binary")


def width(path: str) -> str:
    return "<u2" if words.load(path).get_vocab_size() <= 1 << 16 else "<u4"


def frequencies(tokens: DataFrame, kind: str) -> DataFrame:
    """``symbol`` and ``n`` over all ids; each task sends at most one row per symbol."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0):
                more = np.bincount(np.frombuffer(x.as_buffer() or b"", kind))
                if len(more) > len(total):
                    total, more = more, total
                total[: len(more)] += more
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["symbol", "n"])

    return tokens.select("ids").mapInArrow(count, "symbol bigint, n bigint").groupBy("symbol").agg(F.sum("n").alias("n"))


def read_table(spark: SparkSession, folder: str) -> Table:
    """The shared table: at most one row per symbol of the vocabulary."""
    rows = spark.read.schema("symbol bigint, n bigint").parquet(f"{folder}/frequencies").toPandas()
    return Table(rows["symbol"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))


def write(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", end: int | None = 1, path: str = TOKENIZER) -> None:
    """Encode ``docs`` with the tokenizers library, close each with ``end``, and write the files."""
    begins = parts(docs, key, text)
    with scope(docs.sparkSession):
        tokens = saved(tokenized(docs, key, text, end, path, begins), "tokens")
        _write(tokens, folder, width(path), len(begins) + 1)


def _write(tokens: DataFrame, folder: str, kind: str, parts: int) -> None:
    """Table of frequencies, then blocks."""
    spark = tokens.sparkSession
    frequencies(tokens, kind).write.parquet(f"{folder}/frequencies")
    table = read_table(spark, folder)

    def block(part: int, number: int, rows: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(r[1] for r in rows), kind).astype(np.uint32)
        stream, states, places = encode_block(ids, table)
        size = np.dtype(kind).itemsize
        row = [part, number, [r[0] for r in rows], [len(r[1]) // size for r in rows], len(ids), stream, states, places, zlib.crc32(ids.astype("<u4").tobytes())]
        return pa.RecordBatch.from_pylist([dict(zip(BLOCKS.names, row, strict=True))], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.library_words.cache_clear()  # no more words in this stage, but their table is in the worker
        part, number, rows, held = None, 0, [], 0
        for p, k, ids in (r for batch in batches for r in zip(*batch.columns, strict=True)):
            p, k, ids = p.as_py(), k.as_py(), ids.as_py()
            if rows and (p != part or held + len(ids) > BLOCK * np.dtype(kind).itemsize):
                yield block(part, number, rows)
                number, rows, held = number + 1, [], 0
            if p != part:
                part, number = p, 0
            rows.append((k, ids))
            held += len(ids)
        if rows:
            yield block(part, number, rows)

    dealt = tokens.repartitionById(parts, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")
    dealt.mapInArrow(run, BLOCKS).write.partitionBy("part").parquet(f"{folder}/blocks")


_ARROW = pa.schema(
    [
        ("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("n_ids", pa.int64()),
        ("stream", pa.binary()), ("states", pa.binary()), ("places", pa.list_(pa.int32())), ("crc32", pa.int64()),
    ]
)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the files: ``part``, ``block``, ``at`` (place in the block), ``doc_id``, ``ids`` (ARRAY<INT>)."""
    table = read_table(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = {n: batch.column(i)[row].as_py() for i, n in enumerate(batch.schema.names)}
                ids = decode_block(r["stream"], r["states"], r["places"], r["n_ids"], table, r["crc32"])
                ends = np.concatenate([[0], np.cumsum(r["lengths"])]).astype(np.int32)
                n = len(r["doc_ids"])
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, r["part"], np.int32)), pa.array(np.full(n, r["block"], np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(r["doc_ids"], pa.int64()), lists],
                    names=["part", "block", "at", "doc_id", "ids"],
                )

    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    return blocks.select(*BLOCKS.names).mapInArrow(run, "part int, block int, at int, doc_id bigint, ids array<int>")


def starts(spark: SparkSession, folder: str) -> DataFrame:
    """``part``, ``block``, ``start``: ids of all blocks before, from the blocks' own counts.

    Sums over blocks within a part, and over the totals of the parts, of which there is one
    for each ``PART`` bytes of text.
    """
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").select("part", "block", "n_ids")
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    return blocks.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(totals, "part").select("part", "block", (F.col("ahead") + F.col("inside")).alias("start"))


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: where it starts, its number of ids and their CRC-32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc, sizes = [], []
            for ids in batch.column(4):
                values = ids.values.to_numpy()
                sizes.append(len(values))
                crc.append(zlib.crc32(values.astype("<u4").tobytes()))
            columns = [*batch.columns[:4], pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "block", "at", "doc_id", "n_tokens", "ids_crc32"])

    each = read(spark, folder).mapInArrow(run, "part int, block int, at int, doc_id bigint, n_tokens bigint, ids_crc32 bigint")
    before = Window.partitionBy("part", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    inside = each.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return inside.join(starts(spark, folder), ["part", "block"]).select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame) -> DataFrame:
    """Write ``docs`` to files in the shared folder and return what reading them back gives."""
    spark = docs.sparkSession
    folder = new_path(spark, "rans")
    write(docs, folder)
    return digests(spark, folder)


__all__ = ["Table", "decode_block", "decode_steps", "digests", "encode_block", "read", "round_trip", "write"]
