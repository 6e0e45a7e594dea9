"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits; two are linked if they differ in at most ``REACH`` = 4.
The bits are taken in three segments (23, 23 and 18, the last filled up with zeros). Of
four differing bits, some two segments together have at most two: so linked
fingerprints differ by at most two bits in one of three pairs of segments. On each
segment the anchors are the words of the perfect binary Golay code of length 23 (a
covering code: every word is within radius 3 of exactly one of 4,096), on a pair of
segments their products, 2**24 in number.

Each fingerprint is copied to every anchor within covering radius plus threshold. A
threshold of two on the pair is split between the two sides: for words two bits
apart there is a word one bit from either, and both lie within radius plus one of
its anchor. So each side goes to the anchors of itself and of its neighbours by one bit,
about ten for each pair of segments, and linked fingerprints meet at one
anchor at least. Fingerprints are compared per anchor, and only enough links are
passed on to hold together what is linked there. Groups of more than ``HOT``
fingerprints at one anchor are compared as pairs of blocks by many tasks.

Components come from large-star and small-star rounds over the links of different
fingerprints; equal fingerprints are one node from the start.

Cases: null and empty texts, and texts of white space, have fingerprint zero and are linked like any
other; rows with a null id get the component of their fingerprint, a null id is
the smallest id only where a component has no other; repeated rows stay; an empty
table gives none; other columns are not read, or pass through untouched in ``kept``.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepview.llm.shared import beside, col, map_batches, saved, scope, unused

WORDS, REACH, SEED = 4, 4, 42
#: Fingerprints at one anchor that one task compares, and the size of a block beyond that.
HOT, BLOCK = 4096, 2048
#: First bit and length of the segments.
SEGMENTS = ((0, 23), (23, 23), (46, 18))

_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """Majority of the bits of the hashes of all word shingles; zero without a word."""
    parts = (text or b"").translate(_LOWER).split()
    if not parts:
        return 0
    whole = b" ".join(parts)
    ends = list(itertools.accumulate(len(x) + 1 for x in parts))
    begins = [0, *ends[: max(0, len(parts) - words)]]
    hashed, view = xxhash.xxh64_intdigest, memoryview(whole)
    last = ends[words - 1 :] or ends[-1:]
    return majority(np.fromiter((hashed(view[a : b - 1], SEED) for a, b in zip(begins, last)), np.uint64, len(last)))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    over = counts * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str, into: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with the fingerprint of each whole text as BIGINT."""
    both, place, n = beside(docs, keep, text)
    schema = T.StructType([*both.schema.fields[:n], T.StructField(into, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).cast(pa.binary())
            got = np.array([fingerprint(x.as_py()) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(got)], names=schema.names)

    return map_batches(both, run, schema)


@functools.cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of every 12-bit head (by linearity, of a whole word), and the error of every syndrome."""
    # Fixed value: a generator polynomial of the binary Golay code of length 23.
    generator = 0b101011100011
    heads = np.arange(1 << 12, dtype=np.uint32) << 11
    rest = heads.copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> np.uint32(bit) & 1, rest ^ np.uint32(generator << (bit - 11)), rest)
    errors = np.zeros(1 << 11, np.uint32)
    for weight in (1, 2, 3):
        for bits in itertools.combinations(range(23), weight):
            word = np.uint32(sum(1 << b for b in bits))
            errors[(word & np.uint32(0x7FF)) ^ rest[word >> np.uint32(11)]] = word
    return rest, errors


def anchor(words: np.ndarray) -> np.ndarray:
    """Number (12 bits) of the one code word within three bits of each 23-bit word."""
    rest, errors = golay()
    syndrome = (words & np.uint32(0x7FF)) ^ rest[words >> np.uint32(11)]
    return (words ^ errors[syndrome]) >> np.uint32(11)


def visits(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys (pair of segments, two anchors) of all places where fingerprints are compared."""
    at, near = [], []
    for first, length in SEGMENTS:
        word = ((prints >> np.uint64(first)) & np.uint64((1 << length) - 1)).astype(np.uint32)
        at.append(anchor(word))
        near.append(np.stack([anchor(word ^ np.uint32(1 << b)) for b in range(length)], axis=1))
    rows, keys = [], []
    for pair, (a, b) in enumerate(((0, 1), (1, 2), (2, 0))):
        here = (np.uint64(pair) << np.uint64(24)) | at[a].astype(np.uint64) << np.uint64(12)
        home = (here | at[b]).reshape(-1, 1)
        there = (np.uint64(pair) << np.uint64(24)) | near[a].astype(np.uint64) << np.uint64(12) | at[b].astype(np.uint64)[:, None]
        all_keys = np.sort(np.concatenate([home, there, here[:, None] | near[b]], axis=1), axis=1)
        new = np.ones(all_keys.shape, bool)
        new[:, 1:] = all_keys[:, 1:] != all_keys[:, :-1]
        row, _ = np.nonzero(new)
        rows.append(row)
        keys.append(all_keys[new])
    return np.concatenate(rows), np.concatenate(keys)


def forest(left: np.ndarray, right: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links within ``left`` (or between it and ``right``) that hold together all that is linked there."""
    both = left if right is None else np.concatenate([left, right])
    other = both if right is None else right
    parent = list(range(len(both)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    a, b = [], []
    shift = 0 if right is None else len(left)
    for i in range(len(left)):
        close = np.flatnonzero(np.bitwise_count(other[i + 1 if right is None else 0 :] ^ left[i]) <= REACH)
        for j in close + (i + 1 if right is None else 0):
            x, y = root(i), root(int(j) + shift)
            if x != y:
                parent[x] = y
                a.append(i)
                b.append(int(j) + shift)
    return both[a], both[b]


def _compared(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """Links within whole groups; rows are sorted by key."""
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([begins, [len(keys)]])) if len(keys) else begins
    two = begins[sizes == 2]
    two = two[np.bitwise_count(values[two] ^ values[two + 1]) <= REACH]
    pairs, over = [(values[two], values[two + 1])], []
    for begin, size in zip(begins[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        some = values[begin : begin + size]
        if size > HOT:
            over.append((int(keys[begin]), some))
        else:
            pairs.append(forest(some))
    return _met(pairs, over)


def _met(pairs: list[tuple[np.ndarray, np.ndarray]], over: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    def joined(arrays: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)

    a, b, m = joined([p[0] for p in pairs]), joined([p[1] for p in pairs]), joined([o[1] for o in over])
    k = np.concatenate([np.zeros(0, np.int64), *(np.full(len(o[1]), o[0], np.int64) for o in over)])
    link = np.arange(len(a) + len(m)) < len(a)
    key = pa.array(np.concatenate([np.zeros(len(a), np.int64), k]), mask=link)
    other = pa.array(np.concatenate([b, np.zeros(len(m), np.int64)]), mask=~link)
    return pa.RecordBatch.from_arrays([key, pa.array(np.concatenate([a, m])), other], names=["key", "a", "b"])


def links(prints: DataFrame) -> DataFrame:
    """``a``, ``b``: fingerprints (BIGINT) whose links connect all that are within reach; one column of distinct ones in."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                values = batch.column(0).slice(k, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
                row, key = visits(values)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(values[row].view(np.int64))], names=["key", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by key. Links of a group, or its members (key, member, null) if it is too large for one task."""
        keys, values, large = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            values = np.concatenate([values, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            begin = 0 if large is None else int(np.searchsorted(keys, large, side="right"))
            open_from = int(np.searchsorted(keys, keys[-1], side="left")) if len(keys) else 0
            if begin:
                yield _met([], [(large, values[:begin])])
            if begin < len(keys):
                large = None
                yield _compared(keys[begin:open_from], values[begin:open_from])
                if len(keys) - open_from > HOT:
                    large = keys[-1]
                    yield _met([], [(large, values[open_from:])])
                    open_from = len(keys)
            keys, values = keys[max(begin, open_from) :], values[max(begin, open_from) :]
        yield _compared(keys, values)

    visiting = prints.mapInArrow(spread, "key bigint, fp bigint")
    dealt = visiting.repartition("key").sortWithinPartitions("key", "fp")
    met = saved(dealt.mapInArrow(meet, "key bigint, a bigint, b bigint"), "met")
    few = met.where(F.col("b").isNotNull()).select("a", "b")
    return few.unionByName(_large(met.where(F.col("b").isNull()).select("key", F.col("a").alias("fp")))).distinct()


def _large(members: DataFrame) -> DataFrame:
    """Links within large groups: members are dealt into blocks by hash, each pair of blocks is a group of its own."""
    spark = members.sparkSession
    if members.isEmpty():
        return spark.createDataFrame([], "a bigint, b bigint")
    counts = saved(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "counts")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = members.join(counts, "key").select("key", "fp", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("block"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda i: F.struct(F.least(i, F.col("block")).alias("i"), F.greatest(i, F.col("block")).alias("j")),
    )
    dealt = placed.select("key", "fp", "block", F.inline(pairs))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        value = pdf["fp"].to_numpy().view(np.uint64)
        side = pdf["block"].to_numpy()
        a, b = forest(value) if i == j else forest(value[side == i], value[side == j])
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.groupBy("key", "i", "j").applyInPandas(compare, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node it is connected with) of all nodes of ``edges`` (``a``, ``b``)."""
    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _stars(edges):
        large = _star(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), True)
        edges = saved(_star(large, False).distinct(), "edges")
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one node only, and that on none: a further round would change nothing."""
    ends = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("v")))
    return ends.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low <> high").count() == 0


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: neighbours above ``u`` are hung on the least neighbour. Small star: those below."""
    # Written first, so that both sides of the join are plain shuffles and a hub's rows can be split.
    least = saved(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    joined = edges.join(least, "u")
    if large:
        return joined.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    hung = joined.where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
    return hung.unionByName(least.where("u <> m").select("u", F.col("m").alias("v"))).where("u <> v")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (``key``, ``fp``) and fingerprints (``fp``, ``root``, ``first``: least key of the component)."""
    plain = docs.select(col(key).alias("key"), col(text).alias("text"))
    prints = saved(fingerprints(plain, "text", "fp", ["key"]), "prints")
    with scope(docs.sparkSession):
        distinct = saved(prints.groupBy("fp").agg(F.min("key").alias("first")), "distinct")
        roots = components(links(distinct.select("fp")))
        rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left")
        rooted = saved(rooted.select("fp", F.coalesce("root", "fp").alias("root"), "first"), "rooted")
        least = saved(rooted.groupBy("root").agg(F.min("first").alias("first")), "least")
        return prints, saved(rooted.drop("first").join(least, "root"), "groups", outer=True)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (hex) and ``component_id`` of every row."""
    prints, grouped = groups(docs, key, text)
    return prints.join(grouped, "fp").select(
        F.col("key").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first").alias("component_id"),
    )


def kept(docs: DataFrame, key: str = "doc_id", text: str = "text", grouped_by: Callable = groups, printed_by: Callable = fingerprints) -> DataFrame:
    """``docs`` with one row of each component: a row with the least key, of equal keys any one."""
    prints, grouped = grouped_by(docs, key, text)
    with_root = prints.join(grouped, "fp").where(F.col("key").eqNullSafe(F.col("first")))
    chosen = saved(with_root.groupBy("root").agg(F.first("key").alias("key"), F.min("fp").alias("fp")), "chosen")
    often = saved(prints.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
    k, by, n, mark = unused(docs, "_key", "_by", "_n", "_fp")
    picked = chosen.join(often, chosen["key"].eqNullSafe(often["key"]), "left")
    picked = saved(picked.select(chosen["key"].alias(k), F.col("fp").alias(by), F.coalesce("n", F.lit(1)).alias(n)), "picked")
    mine = [col(c) for c in docs.columns]

    def found(which: DataFrame) -> DataFrame:
        return docs.join(which, col(key).eqNullSafe(F.col(k)))

    once = found(picked.where(F.col(n) == 1)).select(*mine)
    many = picked.where(F.col(n) > 1)
    if many.isEmpty():
        return once
    # Several rows have this key: the fingerprint tells which are meant, and of equal ones any may stay.
    printed = printed_by(found(many), text, mark, [*docs.columns, by])
    return once.unionByName(printed.where(F.col(mark) == F.col(by)).dropDuplicates([by]).select(*mine))
