"""Periodic stretches of words, found with string synchronising sets.

A run is a stretch of words with smallest period ``q`` and at least ``max(LEAST, 3 * q)`` words that no
neighbouring word extends. Runs are found without comparing a text with itself at every distance:

1. Periods below ``DIRECT`` are read off directly, by comparing each word with the word ``q`` further on. They
   are the small periods that the sets below leave out.
2. At each scale ``t`` (16, 32, 64 ...) a synchronising set is taken: position ``i`` is in it if, among the
   hashes of the stretches of ``t`` words that begin in ``[i, i + t]``, the least belongs to the one at ``i`` or at
   ``i + t``. Stretches with a period of ``t / 3`` or less have no hash; they lie in runs found before. Whether ``i`` is in
   the set depends on the ``2 t`` words from ``i`` on and on nothing else, so the same words are chosen alike wherever
   they stand.
3. Positions of the set with equal contexts of ``2 t`` words propose the distance between them as a period. A
   run with period ``p`` from ``3 t / 2`` to ``3 t`` holds a chosen position in its first ``2 p - 2 t`` words: without one, every
   stretch of ``3 t - 1`` words there had a period of ``t / 3`` or less, and so would the ``2 p`` words that they make up. The
   position ``p`` further on has the same context. Equal contexts are over ``t / 3`` apart, so it is at most the ninth to come.
4. Each proposal is extended to both sides by comparing words. Stretches found with a multiple of their period have
   the same ends and are dropped.

All of this is exact: hashes select and propose, words decide.

Cases: a null or empty text has no words and no runs; a null key plants nothing; repeated rows and ties stay rows of
their own; an empty table gives an empty table; other columns pass through ``collapse`` unread (a column with the
name of the text is replaced by what is kept) and are not part of ``digests``. A very long text is one row, handled by
one task in memory in proportion to its words.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stepview.llm.shared import beside, col, map_batches

#: Least words of a run; periods below ``DIRECT`` are compared directly; smallest scale.
LEAST, DIRECT, SCALE = 24, 24, 16
#: Texts in a batch that goes back to Spark.
BATCH = 512

RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False)
_NUMBERS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")
_HASHES = ("runs_sha256", "collapsed_sha256")
DIGESTS = T.StructType([T.StructField(c, T.LongType()) for c in _NUMBERS] + [T.StructField(c, T.StringType()) for c in _HASHES])
_NONE = np.iinfo(np.uint64).max


def _mixed(x: np.ndarray) -> np.ndarray:
    """Each number through a one-to-one function that scatters neighbours."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _doubled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of stretches of twice ``size`` words from those of ``size`` words."""
    return _mixed(hashes[:-size] * np.uint64(0xD6E8FEB86659FD93) + hashes[size:])


def _stretches(words: np.ndarray, period: int, least: int) -> np.ndarray:
    """Starts and ends of all stretches of ``least`` words or more that have ``period``, made as long as they can be."""
    odd = np.flatnonzero(words[period:] != words[:-period])
    edges = np.concatenate([[-1], odd, [len(words) - period]])
    long = np.flatnonzero(np.diff(edges) - 1 >= max(1, least - period))
    return np.stack([edges[long] + 1, edges[long + 1] + period], axis=1)


def _same(one: np.ndarray, two: np.ndarray) -> int:
    """How many words two arrays have in common from their beginnings."""
    size, most, at = 64, min(len(one), len(two)), 0
    while at < most:
        stop = min(most, at + size)
        odd = np.flatnonzero(one[at:stop] != two[at:stop])
        if len(odd):
            return at + int(odd[0])
        at, size = stop, size * 2
    return most


def synchronising(hashes: np.ndarray, scale: int, periodic: np.ndarray) -> np.ndarray:
    """Chosen positions; ``hashes`` are of ``scale`` words, ``periodic`` holds starts and ends of highly periodic regions."""
    names = _mixed(hashes ^ np.uint64(scale))
    for start, end in periodic.tolist():
        names[start : max(start, end - scale + 1)] = _NONE
    least = names
    size = 1
    while size < scale:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[:-1], least[1:])
    here, there = names[: len(least)], names[scale : scale + len(least)]
    return np.flatnonzero(((least == here) | (least == there)) & (least != _NONE))


def proposals(chosen: np.ndarray, contexts: np.ndarray, scale: int) -> np.ndarray:
    """(distance, position) of equal contexts that are as far apart as periods of this scale."""
    order = np.argsort(contexts, kind="stable")
    at, name = chosen[order], contexts[order]
    found = []
    for k in range(1, min(10, len(at))):
        apart = at[k:] - at[:-k]
        take = (name[k:] == name[:-k]) & (2 * apart >= 3 * scale) & (apart < 3 * scale)
        found.append(np.stack([apart[take], at[:-k][take]], axis=1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def runs(words: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) by start, then period, of all runs in an array of word numbers."""
    n = len(words)
    none = np.zeros((0, 3), np.int64)
    if n < LEAST:
        return none
    hashes, size = _mixed(words.astype(np.uint64)), 1
    while size < SCALE:
        hashes, size = _doubled(hashes, size), size * 2
    # Two thirds of a run's words, so 16 or more, are the words one period further on.
    ordered = np.sort(hashes)
    if not (ordered[1:] == ordered[:-1]).any():
        return none
    found = [none]
    regions = {}  # period -> starts and ends of stretches that may lie within a highly periodic region
    for q in range(1, min(DIRECT, n // 3 + 1)):
        least = max(LEAST, 3 * q)
        stretches = _stretches(words, q, min(least, SCALE) if 3 * q <= SCALE else least)
        regions[q] = stretches
        stretches = stretches[stretches[:, 1] - stretches[:, 0] >= least]
        found.append(np.column_stack([stretches[:, 0], stretches[:, 1] - stretches[:, 0], np.full(len(stretches), q)]))
    scale = SCALE
    while 9 * scale <= 2 * n:
        near = [s[s[:, 1] - s[:, 0] >= scale] for q, s in regions.items() if 3 * q <= scale]
        chosen = synchronising(hashes, scale, np.concatenate([np.zeros((0, 2), np.int64), *near]))
        hashes = _doubled(hashes, scale)
        distance, end = 0, 0
        for d, at in proposals(chosen, hashes[chosen], scale).tolist():
            if d == distance and at < end - d:
                continue
            back = _same(words[:at][::-1], words[: at + d][::-1])
            ahead = _same(words[at:], words[at + d :])
            distance, start, end = d, at - back, at + d + ahead
            regions[d] = np.concatenate([regions.get(d, np.zeros((0, 2), np.int64)), [[start, end]]])
            if end - start >= max(LEAST, 3 * d):
                found.append(np.array([[start, end - start, d]]))
        scale *= 2
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    first = np.ones(len(every), bool)
    first[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
    every = every[first]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def kept(n: int, found: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay: of each run its first period, unless another run drops it."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, found[:, 0] + found[:, 2], 1)
    np.add.at(edges, found[:, 0] + found[:, 1], -1)
    return np.cumsum(edges[:n]) == 0


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers, equal words alike."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def planted(words: list[bytes], key: int | None) -> list[bytes]:
    """For a tenth of all keys, the words from some place on replaced by repetitions of the first of them."""
    h = zlib.crc32(str(key).encode())
    if key is None or not words or h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    copies = -(-(n - a) // p)
    return words[:a] + (words[a : a + p] * copies)[: n - a]


def _ahead(one: tuple[int, ...], two: tuple[int, ...]) -> int:
    """Of two runs, which has the greater length for its period; of equals the one that begins first."""
    return one[1] * two[2] - two[1] * one[2] or two[0] - one[0] or two[2] - one[2]


def collapse(docs: DataFrame, text: str = "text", into: str = "runs") -> DataFrame:
    """``docs`` with what is kept of each text, single-spaced, in place of the text, and its runs."""
    kept_columns = [c for c in docs.columns if c.lower() not in (into.lower(), text.lower())]
    both, place, n = beside(docs, kept_columns, text)
    schema = T.StructType([*both.schema.fields[:n], T.StructField(text, T.StringType(), False), T.StructField(into, RUNS, False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BATCH):
                part = batch.slice(begin, BATCH)
                texts, sizes, rows = [], [0], []
                for value in part.column(place).cast(pa.binary()):
                    words = (value.as_py() or b"").split()
                    found = runs(numbered(words))
                    stay = kept(len(words), found) if len(found) else None
                    texts.append(b" ".join(words if stay is None else [words[i] for i in np.flatnonzero(stay).tolist()]))
                    sizes.append(sizes[-1] + len(found))
                    rows.append(found)
                flat = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
                fields = [pa.field(f.name, pa.int64(), False) for f in RUNS.elementType.fields]
                items = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=fields)
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), items, type=pa.list_(pa.field("element", items.type, False)))
                kept_texts = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:n], kept_texts, lists], names=schema.names)

    return map_batches(both, run, schema)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", plant: bool = False) -> DataFrame:
    """Per row its key, number of runs, foremost run, and the hashes of its runs and of what is kept.

    With ``plant``, texts are first changed as ``planted`` says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BATCH):
                part = batch.slice(begin, BATCH)
                rows = []
                for name, value in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()), strict=True):
                    words = (value.as_py() or b"").split()
                    if plant:
                        words = planted(words, name)
                    found = runs(numbered(words))
                    whole, best = words, (None, None, None, None)
                    listed = ""
                    if len(found):
                        whole = [words[i] for i in np.flatnonzero(kept(len(words), found)).tolist()]
                        each = list(map(tuple, found.tolist()))
                        listed = "".join(["%d,%d,%d\n" % r for r in each])
                        start, length, period = max(each, key=functools.cmp_to_key(_ahead))
                        best = (start, length, period, 1000 * length // period)
                    hashes = [hashlib.sha256(x).hexdigest() for x in (listed.encode(), b" ".join(whole))]
                    rows.append((name, len(found), *best, *hashes))
                columns = list(zip(*rows, strict=True)) or [()] * len(DIGESTS)
                kinds = [pa.int64()] * 6 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=DIGESTS.names)

    plain = docs.select(col(key).cast("bigint").alias("doc_id"), col(text).alias("text"))
    return map_batches(plain, run, DIGESTS)
