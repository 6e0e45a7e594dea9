"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into passages; a passage is a vector of term weights (TF-IDF over hashed
terms). A randomised SVD of all passages of all documents gives a latent space: tasks
multiply their own passages with a thin random matrix and back, the small sums meet
in Spark, and the driver only sees matrices whose size the parameters bound. From that one
pass, singular vectors and values follow by the Nystrom formula. The first ``COMMON``
directions, which tell little more than the language, are left out.

In the latent space, scaled by the singular values, half-overlapping windows of every text are
compared with every benchmark item by cosine. Foreign words in a window can hide an item from that, so
there is a second, exact path: an item of n words with up to n // 4 of them replaced, left out or added shares at least
``n - q + 1 - q * (n // 4)`` runs of q words with a text that holds it, and half of
that within twice its length is enough. Wherever a cosine reaches ``COSINE`` or so many runs
are shared, the words around are checked: the longest common subsequence with the item must
cover enough of it, and of its answer (its last words) too, unless it covers almost
all. The benchmark is the query set, taken in blocks; documents are never compared with each other.

Cases: null and empty texts leak nothing; an empty benchmark marks nothing; equal
items are all reported; a null id is reported like any other; repeated rows each have their own
result; an empty table gives none; other columns pass through ``filtered`` untouched.
Texts of any length are gone through to the end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepview.llm.shared import beside, col, map_batches, saved, scope

#: Hashed terms, rank, extra columns of the random matrix, leading directions left out, words of a passage.
TERMS, RANK, EXTRA, COMMON, PASSAGE = 1 << 14, 128, 16, 8, 32
#: Least cosine of a candidate.
COSINE = 0.45
#: Least share of an item, and of its answer, in the common subsequence; from this share of the item on, the answer needn't be there.
SHARE, ANSWER, ALL = 0.75, 0.5, 0.9
#: The last part of an item that counts as its answer.
TAIL = 0.25
#: Words of an item from which shared runs are of three words, not two; bits of the first look at runs.
LONG, BITS = 12, 22
#: Items compared at a time; slices of sums; words searched and windows compared at a time.
ITEMS, SLICES, SEARCHED, WINDOWS = 4096, 64, 1 << 18, 4096
#: Bytes of a word whose checksum is taken together with others; bytes of texts gone through at a time.
FAR, PIECE = 32, 1 << 18
#: Terms of a stretch of passages that are summed up by a product of matrices, the most common ones.
DENSE = 256
#: Bits of words by which a text's share of an item is judged at first; marks of texts held at a time.
MARKED, MARKS = 18, 1 << 22

#: Letters, digits, ``_`` and whatever isn't ASCII stay; all else divides words.
_LETTERS = bytes(c if c >= 128 or chr(c).isalnum() or c == 95 else 32 for c in range(256))


def _checksums() -> tuple[np.ndarray, np.ndarray]:
    """What a byte adds to the CRC-32 of a word, by its distance from the word's end; checksums of so many zeros."""
    parts = [[zlib.crc32(bytes([b]) + bytes(far)) ^ zlib.crc32(bytes(far + 1)) for b in range(256)] for far in range(FAR)]
    parts = np.array(parts, np.uint32)
    parts[:, 32] = 0
    return parts.ravel(), np.array([zlib.crc32(bytes(n)) for n in range(FAR + 1)], np.uint32)


_PARTS, _ZEROS = _checksums()


def _summed(plain: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Begins and checksums of the words of ``plain``, which begins and ends with a blank."""
    found = np.frombuffer(plain, np.uint8)
    letter = found != 32
    edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    begins, ends = edges[::2], edges[1::2]
    if not len(begins):
        return begins, np.zeros(0, np.uint32)
    first, sizes = int(begins[0]), ends - begins
    # A checksum is the exclusive or of what its bytes add, wherever they stand in front of the end. Blanks add nothing.
    at = np.repeat((ends - 1).astype(np.int32), np.diff(np.append(begins, len(found)))) - np.arange(first, len(found), dtype=np.int32)
    at = np.clip(at, 0, FAR - 1, out=at) << 8 | found[first:]
    out = np.bitwise_xor.reduceat(_PARTS[at], begins - first) ^ _ZEROS[np.minimum(sizes, FAR)]
    for i in np.flatnonzero(sizes > FAR).tolist():
        out[i] = zlib.crc32(plain[begins[i] : ends[i]])
    return begins, out


def words_of_all(texts: Iterable[str | None]) -> list[np.ndarray]:
    """``words_of`` each text; texts are gone through together, about ``PIECE`` bytes at a time."""
    plain = [(t or "").lower().encode("utf-8", "replace").translate(_LETTERS) for t in texts]
    stops = np.cumsum([len(x) + 1 for x in plain], dtype=np.int64)
    whole = b" ".join([b"", *plain, b""])
    del plain
    begins, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    begin = 0
    while begin + 1 < len(whole):
        end = whole.find(b" ", begin + PIECE)
        end = end if end >= 0 else len(whole) - 1
        some, out = _summed(whole[begin : end + 1])
        begins.append(some + begin)
        sums.append(out)
        begin = end
    return np.split(np.concatenate(sums), np.searchsorted(np.concatenate(begins), stops))[:-1]


def words_of(text: str | None) -> np.ndarray:
    """A checksum for each word of the whole text, in lower case and without punctuation."""
    return words_of_all([text])[0]


def worded(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc_id`` and the ``words`` of each text: 32-bit checksums in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = [x.astype("<u4").tobytes() for x in words_of_all(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.binary())], names=["doc_id", "words"])

    return docs.select(col(key).cast("bigint").alias("doc_id"), col(text).alias("text")).mapInArrow(run, "doc_id bigint, words binary")


def padded(terms: np.ndarray, size: int) -> np.ndarray:
    """Terms as rows of ``size``, filled up with ``TERMS``."""
    rows = np.full(-(-len(terms) // size) * size, TERMS, np.int32)
    rows[: len(terms)] = terms
    return rows.reshape(-1, size)


def passages(batch: pa.RecordBatch, size: int = 2048) -> Iterator[np.ndarray]:
    """Passages of a batch of texts, ``size`` at a time."""
    rows = [padded(np.frombuffer(x.as_buffer(), "<u4") % TERMS, PASSAGE) for x in batch.column(0)]
    whole = np.concatenate(rows or [np.zeros((0, PASSAGE), np.int32)])
    for at in range(0, len(whole), size):
        yield whole[at : at + size]


def document_frequencies(terms: DataFrame) -> tuple[np.ndarray, int]:
    """In how many passages each term stands, and the number of passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(TERMS + 1, np.int64), 0
        for batch in batches:
            for rows in passages(batch):
                rows = np.sort(rows, axis=1)
                rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = TERMS
                total += np.bincount(rows.ravel(), minlength=TERMS + 1)
                n += len(rows)
        total[TERMS] = n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["term", "n"])

    sums = terms.mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(TERMS + 1, np.int64)
    out[sums["term"].to_numpy()] = sums["n"].to_numpy()
    return out[:TERMS], int(out[TERMS])


def summed(places: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the ``places`` of the terms in each of ``rows``."""
    out = places.take(rows[:, 0], axis=0)
    held = np.empty_like(out)
    for column in rows.T[1:]:
        out += places.take(column, axis=0, out=held, mode="clip")
    return out


def scatter(total: np.ndarray, rows: np.ndarray, projected: np.ndarray) -> None:
    """Add to the row of each term in ``total`` the rows of ``projected`` of the passages that it stands in, as often as it does."""
    flat = rows.ravel()
    counts = np.bincount(flat, minlength=TERMS + 1)
    counts[TERMS] = 0
    common = np.argpartition(counts, -DENSE)[-DENSE:]
    slot = np.full(TERMS + 1, DENSE)
    slot[common] = np.arange(DENSE)
    slots = slot[rows]
    times = np.bincount((slots + np.arange(len(rows))[:, None] * (DENSE + 1)).ravel(), minlength=len(rows) * (DENSE + 1))
    times = times.reshape(len(rows), DENSE + 1)[:, :DENSE].astype(np.float32)
    total[common] += times.T @ projected
    # The others in turns, in each of which a term comes up once; none is left for more than len(flat) / DENSE of them.
    at = np.flatnonzero((slots.ravel() == DENSE) & (flat != TERMS))
    at = at[np.argsort(flat[at].astype(np.uint16), kind="stable")]
    term = flat[at]
    new = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(at) else at
    turn = np.arange(len(at)) - np.repeat(new, np.diff(np.append(new, len(at))))
    order = np.argsort(turn.astype(np.uint16), kind="stable")
    term, passage = term[order], at[order] // rows.shape[1]
    ends = np.cumsum(np.bincount(turn)) if len(at) else at
    for begin, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
        total[term[begin:end]] += projected[passage[begin:end]]


def stretches(width: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """The random matrix (``TERMS`` x ``width``), ``SLICES`` equal parts one after another: the row that each begins with, and its rows."""
    rng, size = np.random.default_rng(seed), TERMS // SLICES
    for at in range(0, TERMS, size):
        yield at, rng.standard_normal((size, width))


def upright(width: int, seed: int) -> np.ndarray:
    """What makes the columns of the random matrix orthonormal, if it is multiplied with this from the right."""
    gram = sum(part.T @ part for _, part in stretches(width, seed))
    return np.linalg.inv(np.linalg.cholesky(gram)).T


def gram_times(terms: DataFrame, weight: np.ndarray, turn: np.ndarray, seed: int) -> DataFrame:
    """Transposed passages times passages times the random matrix made orthonormal by ``turn``, summed over all passages: ``slice``, ``part``.

    Tasks make the matrix themselves, and the sums stay in a table: the driver has neither."""
    width = len(turn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted = np.zeros((TERMS + 1, width), np.float32)
        for at, part in stretches(width, seed):
            weighted[at : at + len(part)] = (part @ turn) * weight[at : at + len(part), None]
        total = np.zeros((TERMS + 1, width))
        for batch in batches:
            for rows in passages(batch):
                projected = np.concatenate([summed(weighted, rows[k : k + 256]) for k in range(0, len(rows), 256)])
                scatter(total, rows, projected)
        parts = np.split(total[:TERMS].astype(np.float32), SLICES)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["slice", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(part.as_buffer(), np.float32).astype(np.float64)
        size = TERMS // SLICES
        parts = [x.reshape(size, width) * weight[k * size : (k + 1) * size, None] for k, x in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["slice", "part"])

    kind = "slice int, part binary"
    return saved(terms.mapInArrow(run, kind).repartition("slice").mapInArrow(add, kind), "image")


def _small(image: DataFrame, turn: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The orthonormal matrix transposed, times ``image``; ``image`` transposed, times itself."""
    width = len(turn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            held |= {k: np.frombuffer(x.as_buffer()).reshape(-1, width) for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)}
        across, own = np.zeros((width, width)), np.zeros((width, width))
        for k, (_, part) in enumerate(stretches(width, seed) if held else ()):
            if k in held:
                across += (part @ turn).T @ held[k]
                own += held[k].T @ held[k]
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (across, own)], names=["across", "own"])

    rows = image.mapInArrow(run, "across binary, own binary").toLocalIterator()
    across, own = np.zeros((width, width)), np.zeros((width, width))
    for r in rows:
        across += np.frombuffer(r["across"]).reshape(width, width)
        own += np.frombuffer(r["own"]).reshape(width, width)
    return across, own


@dataclass
class Space:
    """A term's place in the latent space, weighted and scaled; one more row of zeros for no term."""

    place: np.ndarray


def fit(words: DataFrame, rank: int = RANK, seed: int = 0) -> Space:
    """The latent space of all passages of all texts in a table of ``words``."""
    # A task sends one matrix of sums: few, long tasks rather than one for each file.
    parallel = words.sparkSession.sparkContext.defaultParallelism
    words = words.select("words").coalesce(4 * parallel)
    frequency, n = document_frequencies(words)
    weight = np.log((1 + n) / (1 + frequency))
    turn = upright(rank + EXTRA, seed)
    with scope(words.sparkSession):
        image = gram_times(words, weight, turn, seed).coalesce(parallel)
        return Space(_placed(image, weight, turn, rank, seed))


def _placed(image: DataFrame, weight: np.ndarray, turn: np.ndarray, rank: int, seed: int) -> np.ndarray:
    """The places of all terms, from the Gram matrix times the orthonormal one."""
    width = len(turn)
    across, own = _small(image, turn, seed)
    # Nystrom: with G the Gram matrix and T thin, G ~ (G T) (T' G T)^-1 (G T)', shifted a little to stay definite.
    # The driver works on what is ``width`` wide and high: with B = (G T) (T' G T)^-1/2, B'B has the values and one side's vectors.
    shift = np.sqrt(np.trace(own)) * 1e-7 + 1e-12
    small = across + shift * np.eye(width)
    undo = np.linalg.inv(np.linalg.cholesky((small + small.T) / 2)).T
    squares, vectors = np.linalg.eigh(undo.T @ (own + shift * (across + across.T) + shift**2 * np.eye(width)) @ undo)
    squares, vectors = np.maximum(squares[::-1], 0), vectors[:, ::-1]
    values = np.maximum(squares - shift, 0)
    keep = np.flatnonzero(values > values[0] * 1e-5)[:rank]
    keep = keep[min(COMMON, len(keep) // 16) :]
    final = (undo @ vectors[:, keep]) / np.sqrt(squares[keep] * values[keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            held |= {k: np.frombuffer(x.as_buffer()).reshape(-1, width) for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)}
        for k, (at, part) in enumerate(stretches(width, seed) if held else ()):
            if k in held:
                found = ((held[k] + shift * (part @ turn)) @ final) * weight[at : at + len(part), None]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([found.astype(np.float32).tobytes()], pa.binary())], names=["slice", "part"])

    # Row by row in memory: rows are looked up by term.
    place = np.zeros((TERMS + 1, len(keep)), np.float32)
    for r in image.mapInArrow(run, "slice int, part binary").toLocalIterator():
        at = r["slice"] * (TERMS // SLICES)
        place[at : at + TERMS // SLICES] = np.frombuffer(r["part"], np.float32).reshape(-1, len(keep))
    return place


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def near(texts: list[np.ndarray], space: Space, directions: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, number and item of all half-overlapping windows that are near an item; window ``i`` begins at word ``i * PASSAGE // 2``.

    A text of up to half a window has one; windows of all texts are compared together, ``WINDOWS`` at a time."""
    half = PASSAGE // 2
    rows = np.concatenate([np.zeros((0, half), np.int32), *(padded(w % TERMS, half) for w in texts)])
    counts = np.array([-(-len(w) // half) for w in texts], np.int64)
    first = np.cumsum(counts) - counts
    many = np.maximum(counts - 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(texts)), many)
    number = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    begin, pair = first[text] + number, counts[text] > 1
    for k in range(0, len(text), WINDOWS):
        some, two = begin[k : k + WINDOWS], pair[k : k + WINDOWS]
        low, high = int(some[0]), int(some[-1]) + 2
        halves = np.concatenate([summed(space.place, rows[i : min(i + 256, high)]) for i in range(low, min(high, len(rows)), 256)])
        there = np.where(two, np.minimum(some - low + 1, len(halves) - 1), 0)
        whole = halves[some - low] + halves[there] * two[:, None]
        least = COSINE * np.maximum(np.linalg.norm(whole, axis=1, keepdims=True), 1e-12)
        at, item = np.divmod(np.flatnonzero(whole @ directions.T >= least), len(directions))
        yield text[k + at], number[k + at], item


def grams(words: np.ndarray, q: int) -> np.ndarray:
    """A hash for each run of ``q`` words."""
    out = np.zeros(max(0, len(words) - q + 1), np.uint64)
    for k in range(q):
        out = (out ^ words[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Grams:
    """Runs of ``q`` words of the items that are looked up by them."""

    q: int
    seen: np.ndarray
    keys: np.ndarray
    starts: np.ndarray
    owners: np.ndarray

    @staticmethod
    def of(words: list[np.ndarray], q: int) -> Grams:
        mine = [(j, np.unique(grams(w, q))) for j, w in enumerate(words) if q == run_length(len(w))]
        every = np.concatenate([np.zeros(0, np.uint64), *(g for _, g in mine)])
        owners = np.repeat(np.array([j for j, _ in mine], np.int64), [len(g) for _, g in mine])
        order = np.argsort(every, kind="stable")
        keys, starts = np.unique(every[order], return_index=True)
        seen = np.zeros(1 << BITS, bool)
        seen[keys >> np.uint64(64 - BITS)] = True
        return Grams(q, seen, keys, np.append(starts, len(every)), owners[order])

    def met(self, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts, items and places (among all ``words``) of all runs that they share; ``ends``: of the texts in ``words``."""
        found = grams(words, self.q)
        at = np.flatnonzero(self.seen[found >> np.uint64(64 - BITS)])
        k = np.searchsorted(self.keys, found[at])
        same = k < len(self.keys)
        same[same] = self.keys[k[same]] == found[at[same]]
        at, k = at[same], k[same]
        text = np.searchsorted(ends, at, side="right")
        within = at + self.q <= ends[text] if len(at) else np.zeros(0, bool)
        at, k, text = at[within], k[within], text[within]
        counts = self.starts[k + 1] - self.starts[k]
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.repeat(text, counts), self.owners[np.repeat(self.starts[k], counts) + inside], np.repeat(at, counts)


def run_length(n: int) -> int:
    """Words of the runs by which an item of ``n`` words is looked up."""
    return 3 if n >= LONG else min(n, 2)


@dataclass
class Items:
    """Benchmark items ready for comparison."""

    ids: list[int | None]
    words: list[np.ndarray]
    directions: np.ndarray
    #: Made in the worker, by ``spans``.
    runs: list[Grams] | None = None
    lengths: np.ndarray | None = None
    #: Place of a word's last bits among those of the items' words; the places of each item's words, and where they begin.
    place: np.ndarray | None = None
    places: np.ndarray | None = None
    starts: np.ndarray | None = None

    def may_hold(self, words: np.ndarray, ends: np.ndarray, text: np.ndarray, item: np.ndarray) -> np.ndarray:
        """False only for pairs whose text lacks so many words of the item that no common subsequence can be long enough."""
        if self.place is None:
            own = [np.unique(w) & np.uint32((1 << MARKED) - 1) for w in self.words]
            every, places = np.unique(np.concatenate([np.zeros(0, np.uint32), *own]), return_inverse=True)
            self.place = np.full(1 << MARKED, len(every), np.int32)
            self.place[every] = np.arange(len(every))
            self.places, self.starts = places, np.cumsum([0, *map(len, own)])
            self.lengths = np.array([len(w) for w in self.words], np.int64)
        width = int(self.place.max()) + 1
        out = np.zeros(len(text), bool)
        owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        order = np.argsort(text, kind="stable")
        many = max(1, MARKS // width)
        for low in range(0, len(ends), many):
            stop = int(ends[min(low + many, len(ends)) - 1])
            first = int(ends[low - 1]) if low else 0
            mine = order[slice(*np.searchsorted(text[order], [low, low + many]))]
            if not len(mine):
                continue
            marks = np.zeros(min(many, len(ends) - low) * width, bool)
            marks[(owner[first:stop] - low) * width + self.place[words[first:stop] & np.uint32((1 << MARKED) - 1)]] = True
            for k in range(0, len(mine), WINDOWS):
                some = mine[k : k + WINDOWS]
                sizes = self.starts[item[some] + 1] - self.starts[item[some]]
                begins = np.cumsum(sizes) - sizes
                at = np.arange(sizes.sum()) + np.repeat(self.starts[item[some]] - begins, sizes)
                there = marks[np.repeat((text[some] - low) * width, sizes) + self.places[at]]
                n = self.lengths[item[some]]
                out[some] = n - sizes + np.add.reduceat(there, begins, dtype=np.int64) >= SHARE * n
        return out

    def spans(self, words: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Text, item, begin and end (among all ``words``) of the words of a text that share enough runs with an item."""
        if self.runs is None:
            self.runs = [Grams.of(self.words, q) for q in {run_length(len(w)) for w in self.words}]
            self.lengths = np.array([len(w) for w in self.words], np.int64)
        for some in self.runs:
            text, item, at = some.met(words, ends)
            order = np.lexsort((at, item, text))
            text, item, at = text[order], item[order], at[order]
            n = self.lengths[item]
            last = np.arange(len(item)) + np.maximum(1, (n - some.q + 1 - some.q * (n // 4)) // 2) - 1
            stop = np.minimum(last, len(item) - 1)
            good = np.flatnonzero((last == stop) & (item[stop] == item) & (text[stop] == text) & (at[stop] - at <= 2 * n))
            yield from zip(text[good].tolist(), item[good].tolist(), (at - n)[good].tolist(), (at[stop] + some.q + n)[good].tolist(), strict=True)

    @staticmethod
    def of(rows: list[tuple[int | None, str | None]], space: Space) -> Items:
        found = [(i, words_of(t)) for i, t in rows]
        found = [(i, w) for i, w in found if len(w)]
        places = [space.place[w % TERMS].sum(axis=0) for _, w in found]
        return Items([i for i, _ in found], [w for _, w in found], unit(np.array(places, np.float32).reshape(len(found), -1)))


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit by bit in integers as wide as ``a``."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        match = row & at.get(x, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def candidates(texts: list[np.ndarray], space: Space, items: Items) -> dict[int, dict[int, list[tuple[int, int]]]]:
    """By text and item, the stretches of words that may hold the item."""
    out: dict[int, dict[int, list[tuple[int, int]]]] = {}
    half = PASSAGE // 2
    words, ends = np.concatenate(texts), np.cumsum([len(w) for w in texts])
    found = np.concatenate([np.zeros((4, 0), np.int64), *(_runs(*x) for x in near(texts, space, items.directions))], axis=1)
    pair, which = np.unique(found[0] * len(items.words) + found[1], return_inverse=True)
    may = items.may_hold(words, ends, *np.divmod(pair, len(items.words)))[which]
    for t, j, first, last in found[:, may].T.tolist():
        n = len(items.words[j])
        out.setdefault(t, {}).setdefault(j, []).append((first * half - n, last * half + PASSAGE + n))
    begins = (ends - [len(w) for w in texts]).tolist()
    for t, j, begin, end in items.spans(words, ends):
        out.setdefault(t, {}).setdefault(j, []).append((begin - begins[t], end - begins[t]))
    return out


def confirmed(words: np.ndarray, places: dict[int, list[tuple[int, int]]], items: Items) -> list[tuple[int, int, float]]:
    """Number of each item that a text holds at one of its places, words of the item found in order, and their share."""
    best: dict[int, tuple[int, float]] = {}
    for j, group in places.items():
        wanted = items.words[j].tolist()
        n = len(wanted)
        have = set(wanted)
        for begin, end in _merged(group):
            region = words[max(0, begin) : end].tolist()
            if n - len(have.difference(region)) < SHARE * n:  # no subsequence can have what the region lacks
                continue
            for k in range(0, max(1, len(region) - n // 2), max(1, n // 2)):
                part = region[k : k + 2 * n]
                length = common_subsequence(wanted, part)
                if length < SHARE * n:
                    continue
                tail = wanted[-max(3, round(n * TAIL)) :]
                if length < ALL * n and common_subsequence(tail, part) < ANSWER * len(tail):
                    continue
                best[j] = max(best.get(j, (0, 0.0)), (length, length / n))
    return [(j, *found) for j, found in sorted(best.items())]


def leaks(texts: list[np.ndarray], space: Space, items: Items) -> list[list[tuple[int, int, float]]]:
    """``confirmed`` for each text. Texts are searched together, up to ``SEARCHED`` words or one text with more at a time."""
    out: list[list[tuple[int, int, float]]] = [[] for _ in texts]
    begin, held = 0, 0
    for i in range(len(texts) + 1):
        if i == len(texts) or (i > begin and held + len(texts[i]) > SEARCHED):
            if held and items.ids:
                for t, places in candidates(texts[begin:i], space, items).items():
                    out[begin + t] = confirmed(texts[begin + t], places, items)
            begin, held = i, 0
        if i < len(texts):
            held += len(texts[i])
    return out


def _runs(text: np.ndarray, number: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Text and item with the first and last of each run of neighbouring windows."""
    order = np.lexsort((number, item, text))
    text, number, item = text[order], number[order], item[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (np.diff(number) > 1)
    starts = np.flatnonzero(new)
    lasts = np.append(starts[1:], len(text)) - 1 if len(starts) else starts
    return np.stack([text[starts], item[starts], number[starts], number[lasts]])


def _merged(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Spans that overlap are one."""
    spans = sorted(spans)
    begin, end = spans[0]
    for a, b in spans[1:]:
        if a > end:
            yield begin, end
            begin, end = a, b
        end = max(end, b)
    yield begin, end


def benchmark_blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int | None, str | None]]]:
    """The query set, at most ``ITEMS`` at a time."""
    block = []
    for r in benchmark.select(col(item).cast("bigint"), col(text)).toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == ITEMS:
            yield block
            block = []
    if block:
        yield block


def matched(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id``, ``item_id``, ``lcs`` (words), ``share``: every benchmark item that a document holds."""
    words = saved(worded(docs, key, text), "words")
    space = fit(words.unionByName(worded(benchmark, item, item_text)))
    out = None
    for block in benchmark_blocks(benchmark, item, item_text):
        part = _matched(words, Items.of(block, space), space)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, lcs int, share double")


def _matched(words: DataFrame, items: Items, space: Space) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [np.frombuffer(w.as_buffer(), "<u4") for w in batch.column(1)]
            rows = [(k, *x) for k, found in zip(batch.column(0).to_pylist(), leaks(texts, space, items), strict=True) for x in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([items.ids[r[1]] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.float64())],
                names=["doc_id", "item_id", "lcs", "share"],
            )

    return words.mapInArrow(run, "doc_id bigint, item_id bigint, lcs int, share double")


def filtered(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, as they are."""
    texts = docs.select(F.lit(None).alias("key"), col(text).alias("text"))
    with scope(docs.sparkSession):
        space = fit(saved(worded(texts, "key", "text").unionByName(worded(benchmark, item, item_text)), "words"))
    for block in benchmark_blocks(benchmark, item, item_text):
        docs = _clean(docs, Items.of(block, space), space, text)
    return docs


def _clean(docs: DataFrame, items: Items, space: Space, text: str) -> DataFrame:
    both, place, n = beside(docs, docs.columns, text)
    schema = T.StructType(both.schema.fields[:n])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                clean = [not found for found in leaks(words_of_all(part.column(place).to_pylist()), space, items)]
                yield pa.RecordBatch.from_arrays(part.filter(pa.array(clean, pa.bool_())).columns[:n], names=schema.names)

    return map_batches(both, run, schema)
