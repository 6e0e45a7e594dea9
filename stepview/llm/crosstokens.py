"""Alignment of two tokenizers' tokens over the bytes of each text.

Each text is encoded twice. The tokens of a side and the bytes they cover make an incidence matrix in CSR form
(``csr``); the product of side A with the transpose of side B, row by row, has an entry wherever a token of A
and a token of B overlap, and its value is the number of bytes that both cover. Byte offsets at which tokens of
both sides end cut the text into groups; the product of A's group incidence with the transpose of B's names the pairs
that share a group. The texts of a batch are the diagonal blocks of one matrix, so one product serves many texts;
products are formed block of rows by block of rows, so a long text needs no more memory than its own tokens.

Side A is byte-level BPE: an entry's letters stand for bytes. Side B is a sentencepiece model with byte fallback that
puts a blank in front of the text. A is given that blank, too.

How many documents hold a pair of ids linked is counted over the whole corpus: within batches first, then by a shuffle.
The pairs that most documents hold, ``COMMON`` at most, go to every task; the others are joined. So each link gets its
count, and no pair's rows are many in the join.

Cases: a null or empty text, or one whose tokens do not join to a blank and the text again (a text with U+2581, or one
that is not valid UTF-8), has no tokens: zeros and an empty string. Special tokens' strings are plain text. Repeated rows
and ties stay rows of their own and count each as a document; an empty table gives an empty table; of other columns
nothing is read, whatever their names. A very long text is one row, in memory in proportion to its tokens.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepview.llm import csr, words
from stepview.llm.shared import col, map_batches, saved

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

#: Pairs sent to every task, 4 MB; bytes of text that are aligned at a time; pairs counted at a time.
COMMON, BYTES, COUNTED = 1 << 18, 1 << 20, 1 << 20
#: A pair of ids is one number: the id of A above these bits, that of B in them.
BITS = 24


@functools.cache
def side_a(path: str = A) -> tuple[tiktoken.Encoding, list[bytes]]:
    """The byte-level tokenizer, and the bytes of each of its ids.

    Its merges must be in the order of the ids they make: then the least id is the first merge, and the encoder
    by ranks does what the library does, at four times its speed."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    model, special = made["model"], {x["content"] for x in made["added_tokens"]}
    byte = {chr(words._LETTERS.get(b, b)): b for b in range(256)}
    ranks = {bytes(map(byte.__getitem__, t)): i for t, i in model["vocab"].items() if t not in special}
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    split = made["pre_tokenizer"]
    fits = (
        model["type"] == "BPE"
        and made["normalizer"] is None
        and (split["type"], split["add_prefix_space"], split["use_regex"]) == ("ByteLevel", False, True)
        and [model["vocab"][m] for m in merges] == list(range(256, 256 + len(merges)))
        and len(ranks) == 256 + len(merges)
    )
    if not fits:
        raise ValueError(f"{path}: not a plain byte-level tokenizer with merges in the order of ids")
    encoding = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = [b""] * (max(model["vocab"].values()) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    return encoding, tokens


@functools.cache
def side_b(path: str = B) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes]]:
    """The sentencepiece model, and the bytes of each of its ids; control and unknown pieces stand for none."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def of(i: int) -> bytes:
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return b"" if model.is_control(i) or model.is_unknown(i) else piece.replace("▁", " ").encode()

    return model, [of(i) for i in range(model.get_piece_size())]


def encoded(texts: list[bytes | None], a: str = A, b: str = B) -> list[tuple[list[int], list[int]]]:
    """Ids of both sides for each text; none where the tokens are not the text."""
    (coder, bytes_a), (model, bytes_b) = side_a(a), side_b(b)
    out = []
    for text in texts:
        ids_a, ids_b = [], []
        if text:
            plain = text.decode("utf-8", "replace")
            ids_a, ids_b = coder.encode_ordinary(" " + plain), model.encode(plain)
            whole = b" " + text
            if b"".join(map(bytes_b.__getitem__, ids_b)) != whole or b"".join(map(bytes_a.__getitem__, ids_a)) != whole:
                ids_a, ids_b = [], []
        out.append((ids_a, ids_b))
    return out


class Aligned:
    """Some texts' tokens on both sides: ids, the texts they belong to, byte ends, groups, incidence matrices."""

    def __init__(self, coded: list[tuple[list[int], list[int]]], a: str = A, b: str = B):
        self.texts = len(coded)
        self.ids, self.text, ends = [], [], []
        sizes = _lengths(a, 0), _lengths(b, 1)
        self.vocabularies = len(sizes[0]), len(sizes[1])
        for side, lengths in enumerate(sizes):
            counts = np.array([len(x[side]) for x in coded], np.int64)
            ids = np.fromiter((i for x in coded for i in x[side]), np.int64, int(counts.sum()))
            self.ids.append(ids)
            self.text.append(np.repeat(np.arange(self.texts), counts))
            ends.append(np.cumsum(lengths[ids]))
        common = np.intersect1d(*ends, assume_unique=True)
        self.groups = len(common)
        self.spans = [csr.spans(e) for e in ends]
        self.group = [np.searchsorted(common, e) for e in ends]

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of overlapping tokens of A and B, and the bytes that both cover."""
        yield from csr.blocks(self.spans[0], csr.transposed(self.spans[1]))

    def shared(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of tokens of A and B that are in one group."""
        one, two = (csr.members(g, self.groups) for g in self.group)
        yield from csr.blocks(one, csr.transposed(two))

    def n_shared(self) -> np.ndarray:
        """For each token of A the number of tokens of B in its group."""
        one, two = (csr.members(g, self.groups) for g in self.group)
        return csr.sizes(one, csr.transposed(two))

    def written(self) -> list[str]:
        """Each text's groups: ids of A, a bar, ids of B; semicolons between groups."""
        names = _names(*self.vocabularies)
        place, code = [], []
        for side in (0, 1):
            group, ids = self.group[side], self.ids[side]
            last = np.ones(len(ids), bool)
            last[:-1] = group[1:] != group[:-1]
            place.append(2 * group + side)
            code.append(2 * ids + last + side * names[1])
        place, code = np.concatenate(place), np.concatenate(code)
        order = np.argsort(place, kind="stable")
        code = code[order].tolist()
        ends = np.cumsum(np.bincount(self.text[0], minlength=self.texts) + np.bincount(self.text[1], minlength=self.texts))
        out, begin = [], 0
        for end in ends.tolist():
            out.append("".join(map(names[0].__getitem__, code[begin:end]))[:-1])
            begin = end
        return out


@functools.cache
def _lengths(path: str, side: int) -> np.ndarray:
    return np.array([len(t) for t in (side_b if side else side_a)(path)[1]], np.int64)


@functools.cache
def _names(a: int, b: int) -> tuple[list[str], int]:
    """Each id with what follows it: A with a comma or a bar, B with a comma or a semicolon; where B begins."""
    return [f"{i}{s}" for i in range(a) for s in ",|"] + [f"{i}{s}" for i in range(b) for s in ",;"], 2 * a


def _slices(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Begins and ends of stretches of texts with ``BYTES`` bytes, or of one text with more."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text or b"") + 64
        if i > begin and held + size > BYTES:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(texts):
        yield begin, len(texts)


def _batches(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(col(key).cast("bigint").alias("doc_id"), col(text).alias("text"))


def _pairs(docs: DataFrame, key: str, text: str, a: str, b: str, shared: bool) -> DataFrame:
    names = ["doc_id", "a_place", "b_place", "a_id", "b_id", "n_bytes"]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).cast(pa.binary()).to_pylist()
            for begin, end in _slices(values):
                at = Aligned(encoded(values[begin:end], a, b), a, b)
                firsts = [np.searchsorted(t, np.arange(at.texts)) for t in at.text]
                for one, two, many in at.shared() if shared else at.links():
                    row = at.text[0][one]
                    columns = [one - firsts[0][row], two - firsts[1][row], at.ids[0][one], at.ids[1][two], many]
                    keys = batch.column(0).slice(begin, end - begin).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([keys, *map(pa.array, columns)], names=names)

    out = map_batches(_batches(docs, key, text), run, schema)
    return out.drop("n_bytes") if shared else out


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", a: str = A, b: str = B) -> DataFrame:
    """A row for each two overlapping tokens: ``doc_id``, places and ids of both, bytes that both cover."""
    return _pairs(docs, key, text, a, b, False)


def shared_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", a: str = A, b: str = B) -> DataFrame:
    """A row for each token of A and token of B in one group: ``doc_id``, places and ids of both."""
    return _pairs(docs, key, text, a, b, True)


_ROWS = ("n_a", "n_b", "n_groups", "n_links", "n_shared")


def aligned(docs: DataFrame, key: str = "doc_id", text: str = "text", a: str = A, b: str = B) -> DataFrame:
    """Of each row: ``doc_id``, ``row`` (a number of its own), counts, ``groups_sha256``, and its different linked pairs of ids
    (``pairs``, ascending) with how often each occurs (``times``), both as little-endian integers of 8 and 4 bytes."""
    names = ["row", "doc_id", *_ROWS, "groups_sha256", "pairs", "times"]
    kinds = [T.LongType()] * 7 + [T.StringType(), T.BinaryType(), T.BinaryType()]
    schema = T.StructType([T.StructField(c, k) for c, k in zip(names, kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(2).cast(pa.binary()).to_pylist()
            for begin, end in _slices(values):
                at = Aligned(encoded(values[begin:end], a, b), a, b)
                n = at.texts
                per_text = [np.bincount(t, minlength=n) for t in at.text]
                last = np.searchsorted(at.text[0], np.arange(n), side="right")
                group_ends = np.concatenate([[0], at.group[0] + 1])[last]
                n_groups = np.diff(np.concatenate([[0], group_ends]))
                n_shared = np.bincount(at.text[0], weights=at.n_shared(), minlength=n).astype(np.int64)
                pairs, n_links, held = [], np.zeros(n, np.int64), []
                for one, two, _ in at.links():
                    row = at.text[0][one]
                    n_links += np.bincount(row, minlength=n)
                    held.append((row, at.ids[0][one] << BITS | at.ids[1][two]))
                row, pair = (np.concatenate([np.zeros(0, np.int64), *(h[k] for h in held)]) for k in (0, 1))
                order = np.lexsort((pair, row))
                row, pair = row[order], pair[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])
                starts = np.flatnonzero(new)
                times = np.diff(np.concatenate([starts, [len(row)]])).astype("<u4")
                row, pair = row[starts], pair[starts].astype("<i8")
                cuts = np.searchsorted(row, np.arange(n + 1))
                pairs = [(pair[i:j].tobytes(), times[i:j].tobytes()) for i, j in zip(cuts[:-1], cuts[1:])]
                hashes = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in at.written()]
                counts = [per_text[0], per_text[1], n_groups, n_links, n_shared]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.slice(begin, end - begin) for c in batch.columns[:2]),
                        *(pa.array(c, pa.int64()) for c in counts),
                        pa.array(hashes, pa.string()),
                        pa.array([p for p, _ in pairs], pa.binary()),
                        pa.array([t for _, t in pairs], pa.binary()),
                    ],
                    names=names,
                )

    plain = docs.select(F.monotonically_increasing_id().alias("row"), col(key).cast("bigint").alias("doc_id"), col(text).alias("text"))
    return map_batches(plain, run, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair``, ``n``: in how many of the ``aligned`` rows each pair of ids is linked; ``best``: no pair with this id of A is in more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], names=["pair", "n"])

        for batch in batches:
            for value in batch.column(0):
                held.append(np.frombuffer(value.as_buffer(), "<i8"))
                size += len(held[-1])
                if size > COUNTED:
                    yield counted()
                    held, size = [], 0
        yield counted()

    counts = rows.select("pairs").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = saved(counts, "pairs")
    # One row for each id of A, so no more than its vocabulary has.
    best = counts.groupBy(_id_a().alias("a")).agg(F.max("n").alias("most"))
    return saved(counts.join(best, _id_a() == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")


def _id_a() -> Column:
    return F.shiftright("pair", BITS)


def common_pairs(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs with the highest counts, ``most`` at most, by pair; their counts; which are best."""
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect(), reverse=True)
    least, held = None, 0
    for row in levels:
        held += row["rows"]
        if held > most:
            break
        least = row["level"]
    chosen = [] if least is None else counts.where(level >= least).collect()
    chosen.sort()
    return tuple(np.array([r[k] for r in chosen], kind) for k, kind in enumerate((np.int64, np.int64, bool)))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", a: str = A, b: str = B, common: int = COMMON) -> DataFrame:
    """Per row its key, numbers of tokens, groups and links, and over its links: how many have a best pair, the sum of counts."""
    rows = saved(aligned(docs, key, text, a, b), "aligned")
    counts = pair_counts(rows)
    known = docs.sparkSession.sparkContext.broadcast(common_pairs(counts, common))
    kept = ["row", "doc_id", *_ROWS, "groups_sha256"]
    names = [*kept, "best", "total", "rest"]
    rest_type = T.ArrayType(T.StructType([T.StructField("pair", T.LongType()), T.StructField("times", T.LongType())]))
    schema = T.StructType([*rows.select(kept).schema, T.StructField("best", T.LongType()), T.StructField("total", T.LongType()), T.StructField("rest", rest_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, numbers, best = known.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                sums, cuts, left = [], [0], [[], []]
                for i in range(part.num_rows):
                    pair = np.frombuffer(part.column(len(kept))[i].as_buffer(), "<i8")
                    times = np.frombuffer(part.column(len(kept) + 1)[i].as_buffer(), "<u4").astype(np.int64)
                    at = np.minimum(np.searchsorted(pairs, pair), max(0, len(pairs) - 1))
                    hit = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
                    at = at[hit]
                    sums.append((int(times[hit][best[at]].sum()), int((times[hit] * numbers[at]).sum())))
                    left[0].append(pair[~hit])
                    left[1].append(times[~hit])
                    cuts.append(cuts[-1] + int((~hit).sum()))
                items = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in left], names=["pair", "times"])
                rest = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), items)
                totals = [pa.array([s[k] for s in sums], pa.int64()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *totals, rest], names=names)

    looked_up = saved(rows.select(*kept, "pairs", "times").mapInArrow(run, schema), "looked-up")
    rest = looked_up.select("row", F.inline("rest")).join(counts, "pair")
    more = rest.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_total"))
    both = looked_up.drop("rest").join(saved(more, "rest"), "row", "left")
    return both.select(
        "doc_id",
        *_ROWS[:4],
        (F.col("best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("total") + F.coalesce("more_total", F.lit(0))).alias("count_sum"),
        "groups_sha256",
        "n_shared",
    )
