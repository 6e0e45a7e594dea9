"""BPE encoding and decoding by forced boundaries.

A merge joins two neighbouring pieces into a token of the vocabulary. A pair of
bytes that stands side by side in no token can therefore never come to lie in
one piece: between such bytes a cut is certain, whatever the merges do. A text is
cut there (and where the splitting pattern cuts it), the fragments are encoded each
by itself, and their ids are put in a row. Fragments are shorter than words and
repeat more often.

Cases: a null or empty text has no ids and decodes to an empty text; repeated
rows and ties stay rows of their own; an empty table gives an empty table; other
columns pass through unread, and where one has a name of a new column, the new one
replaces it. A very long text is one row, its ids one array.
"""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepview.llm import words
from stepview.llm.shared import beside, col, map_batches

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

#: Texts in a batch that goes back to Spark.
BATCH = 128


class Fragments(words.Words):
    """Words encoded through fragments between forced boundaries."""

    def __init__(self, path: str, room: int = words.ROOM):
        super().__init__(path, room)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.side_by_side = neighbours(model["vocab"], model["end_of_word_suffix"] or "")
        merges = [tuple(x.split(" ", 1)) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        # The same merges without the mark of a word's end, for fragments with more of the word behind them.
        self.inner = type(self.library.model)(vocab=model["vocab"], merges=merges, fuse_unk=False)

    def piece(self, piece: str) -> bytes:
        *front, last = fragments(piece, self.side_by_side)
        inner, packed = self.inner.tokenize, self.packed
        return b"".join([packed[t.id] for x in front for t in inner(x)] + [packed[t.id] for t in self._tokenize(last)])


def neighbours(vocabulary: dict[str, int], end: str) -> set[str]:
    """Pairs of bytes, in the tokenizer's letters, that stand side by side in some token."""
    pairs: set[str] = set()
    for token in vocabulary:
        token = token.removesuffix(end) if end and token != end else token
        pairs.update(map("".join, itertools.pairwise(token)))
    return pairs


def fragments(part: str, side_by_side: set[str]) -> list[str]:
    """``part`` cut between letters that are neighbours in no token."""
    pairs = list(map("".join, itertools.pairwise(part)))
    if side_by_side.issuperset(pairs):
        return [part]
    cuts = [i for i, pair in enumerate(pairs, 1) if pair not in side_by_side]
    return [part[a:b] for a, b in itertools.pairwise([0, *cuts, len(part)])]


@functools.cache
def _fragments(path: str) -> Fragments:
    return Fragments(path)


def _ids(texts: pa.Array, path: str) -> pa.ListArray:
    table = _fragments(path)
    buffers = [table.ids(x) for x in texts.cast(pa.binary()).to_pylist()]
    ends = np.cumsum([0, *(len(x) // 4 for x in buffers)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(buffers), "<i4")))


@functools.cache
def _tokens(path: str) -> list[str]:
    with open(path, encoding="utf-8") as file:
        if json.load(file)["decoder"] is not None:
            raise ValueError(f"{path}: has a decoder of its own")
    library = words.load(path)
    return [library.id_to_token(i) for i in range(library.get_vocab_size())]


def _texts(ids: pa.ListArray, path: str) -> pa.Array:
    tokens = _tokens(path)
    return pa.array([" ".join(map(tokens.__getitem__, x)) for x in ids.to_pylist()], pa.string())


def encode(docs: DataFrame, text: str = "text", into: str = "ids", path: str = TOKENIZER) -> DataFrame:
    """``docs`` with the ids of each whole text, as ARRAY<INT>."""
    return _with_ids(docs, text, path, into)


def coded(docs: DataFrame, text: str = "text", into: str = "ids", back: str = "decoded", path: str = TOKENIZER) -> DataFrame:
    """``decode`` of ``encode`` without the text, in one pass: two would keep twice as many workers, each with its tables, beside one another."""
    return _with_ids(docs, text, path, into, back)


def _with_ids(docs: DataFrame, text: str, path: str, into: str, back: str | None = None) -> DataFrame:
    names = [into] if back is None else [into, back]
    left_out = {x.lower() for x in names} | ({text.lower()} if back is not None else set())
    both, place, n = beside(docs, [c for c in docs.columns if c.lower() not in left_out], text)
    kinds = [T.ArrayType(T.IntegerType(), False), T.StringType()]
    schema = T.StructType([*both.schema.fields[:n], *(T.StructField(x, kind, False) for x, kind in zip(names, kinds))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                ids = _ids(part.column(place), path)
                new = [ids] if back is None else [ids, _texts(ids, path)]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *new], names=schema.names)

    return map_batches(both, run, schema)


def decode(docs: DataFrame, ids: str = "ids", into: str = "decoded", path: str = TOKENIZER) -> DataFrame:
    """``docs`` with the text of each row's ids, special tokens kept."""
    kept = [c for c in docs.columns if c.lower() != into.lower()]
    both = docs.select(*map(col, kept), F.coalesce(col(ids), F.array().cast("array<int>")).alias("\0ids"))
    schema = T.StructType([*both.schema.fields[:-1], T.StructField(into, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], _texts(part.column(part.num_columns - 1), path)], names=schema.names)

    _tokens(path)
    return map_batches(both, run, schema)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """Per row its key, number of ids, and the hashes of ids and decoded text."""
    plain = docs.select(col(key).alias("doc_id"), col(text).alias("text"))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded(plain, path=path).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
