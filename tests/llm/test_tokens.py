"""Encoding by words and fragments, length histogram, and files."""

from __future__ import annotations

import collections
import hashlib
import zlib

import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from stepview.llm import bpe, lengths, rans, words
from stepview.llm.shared import table

from .conftest import ROWS

LIBRARY = words.load(bpe.TOKENIZER)
TABLES = [words.Words(bpe.TOKENIZER, room=50), bpe.Fragments(bpe.TOKENIZER, room=50)]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def by(encoder, text):
    return np.frombuffer(encoder.ids((text or "").encode()), "<u4").tolist()


ODD = [
    "", "it's I'LL 'S ''s can't'd", "A B́ ć̣e İI ΑΣ ΑΣ.", "a\x1cb\x1dc\x00d \x0b\x0c\x1f \x85 \xa0   ​　",
    "q ª ﬁ ½ ٣٤ \U0001d4b3y \U0001f469‍\U0001f467", "<|endoftext|> <|ENDOFTEXT|> <|endoftext |>x<|startoftext|>", "Å ǅ ß ẞ ŉ Kelvin ſecret", "×÷×a ÉCOLE ÿz",
]


@pytest.mark.parametrize("encoder", TABLES, ids=["words", "fragments"])
def test_same_ids_as_the_library(encoder):
    for text in ODD:
        assert by(encoder, text) == ids(text), text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" '\n\tstrevmaldéèßÉ.,;0123 ̣́<|>")), max_size=60))
def test_same_ids_on_any_text(text):
    for encoder in TABLES:
        assert by(encoder, text) == ids(text)


def test_fragments_put_together_give_the_piece():
    pairs = {"ab", "bc"}
    assert bpe.fragments("abcb", pairs) == ["abc", "b"]
    assert bpe.fragments("x", pairs) == ["x"]
    side = TABLES[1].side_by_side
    for token in list(LIBRARY.get_vocab())[:3000]:
        token = token.removesuffix("</w>") or token
        assert bpe.fragments(token, side) == [token] or "<" in token


def test_digests(spark, odd, none):
    got = sorted(map(tuple, bpe.digests(odd).collect()), key=repr)
    want = []
    for d, t, _ in ROWS:
        i = ids(t)
        out = LIBRARY.decode(i, skip_special_tokens=False)
        want.append((d, len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(out.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.digests(none).count() == 0


def test_encode_keeps_other_columns(odd):
    out = bpe.encode(odd)
    assert sorted(out.columns) == sorted(odd.columns)
    assert dict(out.dtypes)["ids"] == "array<int>" and out.select("`a.b`", "_fp").distinct().count() == 1


def test_histogram(spark, odd, none):
    n = collections.Counter(len(ids(t)) for _, t, _ in ROWS)
    hist = lengths.histogram(lengths.encoded_lengths(odd))
    docs = sum(n.values())
    for r in hist.collect():
        at = r["length"]
        assert r["n_docs"] == n[at] and r["n_up_to"] == sum(c for x, c in n.items() if x <= at) and r["n_longer"] == docs - r["n_up_to"]
        assert r["truncated_total"] == sum(min(x, at) * c for x, c in n.items()) and r["lost"] == sum(max(0, x - at) * c for x, c in n.items())
        assert r["tokens_longer"] == sum(x * c for x, c in n.items() if x > at) and r["share_up_to"] == r["n_up_to"] / docs
    assert hist.count() == len(n)
    for limit in (0, 7, 100, 10**6):
        r = lengths.at_limits(hist, [limit]).first()
        assert (r["truncated_total"], r["n_longer"]) == (sum(min(x, limit) * c for x, c in n.items()), sum(c for x, c in n.items() if x > limit))
    assert lengths.quantile(hist, 0.5).first()[0] == sorted(n.elements())[(docs + 1) // 2 - 1]
    assert lengths.histogram(lengths.encoded_lengths(none)).count() == 0


@pytest.mark.parametrize("size", [0, 1, 1023, 1024, 1025, 200_000])
def test_block_round_trip(size):
    rng = np.random.default_rng(size)
    ids_ = np.minimum(rng.zipf(1.3, size), 49407).astype(np.uint32)
    table_ = rans.Table(*np.unique(np.append(ids_, [0, 49407]), return_counts=True))
    stream, states, places = rans.encode_block(ids_, table_)
    crc = zlib.crc32(ids_.astype("<u4").tobytes())
    assert np.array_equal(rans.decode_block(stream, states, places, size, table_, crc), ids_)
    parts = [rans.decode_steps(stream, states, places, size, table_, k, k + 1) for k in range(len(places))]
    assert np.array_equal(np.concatenate([np.zeros(0, np.uint32), *parts]), ids_)
    if size:
        with pytest.raises(ValueError):
            rans.decode_block(stream, states, places, size, table_, crc ^ 1)
    if size > 100_000:
        p = np.unique(ids_, return_counts=True)[1] / size
        assert len(stream) + len(states) < 1.15 * size * -(p * np.log2(p)).sum() / 8 + 10_000


def test_one_symbol_and_rare_symbols():
    only = np.full(5000, 7, np.uint32)
    table_ = rans.Table(np.array([7]), np.array([5000]))
    stream, states, places = rans.encode_block(only, table_)
    assert stream == b"" and np.array_equal(rans.decode_block(stream, states, places, 5000, table_, zlib.crc32(only.tobytes())), only)
    many = rans.Table(np.arange(60_000), np.where(np.arange(60_000) == 3, 10**12, 1))
    assert many.frequency.sum() == 1 << rans.BITS and many.frequency.min() >= 1


def test_files(spark, odd, none, monkeypatch):
    monkeypatch.setattr(rans, "PART", 20_000)
    got = [tuple(r) for r in rans.round_trip(odd).collect()]
    assert len(got) == len(ROWS)
    want, start = [], 0
    for d, t, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, np.array([*ids(r[1]), 1], "<u2").tobytes())):
        b = np.array([*ids(t), 1], "<u4").tobytes()
        want.append((d, start, len(b) // 4, zlib.crc32(b)))
        start += len(b) // 4
    assert sorted(got, key=lambda r: r[1]) == want
    assert rans.round_trip(none).count() == 0


def test_files_of_the_table(spark, monkeypatch):
    monkeypatch.setattr(rans, "PART", 300_000)
    docs = table(spark, SF, "documents").limit(200)
    start = 0
    for r in sorted(rans.round_trip(docs).collect(), key=lambda r: r["doc_id"]):
        assert r["start"] == start
        start += r["n_tokens"]
