"""Token alignment against plain loops over both tokenizers' own results."""

from __future__ import annotations

import collections
import hashlib

import numpy as np
import pytest
from conftest import SF
from tokenizers import Tokenizer

from stepview.llm import crosstokens, csr, queries
from stepview.llm.shared import ship, table

from .conftest import ROWS, texts


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(crosstokens.A)
    tokenizer.encode_special_tokens = True
    return tokenizer


def aligned(library, text):
    """Tokens, groups and linked id pairs of one text, by walking over both sides."""
    bytes_a, (model, bytes_b) = crosstokens.side_a()[1], crosstokens.side_b()
    a, b = library.encode(" " + (text or ""), add_special_tokens=False).ids, model.encode(text or "")
    whole = (" " + (text or "")).encode()
    if not text or b"".join(bytes_a[i] for i in a) != whole or b"".join(bytes_b[i] for i in b) != whole:
        return [], [], "", []
    owner = [[i for i, t in enumerate(ids) for _ in tokens[t]] for ids, tokens in ((a, bytes_a), (b, bytes_b))]
    links = sorted({(x, y) for x, y in zip(*owner)})
    groups, one, two = [], [], []
    for at in range(len(whole)):
        ends = [at + 1 == len(whole) or o[at + 1] != o[at] for o in owner]
        one += [a[owner[0][at]]] * ends[0]
        two += [b[owner[1][at]]] * ends[1]
        if all(ends):
            groups.append(f"{','.join(map(str, one))}|{','.join(map(str, two))}")
            one, two = [], []
    return a, b, ";".join(groups), [(a[x], b[y]) for x, y in links]


def brute_force(library, docs):
    each = [(d, *aligned(library, t)) for d, t in docs]
    counts = collections.Counter(p for *_, links in each for p in set(links))
    most = collections.defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for d, a, b, groups, links in each:
        hashed = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        n_groups = groups.count(";") + 1 if groups else 0
        n_best, total = sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links)
        out.append((d, len(a), len(b), n_groups, len(links), n_best, total, hashed))
    return sorted(out, key=repr)


def answers(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


def test_documents(spark, library):
    """The registered query on its whole table; and with few common pairs, so that most are joined."""
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    want = brute_force(library, docs)
    assert answers(queries.QUERIES["op11_token_alignment"](spark, SF)) == want
    assert answers(crosstokens.digests(table(spark, SF, "documents"), common=300)) == want


ODD = [
    (20, "snowman ☃ 漢字かな交じり文 😀👩‍👩‍👧 naïve é"),
    (21, "has ▁ in it"),
    (22, "  spaces   and\ttabs\r\n\n\nlines  "),
    (23, "<|endoftext|> and <s> </s> <unk> <0x41>"),
    (24, "\x00\x01 \x7f \u0085   ﻿"),
    (25, "ﬁ ² Ⅷ ǆ ſ"),
]


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_rows(spark, odd, none, library, size, monkeypatch):
    monkeypatch.setattr(crosstokens, "BYTES", size)
    ship(spark)
    assert answers(crosstokens.digests(odd)) == brute_force(library, [(d, t) for d, t, _ in ROWS])
    assert crosstokens.digests(none).count() == 0
    assert answers(crosstokens.digests(texts(spark, ODD))) == brute_force(library, ODD)
    assert crosstokens.encoded([b"has \xe2\x96\x81 in it", b"not \xff valid", b"", None]) == [([], [])] * 4


def test_links_and_shared_groups(spark, library):
    """Rows of both products."""
    ship(spark)
    docs = [*ODD, (30, None), (31, "plain words, plainly")]
    frame = texts(spark, docs)
    rows = collections.defaultdict(list)
    for r in crosstokens.links(frame).collect():
        rows[r["doc_id"]].append(tuple(r)[1:])
    bytes_a = crosstokens.side_a()[1]
    for d, t in docs:
        a, b, groups, links = aligned(library, t)
        mine = sorted(rows[d])
        assert [(x, y) for *_, x, y, _ in mine] == links
        assert all(a[i] == x and b[j] == y for i, j, x, y, _ in mine)
        assert sum(n for *_, n in mine) == sum(len(bytes_a[i]) for i in a)
    pairs = collections.Counter(r["doc_id"] for r in crosstokens.shared_groups(frame).collect())
    for d, t in docs:
        groups = aligned(library, t)[2]
        assert pairs[d] == sum((g.split("|")[0].count(",") + 1) * (g.split("|")[1].count(",") + 1) for g in groups.split(";") if g)


def test_encoder_by_ranks_is_the_library(library):
    """Each code point between letters, digits, blanks and signs."""
    encoding, _ = crosstokens.side_a()
    for begin in range(0, 0x110000, 1 << 14):
        batch = [f" a{c}b {c}{c}1{c} {c}  {c}\n{c}!{c}'s" for c in map(chr, range(begin, begin + (1 << 14))) if not 0xD800 <= ord(c) < 0xE000]
        got = library.encode_batch(batch, add_special_tokens=False)
        assert all(e.ids == encoding.encode_ordinary(t) for e, t in zip(got, batch))


def test_products():
    """Gustavson's product of random matrices against dense ones, in blocks of any size."""
    rng = np.random.default_rng(0)
    for _ in range(50):
        n, m, k = rng.integers(0, 12, 3)
        one, two = ((rng.random(s) < 0.3) * rng.integers(1, 5, s) for s in ((n, m), (m, k)))

        def sparse(x):
            indptr = np.concatenate([[0], np.cumsum((x > 0).sum(axis=1))]).astype(np.int64)
            return csr.Csr(indptr, np.nonzero(x)[1], x.shape[1], x[x > 0])

        def dense(x):
            out = np.zeros((x.rows, x.columns), np.int64)
            out[np.repeat(np.arange(x.rows), x.lengths()), x.indices] = x.data
            return out

        for most in (1, 5, 1 << 20):
            assert (dense(csr.product(sparse(one), sparse(two), most)) == one @ two).all()
        assert (dense(csr.transposed(sparse(one))) == one.T).all()
        assert (csr.sizes(sparse(one), sparse(two)) == (one > 0) @ (two > 0).sum(axis=1)).all()
