"""Runs of words against comparing a text with itself at every distance."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from stepview.llm import periods, queries
from stepview.llm.shared import ship, table

from .conftest import ROWS, texts


def brute_runs(words):
    """By definition: at each distance the longest stretches, each under its smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        start = None
        for i in range(n - q + 1):
            same = i < n - q and words[i] == words[i + q]
            if same and start is None:
                start = i
            elif not same and start is not None:
                length = i + q - start
                if length >= max(24, 3 * q):
                    found.setdefault((start, length), q)
                start = None
    return sorted((s, length, q) for (s, length), q in found.items())


def row(key, text, plant):
    words = (text or "").encode().split()
    if plant and key is not None and words and zlib.crc32(str(key).encode()) % 10 == 0:
        g = zlib.crc32(str(key).encode()) // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (key, len(found), *shown, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def repeating(rng):
    """Words with runs of many kinds: powers, roots with powers inside, overlapping and nested runs, near misses."""
    n, k = rng.randint(0, 900), rng.choice([1, 2, 2, 3, 50])
    words = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randint(0, 4)):
        if n < 30:
            break
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // rng.randint(2, 8)))
        root = words[a : a + p]
        if rng.random() < 0.6:
            root = [0] * p
            if rng.random() < 0.8:
                root[rng.randrange(p)] = 1
            if rng.random() < 0.5:
                root = (root[: max(1, p // 3)] * 5)[:p]
                root[-1] = 7
        for i in range(a, rng.randint(a, n)):
            words[i] = root[(i - a) % p]
    return words


@pytest.mark.parametrize("seed", range(4))
def test_runs(seed):
    rng = random.Random(seed)
    for _ in range(60):
        words = repeating(rng)
        assert list(map(tuple, periods.runs(np.array(words, np.int64)).tolist())) == brute_runs(words)


def test_every_scale():
    """A run of each period up to 400, with exactly three periods, among other words."""
    rng = random.Random(9)
    for p in range(1, 401):
        root = list(range(p))
        rng.shuffle(root)
        length = max(24, 3 * p)
        words = [-1, -2, -3, *(root[i % p] for i in range(length)), -4, -5]
        assert periods.runs(np.array(words) + 10).tolist() == [[3, length, p]]
        if p >= 8:
            assert periods.runs(np.array(words[:-3]) + 10).tolist() == []  # one word too few


def test_synchronising_sets_are_consistent():
    rng = np.random.default_rng(2)
    part = rng.integers(0, 3, 300)
    words = np.concatenate([part, rng.integers(0, 3, 100), part])
    hashes, size = periods._mixed(words.astype(np.uint64)), 1
    while size < 16:
        hashes, size = periods._doubled(hashes, size), size * 2
    chosen = set(periods.synchronising(hashes, 16, np.zeros((0, 2), np.int64)).tolist())
    inner = range(300 - 2 * 16 + 1)
    assert {i for i in inner if i in chosen} == {i for i in inner if i + 400 in chosen}
    assert all(any(i + k in chosen for k in range(16)) for i in range(0, 600, 16))


def test_documents(spark):
    """The registered query on its whole table."""
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    small = {d: t for d, t in docs if len(t) < 6000}
    got = {r["doc_id"]: tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs) and len(small) > 0.9 * len(docs)
    # By definition it is quadratic: long texts are compared at each distance as arrays.
    for d, t in docs:
        if d in small:
            assert got[d] == row(d, t, True)
        else:
            words = periods.numbered(periods.planted(t.encode().split(), d))
            found = {}
            for q in range(1, len(words) // 3 + 1):
                for s, e in periods._stretches(words, q, max(24, 3 * q)).tolist():
                    found.setdefault((s, e - s), q)
            listed = "".join(f"{s},{length},{q}\n" for s, length, q in sorted((s, length, q) for (s, length), q in found.items()))
            assert got[d][6] == hashlib.sha256(listed.encode()).hexdigest()


def test_rows(spark, odd, none):
    ship(spark)
    got = sorted(map(tuple, periods.digests(odd, plant=True).collect()), key=repr)
    assert got == sorted((row(d, t, True) for d, t, _ in ROWS), key=repr)
    assert periods.digests(none).count() == 0 and periods.collapse(none).count() == 0
    out = periods.collapse(odd.withColumn("runs", F.lit("taken")))
    assert sorted(out.columns) == sorted([*odd.columns, "runs"]) and out.count() == len(ROWS)


def test_collapse(spark):
    ship(spark)
    text = "x " + "a b c " * 20 + "y " + "z " * 30
    (r,) = periods.collapse(texts(spark, [(1, text)])).collect()
    assert r["text"] == "x a b c y z" and [tuple(x) for x in r["runs"]] == [(1, 60, 3), (62, 30, 1)]


def test_very_long_text():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1000, 600_000)
    words[100_000:400_000] = np.resize(words[:90_000], 300_000)
    assert periods.runs(words).tolist() == [[100_000, 300_000, 90_000]]
