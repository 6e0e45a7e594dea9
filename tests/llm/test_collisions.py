"""Near-duplicates by signature coordinates against brute-force Jaccard over all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from stepview.llm import collisions, queries, simhash
from stepview.llm.shared import ship, table

from .conftest import ROWS, texts


def plain_set(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_force(docs, percent):
    """Size of the set and least key reachable of each (key, text)."""
    found = {d: plain_set(t) for d, t in docs}
    at, root = {}, {d: d for d in found}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for d in sorted(found):
        shared = {}
        for s in found[d]:
            for e in at.setdefault(s, []):
                shared[e] = shared.get(e, 0) + 1
            at[s].append(d)
        for e, n in shared.items():
            if 100 * n >= percent * (len(found[d]) + len(found[e]) - n):
                a, b = sorted((top(d), top(e)))
                root[b] = a
    return {d: (len(found[d]), top(d)) for d in found}


def survivors(docs, percent):
    """Keys that stay; of texts without words one stays."""
    roots = brute_force(docs, percent)
    empty = sorted(d for d, (n, _) in roots.items() if not n)
    return {d for d, (_, r) in roots.items() if d == r} - set(empty[1:])


def answers(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def planted(seed=5):
    """Groups of copies with 0 to 3 of 120 words changed: similarities from 0.7 to 1, chains in which only neighbours are alike."""
    rng, out = random.Random(seed), []
    for group in range(40):
        base = [rng.choice("abcdefghij") + str(rng.randrange(900)) for _ in range(120)]
        for k in range(6):
            copy = list(base)
            if group % 3 == 0:
                copy[20 * k : 20 * k + 1] = [f"step{k}"]
                base = copy
            else:
                for _ in range(rng.randint(0, 3)):
                    copy[rng.randrange(120)] = f"new{rng.randrange(900)}"
            out.append((len(out), " ".join(copy)))
    return out


@pytest.mark.parametrize("percent,block", [(85, 1024), (80, 2)])
def test_planted_copies(spark, monkeypatch, percent, block):
    monkeypatch.setattr(collisions, "BLOCK", block)
    ship(spark)
    docs = planted()
    want = brute_force(docs, percent)
    assert answers(collisions.near_duplicates(texts(spark, docs), percent=percent)) == want
    assert 40 <= len({r for _, r in want.values()}) < 0.6 * len(docs)


def test_star_whose_copies_are_unlike(spark):
    """Each copy is like the text they were made of, and like none of the others: one component, whatever the order of keys."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for k in range(60):
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(5, 195)] = f"x{rng.randrange(10**6)}"
        docs.append((k, " ".join(copy)))
    docs.append((60, " ".join(base)))
    want = brute_force(docs, 85)
    assert answers(collisions.near_duplicates(texts(spark, docs))) == want and want[60][1] == 0
    assert len({r for _, r in brute_force(docs[:-1], 85).values()}) > 20


def test_documents(spark):
    """The registered query on its whole table."""
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = queries.QUERIES["op13_coordinate_collisions"](spark, SF)
    want = brute_force(docs, 85)
    assert answers(got) == want
    assert {r["doc_id"] for r in got.where("kept").collect()} == {d for d, (_, r) in want.items() if d == r}


def test_stage_on_documents(spark):
    docs = table(spark, SF, "documents")
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    want = survivors([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 80)
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == want


def test_stage_links_by_anchors(spark, monkeypatch):
    """The pipeline's stage links what is within four bits by SimHash anchors, confirms it on whole sets and loses no other link."""
    rng = random.Random(7)
    docs = []
    for _ in range(8):
        base = [f"w{rng.randrange(9000)}" for _ in range(400)]
        for changes in (0, 1, 2, 30):
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(400)] = f"x{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(copy)))
    asked, confirmed, pairs, verified = [], [], collisions.anchored_pairs, collisions.verified

    def spied(nodes):
        found = pairs(nodes)
        prints = {r["fp"]: r["print"] % (1 << 64) for r in nodes.collect()}
        asked.append((prints, [tuple(r) for r in found.select("a", "b").collect()]))
        return found

    def checked(tried, *rest):
        held = verified(tried, *rest)
        confirmed.append([{frozenset(r) for r in x.select("a", "b").collect()} for x in (tried, held)])
        return held

    monkeypatch.setattr(collisions, "anchored_pairs", spied)
    monkeypatch.setattr(collisions, "verified", checked)
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, texts(spark, docs), "").collect()}
    assert got == survivors(docs, 80)
    ((prints, found),) = asked
    found = {frozenset(x) for x in found}
    near = {frozenset((a, b)) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= simhash.REACH}
    assert len(near) >= 8 and found <= near

    def parts(edges):
        of = {a: {a} for a in prints}
        for a, b in map(tuple, edges):
            both = of[a] | of[b]
            of.update(dict.fromkeys(both, both))
        return {frozenset(x) for x in of.values()}

    assert parts(found) == parts(near)
    # Each is decided on whole sets, or its nodes are in one component without it.
    (first, sure), (second, _) = confirmed[:2]
    assert first & found and all(x in first | second or any(x <= p for p in parts(sure)) for x in found)


def test_equal_prints_of_different_sets_are_pairs(spark):
    rows = [(1, 5), (2, 5), (3, 5), (4, 7), (5, -1)]
    found = collisions.anchored_pairs(spark.createDataFrame(rows, "fp bigint, print bigint"))
    assert {tuple(r) for r in found.where("4 not in (a, b)").collect()} == {(1, 2), (1, 3)}
    assert {frozenset(r) for r in found.where("4 in (a, b)").collect()} == {frozenset((1, 4))}


def test_rows(spark, odd, none):
    ship(spark)
    out = collisions.near_duplicates(odd).collect()
    assert len(out) == len(ROWS) and collisions.near_duplicates(none).count() == 0
    for r in out:
        size = len(plain_set(next(t for d, t, _ in ROWS if d == r["doc_id"] and (d is not None or t is None or r["n_shingles"]))))
        assert r["n_shingles"] == size
    same = [r for r in out if r["doc_id"] in (5, 6) or (r["doc_id"] is None and r["n_shingles"])]
    assert {r["component_id"] for r in same} == {5} and [r["kept"] for r in same if r["doc_id"] == 5] == [True]
    # Without words: linked with nothing.
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in out if not r["n_shingles"])
    stage = corpus_pipeline.near_duplicates(spark, odd, "")
    assert stage.columns == odd.columns and collisions.kept(none).count() == 0
    assert stage.count() == len({frozenset(plain_set(t)) for _, t, _ in ROWS})
    assert {5} == {r["doc_id"] for r in stage.where(F.col("text") == "Same text twice").collect()}


def test_least_matches():
    """The binomial tail below the threshold, and what random sets give."""
    assert collisions.least_matches(100) == collisions.COORDINATES
    assert 30 <= collisions.least_matches(80) < collisions.least_matches(85) < 0.85 * 64
    rng = np.random.default_rng(1)
    for percent in (80, 85):
        fewest = 64
        for _ in range(300):
            every = rng.integers(0, 1 << 63, 400, np.uint64) * np.uint64(2) + rng.integers(0, 2, 400, np.uint64)
            odd = 400 * (100 - percent) // 200
            one, two = collisions.signature(every[odd:]), collisions.signature(every[: 400 - odd])
            fewest = min(fewest, int((one == two).sum()))
        assert fewest >= collisions.least_matches(percent)
