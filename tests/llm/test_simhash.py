"""Fingerprints, anchors, links and components against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from stepview.llm import simhash

from .conftest import ROWS, texts


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(prints):
    """Least index reachable over links, for each fingerprint."""
    root = list(range(len(prints)))
    again = True
    while again:
        again = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= simhash.REACH and root[j] < root[i]:
                    root[i], again = root[j], True
    return root


def test_fingerprints():
    for text in ["", None, "one", "one two three", "One two THREE four", "a b c d e a b c d e", "É é straße x\x0by", *(t for _, t, _ in ROWS if t and len(t) < 500)]:
        assert simhash.fingerprint(text and text.encode()) == plain_fingerprint(text), text


def test_anchors_cover_all_words():
    """Every word of a sample is within three bits of its code word, and code words are their own anchors."""
    words = np.random.default_rng(1).integers(0, 1 << 23, 20_000).astype(np.uint32)
    rest, errors = simhash.golay()
    assert len(np.unique(errors)) == 1 << 11
    syndrome = (words & np.uint32(0x7FF)) ^ rest[words >> np.uint32(11)]
    code = words ^ errors[syndrome]
    assert np.bitwise_count(words ^ code).max() == 3
    assert ((code & np.uint32(0x7FF)) == rest[code >> np.uint32(11)]).all()


def test_close_fingerprints_meet_at_an_anchor():
    rng = random.Random(2)
    a = [rng.getrandbits(64) for _ in range(3000)]
    b = [x ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for x in a]
    keys = []
    for side in (a, b):
        rows, key = simhash.visits(np.array(side, np.uint64))
        found = [set() for _ in side]
        for r, k in zip(rows.tolist(), key.tolist(), strict=True):
            found[r].add(k)
        keys.append(found)
    assert all(x & y for x, y in zip(*keys, strict=True))


def clusters():
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(30)]
    return [c ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(12)]


def roots_of(spark, prints):
    distinct = spark.createDataFrame([(x - (x >> 63 << 64),) for x in sorted(set(prints))], "fp bigint")
    edges = simhash.links(distinct)
    return {r["node"]: r["root"] for r in simhash.components(edges).collect()}


def check(spark, prints):
    got = roots_of(spark, prints)
    want = joined(prints)
    groups = {}
    for x, r in zip(prints, want, strict=True):
        signed = x - (x >> 63 << 64)
        groups.setdefault(r, set()).add(got.get(signed, signed))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_random_clusters(spark):
    check(spark, clusters())


def test_large_groups_at_an_anchor_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 5)
    monkeypatch.setattr(simhash, "BLOCK", 3)
    check(spark, clusters())


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(chain + star + [(5, 5), (1, 0)], "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}
    assert simhash.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_stars_take_no_round(spark, monkeypatch):
    rounds = []
    star = simhash._star
    monkeypatch.setattr(simhash, "_star", lambda edges, large: rounds.append(large) or star(edges, large))
    stars = [(1, 1 + i) for i in range(1, 9)] + [(20, 30), (31, 20), (7, 1)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(stars, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 10)}, 20: 20, 30: 20, 31: 20} and not rounds
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame([*stars, (31, 9)], "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 10)}, 20: 1, 30: 1, 31: 1} and rounds


def test_rows(spark, odd, none):
    got = sorted(map(tuple, simhash.near_duplicates(odd).collect()), key=repr)
    prints = [plain_fingerprint(t) for _, t, _ in ROWS]
    root = joined(prints)
    least = {}
    for (d, _, _), r in zip(ROWS, root, strict=True):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    want = [(d, f"{p:016x}", least.get(r)) for (d, _, _), p, r in zip(ROWS, prints, root, strict=True)]
    assert got == sorted(want, key=repr)
    assert simhash.near_duplicates(none).count() == 0


def test_one_row_of_each_component_stays(spark, odd, none):
    out = simhash.kept(odd)
    assert out.columns == odd.columns and simhash.kept(none).count() == 0
    roots = joined([plain_fingerprint(t) for _, t, _ in ROWS])
    assert out.count() == len(set(roots))
    assert {5} == {r["doc_id"] for r in out.where(F.col("text") == "Same text twice").collect()}
    same = texts(spark, [(1, "a b c d"), (1, "a b c d"), (1, "quite another text here"), (None, "only null ids"), (None, "only null ids")])
    assert sorted(r["text"] for r in simhash.kept(same).collect()) == ["a b c d", "only null ids", "quite another text here"]
