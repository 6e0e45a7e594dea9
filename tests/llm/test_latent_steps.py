"""Steps that work on many texts or terms at once do what they do one by one."""

from __future__ import annotations

import random
import tracemalloc
import zlib

import numpy as np

from stepview.llm import latent


def test_checksums(monkeypatch):
    rng = random.Random(1)
    odd = [None, "", " ", "a", "  a  b ", "é\ud800x", "x" * 33 + " " + "y" * 32 + " " + "z" * 5000, "A.B_c-d9\n\t€uro İ ß", "\0 \0\0a a\0", None]
    odd += ["".join(rng.choices("ab _.\0ü", k=rng.randrange(200))) for _ in range(200)]
    wanted = [[zlib.crc32(w) for w in (t or "").lower().encode("utf-8", "replace").translate(latent._LETTERS).split()] for t in odd]
    for piece in (1, 7, 100, latent.PIECE):
        monkeypatch.setattr(latent, "PIECE", piece)
        assert [w.tolist() for w in latent.words_of_all(odd)] == wanted
        assert [latent.words_of(t).tolist() for t in odd] == wanted
    assert latent.words_of_all([]) == []


def test_scatter(monkeypatch):
    rng = np.random.default_rng(2)
    for n, dense in ((0, 256), (1, 256), (300, 256), (300, 2)):
        monkeypatch.setattr(latent, "DENSE", dense)
        rows = (rng.zipf(1.3, (n, latent.PASSAGE)) % latent.TERMS).astype(np.int32)
        rows[n // 2 :, 5:] = latent.TERMS
        projected = rng.integers(-9, 10, (n, 3)).astype(np.float32)
        wanted = np.zeros((latent.TERMS + 1, 3))
        np.add.at(wanted, rows.ravel(), np.repeat(projected, latent.PASSAGE, axis=0))
        got = np.ones((latent.TERMS + 1, 3))
        latent.scatter(got, rows, projected)
        assert np.array_equal(got[: latent.TERMS] - 1, wanted[: latent.TERMS])


def test_no_pair_is_left_out_that_could_hold(monkeypatch):
    rng = random.Random(3)
    some = [latent.words_of(" ".join(rng.choices("abcdefghijklmnop", k=rng.randrange(1, 12)))) for _ in range(40)]
    texts = [latent.words_of(" ".join(rng.choices("abcdefghijklmnop", k=rng.randrange(0, 30)))) for _ in range(60)]
    pairs = np.array([(t, j) for t in range(len(texts)) for j in range(len(some))])
    rng.shuffle(order := list(range(len(pairs))))
    pairs = pairs[order]
    wanted = [len(some[j]) - len(set(some[j].tolist()).difference(texts[t].tolist())) >= latent.SHARE * len(some[j]) for t, j in pairs.tolist()]
    ends = np.cumsum([len(t) for t in texts])
    for marks, windows, bits in ((latent.MARKS, latent.WINDOWS, latent.MARKED), (40, 3, latent.MARKED), (40, 3, 2)):
        for name, value in (("MARKS", marks), ("WINDOWS", windows), ("MARKED", bits)):
            monkeypatch.setattr(latent, name, value)
        got = latent.Items(list(range(40)), some, np.zeros((40, 1), np.float32)).may_hold(np.concatenate(texts), ends, *pairs.T)
        assert not (np.array(wanted) & ~got).any()
        assert bits == 2 or got.tolist() == wanted


def dense_space(texts, rank, seed):
    """All of it in one place, as matrices."""
    rows = np.concatenate([latent.padded(w % latent.TERMS, latent.PASSAGE) for w in texts])
    x = np.zeros((len(rows), latent.TERMS + 1))
    np.add.at(x, (np.arange(len(rows))[:, None], rows), 1)
    x = x[:, :-1]
    weight = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0)))
    thin = np.linalg.qr(np.random.default_rng(seed).standard_normal((latent.TERMS, rank + latent.EXTRA)))[0]
    image = (x * weight).T @ (x * weight @ thin)
    shift = np.linalg.norm(image) * 1e-7 + 1e-12
    image = image + shift * thin
    small = thin.T @ image
    vectors, values, _ = np.linalg.svd(np.linalg.solve(np.linalg.cholesky((small + small.T) / 2), image.T).T, full_matrices=False)
    values = np.maximum(values**2 - shift, 0)
    keep = np.flatnonzero(values > values[0] * 1e-5)[:rank]
    keep = keep[min(latent.COMMON, len(keep) // 16) :]
    return vectors[:, keep] / np.sqrt(values[keep]) * weight[:, None]


def test_space_is_that_of_whole_matrices_and_none_of_them_is_in_the_driver(spark):
    rng = np.random.default_rng(5)
    texts = [(rng.zipf(1.4, rng.integers(1, 200)) % 3000).astype("<u4") for _ in range(300)]
    words = spark.createDataFrame([(i, bytearray(w.tobytes())) for i, w in enumerate(texts)], "doc_id bigint, words binary").repartition(3)
    tracemalloc.start()
    got = latent.fit(words).place
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2 * got.nbytes + (8 << 20)
    wanted = dense_space(texts, latent.RANK, 0)
    assert got.shape == (latent.TERMS + 1, wanted.shape[1]) and not got[-1].any()
    one, two = got[:3000] @ got[:3000].T, wanted[:3000] @ wanted[:3000].T
    assert np.abs(one - two).max() < 2e-3 * np.abs(two).max()
    none = latent.fit(words.limit(0)).place
    assert none.shape[0] == latent.TERMS + 1 and np.isfinite(none).all() and not none.any()
