"""PNG decoding in tasks: every kind of file, odd names, damaged files; contents in nested values."""

import base64
import struct
import time
import zlib

import numpy as np
import pytest
from conftest import boxed, write_png
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepview.functions import nested
from stepview.operators import images, png, qc
from stepview.plans import views
from stepview.sources import registry

rng = np.random.default_rng(4)


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def written(samples, depth, colour, extra=b"", interlaced=False):
    """A PNG file of (height, width, n) samples without filters."""
    height, width, _ = samples.shape

    def lines(part):
        out = b""
        for line in part:
            if depth == 16:
                out += b"\0" + line.astype(">u2").tobytes()
            elif depth == 8:
                out += b"\0" + line.astype(np.uint8).tobytes()
            else:
                bits = "".join(format(int(v), f"0{depth}b") for v in line[:, 0])
                bits += "0" * (-len(bits) % 8)
                out += b"\0" + int(bits, 2).to_bytes(len(bits) // 8, "big")
        return out

    steps = [p for p in png.PASSES if p[0] < width and p[1] < height] if interlaced else [(0, 0, 1, 1)]
    data = b"".join(lines(samples[y::dy, x::dx]) for x, y, dx, dy in steps)
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, int(interlaced))
    half = len(zlib.compress(data)) // 2
    packed = zlib.compress(data)
    parts = chunk(b"IDAT", packed[:half]) + chunk(b"IDAT", packed[half:])
    return png.SIGNATURE + chunk(b"IHDR", head) + extra + parts + chunk(b"IEND", b"")


@pytest.mark.parametrize("colour,depth", [(c, d) for c, depths in png.DEPTHS.items() for d in depths])
@pytest.mark.parametrize("interlaced", [False, True])
def test_kinds(colour, depth, interlaced):
    for height, width in ((1, 1), (7, 5), (9, 17)):
        samples = rng.integers(0, 1 << depth, (height, width, png.SAMPLES[colour]))
        palette = rng.integers(0, 256, (1 << min(depth, 8), 3))
        extra = chunk(b"PLTE", palette.astype(np.uint8).tobytes()) if colour == 3 else b""
        got, by_alpha = png.decode(written(samples, depth, colour, extra, interlaced))
        want = palette[samples[:, :, 0]] if colour == 3 else samples >> 8 if depth == 16 else samples * (255 // ((1 << depth) - 1))
        assert np.array_equal(got, want) and by_alpha == (colour in (4, 6))


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_filters(channels):
    for _ in range(20):
        height, width = rng.integers(1, 12, 2)
        pixels = rng.integers(0, 256, (height, width, channels)).astype(np.uint8)
        kinds = rng.integers(0, rng.integers(1, 6), height)
        assert np.array_equal(png.decode(png.encode(pixels, kinds))[0], pixels)


def test_transparent_colours():
    samples = np.array([[[0], [1]], [[2], [3]]])
    palette = chunk(b"PLTE", bytes(range(12)))
    got, by_alpha = png.decode(written(samples, 2, 3, palette + chunk(b"tRNS", b"\0\x80")))
    assert got[:, :, 3].tolist() == [[0, 128], [255, 255]] and not by_alpha
    got, by_alpha = png.decode(written(samples, 8, 0, chunk(b"tRNS", b"\0\2")))
    assert got[:, :, 1].tolist() == [[255, 255], [0, 255]] and not by_alpha
    # Such an image is trimmed by colour, as it has no alpha of its own.
    assert images.trim_box(got, by_alpha) == (0, 0, 2, 2)


@pytest.mark.parametrize(
    "damage",
    [
        lambda x: x[:40], lambda x: x[:-12], lambda x: x[:45] + b"\xff" + x[46:], lambda x: png.SIGNATURE,
        lambda x: x.replace(x[33:], chunk(b"IDAT", b"no zlib") + chunk(b"IEND", b"")),
        lambda x: x.replace(x[33:], chunk(b"IDAT", zlib.compress(b"\0")) + chunk(b"IEND", b"")),
        lambda x: x.replace(x[33:], chunk(b"IDAT", zlib.compress(b"\7" * 999)) + chunk(b"IEND", b"")),
        lambda x: png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 3, 0, 0, 0, 0)) + chunk(b"IEND", b""),
        lambda x: png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 1 << 30, 1 << 30, 8, 0, 0, 0, 0)) + chunk(b"IEND", b""),
    ],
)
def test_broken(damage):
    good = png.encode(rng.integers(0, 256, (4, 5, 3)).astype(np.uint8))
    with pytest.raises(png.Broken):
        png.decode(damage(good))


def test_listed_files(spark, tmp_path):
    for name in ("_a.png", ".b.png", "c [1]%41+é.PNG"):
        write_png(tmp_path / name, boxed(9, 7, (2, 1, 5, 4), (9, 10, 30), (255, 255, 255)), 3)
    write_png(tmp_path / "gray.png", boxed(6, 5, (2, 1, 5, 3), (7, 128), (7, 0)), 2)
    (tmp_path / "broken.png").write_bytes((tmp_path / "gray.png").read_bytes()[:50])
    (tmp_path / "note.txt").write_text("no image")
    (tmp_path / "empty.png").write_bytes(b"")
    names = ["_a.png", ".b.png", "c [1]%41+é.PNG", "gray.png", "broken.png", "note.txt", "empty.png", "none.png", "note.txt/x.png", "."]
    files = spark.createDataFrame([(n, str(tmp_path / n)) for n in names] + [("null", None)], "rel_path string, path string")
    rows = {r.rel_path: r for r in images.encoded_files(files).collect()}
    assert {n: r.status for n, r in rows.items()} == {
        "_a.png": "ok", ".b.png": "ok", "c [1]%41+é.PNG": "ok", "gray.png": "ok", "broken.png": "broken", "note.txt": "other",
        "empty.png": "other", "none.png": "missing", "note.txt/x.png": "missing", ".": "unreadable", "null": "missing",
    }
    for name in names[:3]:
        assert tuple(rows[name])[2:6] == (2, 1, 5, 4)
    assert tuple(rows["gray.png"])[2:6] == (2, 1, 5, 3)  # by alpha: the gray value is the same everywhere
    assert png.decode(rows["gray.png"].png)[0].tolist() == [[[7, 128]] * 3] * 2
    pixels = {r.rel_path: r for r in images.decoded(files).collect()}
    assert pixels["gray.png"].n_channels == 2 and pixels["gray.png"].by_alpha and pixels["none.png"].data is None
    assert pixels["_a.png"].data[3 * (9 * 1 + 2) :][:3] == bytes((30, 10, 9))  # blue first, as in Spark's own rows
    assert images.encoded_files(files.limit(0)).count() == 0


def test_batches_are_cut_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(images, "BATCH_BYTES", 100)
    content = png.encode(rng.integers(0, 256, (6, 6, 3)).astype(np.uint8))
    files = spark.createDataFrame([(i, content) for i in range(25)], "id long, content binary").coalesce(1)
    assert sorted(r.id for r in images.encoded_files(files, "content").where("status = 'ok'").collect()) == list(range(25))


def test_views_of_odd_images(spark, tmp_path):
    folder = tmp_path / "lab" / "quality_control" / "ICA" / "set1"
    folder.mkdir(parents=True)
    (tmp_path / "lab" / "1_load").mkdir()
    for person in ("_a", ".b", "A"):
        (tmp_path / "lab" / "1_load" / f"{person}.set").write_text("x")
    for name in ("_a.png", ".b.png", "A-badChan-scalp.png", "A-chs5-9.png"):
        write_png(folder / name, boxed(9, 7, (2, 1, 5, 4), (200, 10, 30), (255, 255, 255)), 3)
    write_png(folder / "A-chs1-4.png", boxed(6, 5, (2, 1, 5, 3), (7, 128), (7, 0)), 2)
    (folder / "A-broken.png").write_bytes(png.SIGNATURE + b"x")
    sources, path = registry.registry(spark, {"lab": f"{tmp_path}/lab/"}), str(tmp_path / "index")
    views.refresh(sources, path)
    for person in ("_a", ".b"):
        shown = views.peek_view(spark, path, sources, "lab", person, "ICA", "set1", f"{person}.png").collect()
        assert [r.status for r in shown] == ["image"] and base64.b64decode(shown[0].encoded).startswith(png.SIGNATURE)
    shown = views.peek_view(spark, path, sources, "lab", "A", "ICA", "set1", "A-broken.png").collect()
    assert [tuple(r) for r in shown] == [("broken", "ICA/set1/A-broken.png", None)]
    (row,) = views.peek_tree(spark, path, sources, "lab", "A", "ICA").collect()
    group = row.groups["A"]
    assert base64.b64decode(group.scalp.rel_path).startswith(png.SIGNATURE) and group.scalp.name == "A-badChan-scalp.png"
    assert [(c.ch_start, png.decode(base64.b64decode(c.rel_path))[0].shape) for c in group.chs] == [(1, (2, 3, 2)), (5, (3, 3, 3))]
    assert row.rest == {"A-broken.png": None}


NESTED = "a struct<rel_path string, other string, deep array<struct<m map<string,struct<rel_path string, n int>>>>>, rest map<string,array<string>>, n int"


def test_nested_values_of_any_depth(spark):
    rows = [
        (("p1", "p1", [({"p1": ("p2", 1), "k": (None, 2), "j": None},), None]), {"p1": ["p3", None, "gone"]}, 1, "s"),
        (None, None, 2, "s"),
        (("p1", None, []), {}, 3, None),
    ]
    df = spark.createDataFrame(rows, f"{NESTED}, source string")
    encoded = spark.createDataFrame([("s", f"p{i}", f"E{i}") for i in range(1, 4)], "source string, rel_path string, encoded string")
    out = {r.n: r for r in qc.encode_nested(df, ["a", "rest"], encoded, ["source"]).collect()}
    assert out[1].asDict(True) == {
        "a": {"rel_path": "E1", "other": "p1", "deep": [{"m": {"p1": {"rel_path": "E2", "n": 1}, "k": {"rel_path": None, "n": 2}, "j": None}}, None]},
        "rest": {"p1": ["E3", None, None]}, "n": 1, "source": "s",
    }
    assert out[2].a is None and out[2].rest is None and out[3].a.rel_path is None  # no source, so no content
    kind = df.select("a", "rest").schema
    found = df.select("n", nested.texts(F.struct("a", "rest"), kind, ("rel_path", "rest")).alias("t")).collect()
    assert {r.n: sorted(r.t) for r in found} == {1: ["gone", "p1", "p2", "p3"], 2: [], 3: ["p1"]}
    assert nested.texts(F.lit(None), T.StructType([T.StructField("x", T.LongType())]), ("x",)) is None


def test_many_texts_in_one_row_and_many_rows(spark):
    """100,000 texts of one row are looked up in time that grows with their number, not its square; 600 rows are cut in slices."""
    encoded = spark.range(100_000).select(F.lit("s").alias("source"), F.concat(F.lit("p"), F.col("id")).alias("rel_path"), F.concat(F.lit("E"), F.col("id")).alias("encoded"))
    pairs = encoded.select(F.struct(F.concat(F.lit("k"), F.substring("rel_path", 2, 9)), "rel_path").alias("e"))
    one = pairs.agg(F.map_from_entries(F.collect_list("e")).alias("rest")).withColumn("source", F.lit("s"))
    begun = time.perf_counter()
    out = qc.encode_nested(one, ["rest"], encoded, ["source"]).select(F.explode("rest")).where("value = concat('E', substring(key, 2))")
    assert out.count() == 100_000 and time.perf_counter() - begun < 20
    many = spark.range(600).selectExpr("id", "'s' AS source", "CASE WHEN id % 7 > 0 THEN map(concat('k', id), CASE WHEN id % 3 > 0 THEN concat('p', id) END) END AS rest").coalesce(1)
    got = {r.id: r.rest for r in qc.encode_nested(many, ["rest"], encoded, ["source"]).collect()}
    assert got == {i: {f"k{i}": f"E{i}" if i % 3 else None} if i % 7 else None for i in range(600)}
