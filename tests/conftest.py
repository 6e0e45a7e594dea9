from __future__ import annotations

import os
import struct
import sys
import zlib

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def write_png(path, rows, channels):
    """A PNG of rows of pixel tuples: gray, gray+alpha, RGB or RGBA."""
    data = b"".join(b"\0" + b"".join(bytes(p) for p in row) for row in rows)

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    body = chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + body)


def boxed(width, height, box, inside, outside):
    x0, y0, x1, y1 = box
    return [[inside if x0 <= x < x1 and y0 <= y < y1 else outside for x in range(width)] for y in range(height)]


FILES = """
1_load/S1.set 1_load/S10.set 1_load/sub-01.set 1_load/.set 1_load/S1.SET 1_load/S1.set.bak 1_load/..set
2_filter/S1.set 2_alt/S1.set 4_ica/S1.set 10_clean/S10.set 4_ica/deep/S1.set
1_load/.S1-raw.fif 2_filter/.S1-epo.fif 4_ica/.S1-raw.fif 4_ica/.S1-epo.fif 1_load/notes.txt
5file 99999999999999999999_big/S1.set 12abc_x/S1.set other/S1.set
logs/a/S1.log logs/S10_run.log logs/S2.log logs/_S1.log
""".split()
IMAGES = """
ICA/set1/S1-badChan-scalp.png ICA/set1/S1-chs1-32.png ICA/set1/S1-chs33-64.png ICA/set1/S1-chs5-9.png
ICA/set1/S1-hist.png ICA/set1/deep/S1-hist.png ICA/set2/S1-chs1-32.png ICA/set10/S1-hist.png
ICA/set1/sub-01-badChan-scalp.png ICA/misc/S1-x.png S1-loose.png ICA/set1/S10-badChan-scalp.png
ICA/set1/deep/S1-badChan-scalp.png
""".split()


@pytest.fixture(scope="session")
def tree(tmp_path_factory):
    """A source with one case per rule of the layout."""
    root = tmp_path_factory.mktemp("tree") / "site one+%41"
    for name in FILES:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"text of {name}\r\nsecond line\n")
    for name in ("3_empty", "½_half", "٣_arabic", "7", "8 _blank"):
        (root / name).mkdir()
    for i, name in enumerate(IMAGES):
        path = root / "quality_control" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        write_png(path, boxed(9, 7, (2, 1, 5 + i % 3, 4), (200, 10, 30), (255, 255, 255)), 3)
    base = 1_700_000_000
    for name, offset in {
        "1_load/S1.set": 0, "1_load/.S1-raw.fif": 0,  # as old: fresh
        "2_filter/S1.set": 10, "2_filter/.S1-epo.fif": 9,  # older: stale
        "4_ica/S1.set": 5, "4_ica/.S1-raw.fif": 4, "4_ica/.S1-epo.fif": 6,  # raw stale, epochs fresh
    }.items():
        os.utime(root / name, (base + offset, base + offset))
    return root
