"""The generated source tree: catalogue, logs, images, freshness."""

import base64
import zlib
from pathlib import Path

import pytest
from conftest import IMAGES, boxed, write_png
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stepview.operators import catalog, freshness, images, logs, qc
from stepview.sources import registry, tree as trees

PEOPLE = ["S1", "S10", "sub-01"]


@pytest.fixture(scope="module")
def manifest(spark, tree):
    return trees.manifest(registry.registry(spark, {"one": tree, "gone": "/no/such/folder"})).cache()


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([("one", p) for p in PEOPLE], "source string, participant string")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_manifest_lists_empty_and_hidden(manifest, tree):
    found = {r.rel_path: r for r in manifest.collect()}
    assert found["3_empty"].is_dir and found["1_load/.S1-raw.fif"].size > 0
    assert "logs/a/S1.log" in found and "quality_control/ICA/set1/deep/S1-hist.png" in found
    assert "other" in found and "other/S1.set" not in found and "4_ica/deep/S1.set" not in found
    one = found["1_load/S1.set"]
    assert (one.source, one.name, one.stem, one.suffix, one.parent) == ("one", "S1.set", "S1", ".set", "1_load")
    assert one.path == str(tree / "1_load/S1.set") and list(one.parts) == ["1_load", "S1.set"]


def test_shallow_manifest_stops_at_steps(spark, tree):
    shallow = trees.manifest(registry.registry(spark, {"one": tree}), shallow=True)
    found = {r.rel_path for r in shallow.collect()}
    assert "2_alt/S1.set" in found and "logs" in found and not any(p.startswith(("logs/", "quality")) and "/" in p for p in found)


def test_manifest_times_are_exact(manifest):
    times = {r.rel_path: r.t for r in manifest.select("rel_path", F.unix_micros("mtime").alias("t")).collect()}
    assert times["2_filter/S1.set"] - times["2_filter/.S1-epo.fif"] == 1_000_000


def test_participants(manifest):
    got = [tuple(r) for r in catalog.participants(catalog.step_files(manifest)).collect()]
    # S1 has two directories for step 2, both count; .set and S1.SET are no recordings.
    assert got == [("one", "S1", 4), ("one", "S10", 2), ("one", "sub-01", 1)]


def test_steps_keep_empty_and_duplicate_numbers(manifest):
    got = [(r.step_num, r.step_dir) for r in catalog.steps(catalog.step_dirs(manifest)).collect()]
    assert got == [
        (1, "1_load"), (2, "2_alt"), (2, "2_filter"), (3, "3_empty"), (4, "4_ica"),
        (7, "7"), (8, "8 _blank"), (10, "10_clean"),
    ]


def test_step_rejects(manifest):
    top = manifest.where(~F.contains("rel_path", F.lit("/")))
    assert rows(catalog.step_rejects(top), "name", "reason") == sorted([
        ("12abc_x", "not_a_number"), ("5file", "not_a_directory"), ("½_half", "not_ascii"),
        ("٣_arabic", "not_ascii"), ("99999999999999999999_big", "number_too_large"),
    ])


def test_steps_of_one_and_all(manifest):
    files, dirs = catalog.step_files(manifest), catalog.step_dirs(manifest)
    one = [r.step_dir for r in catalog.steps_of(dirs, files, "S1").collect()]
    assert one == ["1_load", "2_alt", "2_filter", "4_ica"]
    everyone = catalog.steps_for_participants(files).where("participant = 'S1'").orderBy("pos")
    assert [(r.step_dir, r.pos) for r in everyone.collect()] == list(zip(one, range(1, 5)))


def test_previous_is_number_minus_one(manifest):
    files = catalog.step_files(manifest)
    got = rows(catalog.with_previous(files).where("participant = 'S1'"), "step_num", "has_prev")
    assert got == [(1, False), (2, True), (4, False)]  # step 3 is there, but without S1
    resolved = {r.step_num: (r.step_dir, r.prev_dir) for r in catalog.resolved_steps(files).where("participant = 'S1'").collect()}
    assert resolved == {1: ("1_load", None), 2: ("2_filter", "1_load"), 4: ("4_ica", None)}
    assert rows(catalog.latest_dirs(files).where("participant = 'S1'"), "step_dir") == [("1_load",), ("2_filter",), ("4_ica",)]


def test_step_lookup(spark, manifest):
    files = catalog.step_files(manifest)
    asked = [
        (1, "one", "S1", "2", "onionskin", "ok", True, True),
        (2, "one", "S1", "2", None, "ok", True, False),
        (3, "one", "S1", "1", "onionskin", "ok", False, False),
        (4, "one", "S1", "3", None, "no_step", False, False),
        (5, "one", "S1", "two", None, "bad_step", False, False),
        (6, "one", "S1", "", None, "unselected", False, False),
        (7, "one", "nobody", "1", None, "no_step", False, False),
        (8, "one", "S1", "4", None, "no_file", False, False),
    ]
    requests = spark.createDataFrame(
        [a[:5] for a in asked], "request long, source string, participant string, step_text string, overlay_text string"
    )
    present = files.where("step_dir <> '4_ica'")
    got = rows(catalog.step_lookup(requests, files, present), "request", "status", "has_prev", "overlay")
    assert got == [(a[0], *a[5:]) for a in asked]
    # An overlay also needs the file of the step before.
    got = rows(catalog.step_lookup(requests, files, files.where("step_dir <> '1_load'")), "request", "status")
    assert got[:3] == [(1, "no_file"), (2, "ok"), (3, "no_file")]


def test_logs_by_prefix_and_their_text(manifest, people, tree):
    listed = logs.logs_for_participants(logs.log_files(manifest), people)
    assert [(r.participant, r.rel_path) for r in listed.collect()] == [
        ("S1", "logs/S10_run.log"), ("S1", "logs/a/S1.log"), ("S10", "logs/S10_run.log"),
    ]
    longest = logs.logs_for_participants(logs.log_files(manifest), people, longest=True)
    assert rows(longest, "participant", "rel_path") == [("S1", "logs/a/S1.log"), ("S10", "logs/S10_run.log")]
    texts = {r.rel_path: r.content for r in logs.read_logs(logs.log_files(manifest)).collect()}
    assert texts["logs/_S1.log"] == "text of logs/_S1.log\nsecond line\n" and len(texts) == 4


def test_requested_log_must_be_listed(spark, manifest, people):
    listed = logs.logs_for_participants(logs.log_files(manifest), people)
    asked = spark.createDataFrame(
        [("one", "S1", "logs/a/S1.log"), ("one", "S1", "../secret"), ("one", "S10", "logs/a/S1.log")],
        "source string, participant string, rel_path string",
    )
    assert rows(logs.listed_requests(asked, listed), "participant", "rel_path") == [("S1", "logs/a/S1.log")]


def brute_items(people):
    """Classification as a loop over files, by the rules of the survey."""
    import re

    out = {}
    for person in people:
        for path in IMAGES:
            name, parts = path.split("/")[-1], path.split("/")
            if not name.startswith(person) or len(parts) < 2 or not parts[1].startswith("set"):
                continue
            scalp = re.match("([^-]+)-badChan-scalp.png", name)
            chs = None if scalp else re.match("(.+)-chs([0-9]+)-([0-9]+).png", name)
            kind = "scalp" if scalp else "chs" if chs else "rest"
            stem = (scalp or chs).group(1) if scalp or chs else None
            span = (int(chs.group(2)), int(chs.group(3))) if chs else (None, None)
            out[person, path] = (parts[0], parts[1], kind, stem, *span)
    return out


def test_qc_items(manifest, people):
    items = qc.qc_items(qc.qc_files(manifest), people).collect()
    got = {(r.participant, r.rel_path): (r.root, r.set_name, r.item_kind, r.stem, r.ch_start, r.ch_end) for r in items}
    assert got == brute_items(PEOPLE)
    order = [r.rel_path for r in sorted(items, key=lambda r: r.nat_rank) if r.participant == "S1"]
    assert order.index("ICA/set2/S1-chs1-32.png") < order.index("ICA/set10/S1-hist.png")
    assert order.index("ICA/set1/S1-chs5-9.png") < order.index("ICA/set1/S1-chs33-64.png")
    assert got["sub-01", "ICA/set1/sub-01-badChan-scalp.png"][2] == "rest"


def test_qc_tree(manifest, people):
    tree_rows = qc.qc_tree(qc.classified(qc.qc_files(manifest), people))
    mine = tree_rows.where("participant = 'S1' and set_name = 'set1'").collect()
    group = [r for r in mine if r.bit == "S1"]
    # The deeper scalp image comes last in natural order.
    assert [r.rel_path for r in group if r.item_kind == "scalp"] == ["ICA/set1/deep/S1-badChan-scalp.png"]
    spans = sorted((r.pos, r.ch_start, r.ch_end) for r in group if r.item_kind == "chs")
    assert spans == [(1, 1, 32), (2, 5, 9), (3, 33, 64)]
    assert [r.rel_path for r in mine if r.is_rest] == ["ICA/set1/deep/S1-hist.png"]
    assert [r.bit for r in mine if not r.is_rest and r.bit == "S10"] == ["S10"]  # prefix semantics


def test_qc_rejects(manifest):
    assert rows(qc.qc_rejects(qc.qc_files(manifest)), "source", "reason", "n") == [
        ("one", "outside_set", 1), ("one", "too_shallow", 1),
    ]


def test_qc_defaults_and_lookup(spark, manifest, people):
    items = qc.classified(qc.qc_files(manifest), people)
    defaults = {(r.participant, r.set_name): r.bit for r in qc.qc_defaults(items).collect()}
    assert defaults["S1", "set1"] == "S1-hist.png" and defaults["S1", "set2"] == "S1"
    assert rows(qc.first_sets(qc.qc_defaults(items)), "participant", "root", "set_name", "bit") == [
        ("S1", "ICA", "set1", "S1-hist.png"), ("S10", "ICA", "set1", "S10"), ("sub-01", "ICA", "set1", "sub-01-badChan-scalp.png"),
    ]
    asked = [
        (1, "ICA", None, None, "image", 1), (2, "ICA", "set1", "S1", "eeg", 4), (3, "ICA", "set2", None, "eeg", 1),
        (4, "ICA", "set1", "none", "not_found", 0), (5, "ICA", "set77", None, "empty", 0),
        (6, None, None, None, "unselected", 0), (7, "nope", "set1", "S1", "not_found", 0), (8, "", "set1", "S1", "unselected", 0),
    ]
    requests = spark.createDataFrame(
        [(a[0], "one", "S1", *a[1:4]) for a in asked],
        "request long, source string, participant string, root string, set_name string, bit string",
    )
    answers = qc.qc_lookup(requests, items).groupBy("request", "status").agg(F.count("rel_path").alias("n"))
    assert rows(answers, "request", "status", "n") == [(a[0], a[4], a[5]) for a in asked]


def test_overview(manifest, people):
    files = catalog.step_files(manifest)
    qc_named = qc.qc_files(manifest).withColumn("name", F.substring_index("rel_path", "/", -1))
    counted = catalog.overview(people, files, qc_named, logs.log_files(manifest)).groupBy("participant", "section").count()
    got = {(r.participant, r.section): r["count"] for r in counted.collect()}
    assert got["S1", "step"] == 4 and got["S1", "log"] == 2
    assert got["S1", "qc"] == sum(p.split("/")[-1].startswith("S1") for p in IMAGES)


def test_freshness(manifest):
    found = freshness.caches(manifest)
    got = {(r.step_dir, r.participant): r.status for r in freshness.freshness(found).collect()}
    assert got["1_load", "S1"] == "fresh_raw" and got["2_filter", "S1"] == "stale"
    assert got["4_ica", "S1"] == "fresh_epochs" and got["10_clean", "S10"] == "missing" and len(got) == 7
    plan = freshness.conversion_plan(freshness.freshness(found))
    assert plan.where("status = 'Already cached'").count() == 2
    assert freshness.conversion_plan(freshness.freshness(found), clean=True).where("status = 'Caching'").count() == 7
    with pytest.raises(PySparkException):
        freshness.require_fresh(freshness.freshness(found)).collect()


def test_unreadable_copies(spark):
    df = spark.createDataFrame(
        [(1, 5, 5, None, False, None), (2, 5, 5, 6, False, True), (3, 5, 4, 6, True, False), (4, 5, 6, None, True, None)],
        "i int, base int, raw int, epo int, r boolean, e boolean",
    )
    readable = F.struct(F.col("r").alias("raw"), F.col("e").alias("epochs"))
    status = freshness.freshness_status(F.col("base"), F.col("raw"), F.col("epo"), readable)
    assert [r[0] for r in df.orderBy("i").select(status).collect()] == ["unreadable", "fresh_epochs", "unreadable", "fresh_raw"]


# ------------------------------------------------------------------- images


def decode(png):
    """Size and raw rows of a PNG without filters, as the writer makes them."""
    width, height = int.from_bytes(png[16:20], "big"), int.from_bytes(png[20:24], "big")
    channels = {0: 1, 4: 2, 2: 3, 6: 4}[png[25]]
    at = png.index(b"IDAT")
    lines = zlib.decompress(png[at + 4 : at + 4 + int.from_bytes(png[at - 4 : at], "big")])
    step = 1 + width * channels
    return [[tuple(lines[y * step + 1 + x * channels :][:channels]) for x in range(width)] for y in range(height)]


@pytest.fixture(scope="module")
def pictures(spark, tmp_path_factory):
    folder = Path(tmp_path_factory.mktemp("pictures"))
    red, white, clear, ghost = (200, 10, 30), (255, 255, 255), (9, 9, 9, 0), (1, 2, 3, 0)
    write_png(folder / "border.png", boxed(6, 5, (1, 2, 4, 4), red, white), 3)
    write_png(folder / "uniform.png", boxed(6, 5, (0, 0, 0, 0), red, white), 3)
    write_png(folder / "alpha.png", boxed(6, 5, (2, 1, 5, 3), (*red, 128), clear), 4)
    write_png(folder / "invisible.png", boxed(6, 5, (1, 1, 3, 4), ghost, clear), 4)
    write_png(folder / "opaque.png", boxed(6, 5, (1, 1, 3, 4), (*red, 255), (*white, 255)), 4)
    encoded = images.encoded_images(images.read_images(spark, [str(folder)]))
    return {r.origin.split("/")[-1]: decode(base64.b64decode(r.encoded)) for r in encoded.collect()}


def test_border_is_cropped(pictures):
    assert pictures["border.png"] == [[(200, 10, 30)] * 3] * 2


def test_uniform_image_is_kept_whole(pictures):
    assert pictures["uniform.png"] == [[(255, 255, 255)] * 6] * 5


def test_alpha_decides_first(pictures):
    assert pictures["alpha.png"] == [[(200, 10, 30, 128)] * 3] * 2
    assert len(pictures["opaque.png"]) == 5 and len(pictures["opaque.png"][0]) == 6  # no transparent pixel: whole


def test_fully_transparent_falls_back_to_colour(pictures):
    assert [len(pictures["invisible.png"]), len(pictures["invisible.png"][0])] == [3, 2]


def test_encoded_items(spark, tree, manifest, people):
    folder = tree / "quality_control"
    encoded = images.encoded_images(images.read_images(spark, [str(folder)]))
    located = images.located(encoded, qc.qc_files(manifest))
    items = qc.with_encoded(qc.classified(qc.qc_files(manifest), people), located)
    assert items.where("encoded is null").count() == 0 and items.count() == len(brute_items(PEOPLE))


def test_gray_with_alpha():
    import numpy as np

    pixels = np.zeros((4, 5, 2), dtype=np.uint8)
    pixels[1:3, 2:4] = (7, 255)
    assert images.trim_box(pixels) == (2, 1, 4, 3)
    assert decode(images.png_bytes(pixels[1:3, 2:4])) == [[(7, 255)] * 2] * 2


def test_pixel_boxes_of_many_colours(spark):
    grid = [[0, 0, 0, 0], [0, 5, 0, 0], [0, 0, 7, 0]]
    df = spark.createDataFrame([(1, x, y, v) for y, row in enumerate(grid) for x, v in enumerate(row)], "image long, x int, y int, v int")
    assert tuple(images.pixel_boxes(df).head()) == (1, 1, 1, 3, 3)


def test_group_wins_over_an_image_of_the_same_name(spark, people):
    names = ["ICA/set1/S1-a.png-chs1-2.png", "ICA/set1/S1-a.png", "ICA/set1/S1-b.png"]
    files = spark.createDataFrame([("one", n) for n in names], "source string, rel_path string")
    items = qc.classified(files, people)
    schema = "request long, source string, participant string, root string, set_name string, bit string"
    requests = spark.createDataFrame([(1, "one", "S1", "ICA", "set1", "S1-a.png"), (2, "one", "S1", "ICA", None, None)], schema)
    got = rows(qc.qc_lookup(requests, items), "request", "status", "rel_path")
    # By default the first other image is chosen, which is then found as a group.
    assert got == [(1, "eeg", names[0]), (2, "eeg", names[0])]
