"""Views of one participant on a refreshed set of tables."""

import base64

import pytest
from conftest import IMAGES, boxed, write_png
from pyspark.sql import functions as F

from stepview.plans import views
from stepview.sources import registry, store


@pytest.fixture(scope="module")
def index(spark, tree, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    sources = registry.registry(spark, {"one": tree})
    views.refresh(sources, path)
    return path, sources


def test_lists(spark, index):
    path, _ = index
    assert [tuple(r)[:2] for r in views.participant_list(spark, path, "one").select("participant", "n_files").collect()][0] == ("S1", 4)
    shown = [tuple(r) for r in views.overview(spark, path, "one", "S1").collect()]
    assert [i for s, i in shown if s == "step"] == ["1_load", "2_alt", "2_filter", "4_ica"]
    assert [i for s, i in shown if s == "log"] == ["logs/S10_run.log", "logs/a/S1.log"]
    images = [i for s, i in shown if s == "qc"]
    assert images.index("ICA/set2/S1-chs1-32.png") < images.index("ICA/set10/S1-hist.png")
    assert len(images) == sum(p.split("/")[-1].startswith("S1") and p.startswith("ICA/set") for p in IMAGES)


def test_log(spark, index):
    path, _ = index
    assert views.log_view(spark, path, "one", "S1", "logs/a/S1.log").head().content.startswith("text of logs/a/S1.log\n")
    assert views.log_view(spark, path, "one", "S1", "logs/S2.log").count() == 0


def test_peek(spark, index):
    path, sources = index
    shown = views.peek_view(spark, path, sources, "one", "S1", "ICA", "set1", "S1").collect()
    assert len(shown) == 4 and all(base64.b64decode(r.encoded).startswith(b"\x89PNG") for r in shown)
    default = views.peek_view(spark, path, sources, "one", "S1", "ICA").collect()
    assert [(r.status, r.rel_path) for r in default] == [("image", "ICA/set1/deep/S1-hist.png")]
    nothing = views.peek_view(spark, path, sources, "one", "S1", "ICA", "set1", "no").collect()
    assert [(r.status, r.encoded) for r in nothing] == [("not_found", None)]


@pytest.fixture(scope="module")
def signal_store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("signals"))
    dirs = [(1, "1_a"), (2, "2_a"), (2, "2_b"), (4, "4_c")]
    recs = spark.createDataFrame([("s", "P1", n, d, "raw") for n, d in dirs], "source string, participant string, step_num long, step_dir string, kind string")
    recs = recs.withColumn("mtime", F.timestamp_seconds(F.lit(1)))
    recs = recs.withColumn("sfreq", F.lit(4.0)).withColumn("first_time", F.lit(0.5))
    mark = F.when(F.col("step_dir") == "2_a", 1000).otherwise(F.col("step_num") * 10)
    blocks = (
        recs.withColumn("ch_idx", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("start_sample", F.explode(F.array(*[F.lit(10 * i).cast("bigint") for i in range(3)])))
        .withColumn("samples", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (mark + F.col("ch_idx") + (i + F.col("start_sample")) / 100).cast("float")))
        .withColumn("ch_name", F.concat(F.lit("c"), F.col("ch_idx").cast("string")))
        .withColumn("ch_type", F.when(F.col("ch_idx") == 0, "eeg").otherwise("misc"))
        .withColumn("epoch_idx", F.lit(None).cast("bigint"))
    )
    store.convert(recs, blocks, path)
    return path


def test_signal_view(spark, signal_store):
    shown = views.signal_view(spark, signal_store, "s", "P1", 2, 5, 25, onionskin=True, decim=4).collect()
    assert [r.sample_idx for r in shown if r.ch_idx == 0] == list(range(5, 25, 4))
    assert [r.sample_idx for r in shown if r.ch_idx == 1] == list(range(5, 25))
    for r in shown:
        assert r.t == r.sample_idx / 4 + 0.5
        assert r.y == pytest.approx(r.ch_idx - (20 + r.ch_idx + r.sample_idx / 100), abs=1e-4)
        assert r.prev_y == pytest.approx(r.ch_idx - (10 + r.ch_idx + r.sample_idx / 100), abs=1e-4)


def test_signal_view_without_predecessor(spark, signal_store):
    shown = views.signal_view(spark, signal_store, "s", "P1", 4, 0, onionskin=True, picks=["c1"]).collect()
    assert len(shown) == 30 and all(r.prev_y is None and r.ch_name == "c1" for r in shown)


def test_signal_view_modes(spark, signal_store):
    clamped = views.signal_view(spark, signal_store, "s", "P1", 1, 0, yaxis="clip", y_limits=(1.5, -0.5)).collect()
    assert {r.y for r in clamped} == {-0.5, 0.5}
    scaled = views.signal_view(spark, signal_store, "s", "P1", 1, 0, yaxis="normalize").collect()
    # Samples rise by 0.01: quartiles of 30 lie 14.5 steps apart.
    first = [r.y for r in scaled if r.ch_idx == 0]
    assert first[0] - first[-1] == pytest.approx(29 / 14.5, rel=1e-3)


@pytest.fixture(scope="module")
def epoch_store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("epochs"))
    schema = "source string, participant string, step_num long, step_dir string, kind string, sfreq double"
    recs = spark.createDataFrame([("s", "P1", n, f"{n}_a", "epochs" if n < 3 else "raw", 2.0) for n in (1, 2, 3)], schema)
    recs = recs.withColumn("mtime", F.timestamp_seconds(F.lit(1)))
    blocks = (
        recs.withColumn("epoch_idx", F.explode(F.sequence(F.lit(0), F.lit(5)).cast("array<bigint>")))
        .withColumn("samples", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.col("step_num") * 100 + F.col("epoch_idx") * 10 + i).cast("float")))
        .withColumns({"ch_idx": F.lit(0), "ch_name": F.lit("c0"), "ch_type": F.lit("eeg"), "start_sample": F.lit(0).cast("bigint")})
    )
    store.convert(recs, blocks, path)
    return path


def test_epoch_view(spark, epoch_store):
    shown = views.epoch_view(spark, epoch_store, "s", "P1", 2, t_start=4.0, n_epochs=2, onionskin=True).collect()
    # Epochs last 2 s: the view starts with the third one.
    assert [(r.epoch_idx, r.sample_idx) for r in shown] == [(e, i) for e in (2, 3) for i in range(4)]
    assert [r.t for r in shown] == [4 + i / 2 for i in range(8)]
    assert all(r.y == -(200 + r.epoch_idx * 10 + r.sample_idx) and r.prev_y == r.y + 100 for r in shown)


def test_epoch_view_of_some_channels_decimated(spark, epoch_store):
    shown = views.epoch_view(spark, epoch_store, "s", "P1", 2, t_start=4.0, n_epochs=2, onionskin=True, decim=3, picks=["c0"]).collect()
    # Every third sample of the two epochs end to end.
    assert [(r.epoch_idx, r.sample_idx) for r in shown] == [(2 + i // 4, i % 4) for i in range(0, 8, 3)]
    assert all(r.prev_y == r.y + 100 for r in shown)
    assert len(views.epoch_view(spark, epoch_store, "s", "P1", 2, 4.0, 2, decim=3, data_types=("meg",)).collect()) == 8
    assert views.epoch_view(spark, epoch_store, "s", "P1", 2, 4.0, 2, picks=["none"]).count() == 0


def test_butterfly_has_a_narrower_band(spark, epoch_store, signal_store):
    for butterfly, edge in ((False, 0.5), (True, 0.2)):
        shown = views.signal_view(spark, signal_store, "s", "P1", 2, 5, 9, onionskin=True, y_limits=(9.0, -9.0), butterfly=butterfly).collect()
        assert {round(r.prev_y - r.ch_idx, 6) for r in shown} == {-edge}
        shown = views.epoch_view(spark, epoch_store, "s", "P1", 2, 4.0, 1, onionskin=True, y_limits=(9.0, -9.0), butterfly=butterfly).collect()
        assert {r.prev_y for r in shown} == {-edge}


def test_views_unpack_only_what_is_shown(spark, signal_store, monkeypatch):
    """Scales come from the store, and overlay and decimation work on arrays."""
    monkeypatch.setattr(views.signals, "auto_scales", None)
    monkeypatch.setattr(views.signals, "explode_blocks", None)
    shown = views.signal_view(spark, signal_store, "s", "P1", 2, 5, 25, "normalize", True, decim=4)
    assert shown.count() == 5 + 20
    plan = shown._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline") == 2 and "posexplode" not in plan  # pieces of blocks, then what is shown


def test_epochs_are_not_laid_under_a_raw_recording(spark, epoch_store):
    shown = views.signal_view(spark, epoch_store, "s", "P1", 3, 0, onionskin=True).collect()
    assert len(shown) == 24 and all(r.prev_y is None for r in shown)


def test_overlay_of_recordings_in_other_blocks(spark, tmp_path):
    """The step before is in blocks of 4 and longer; this one is a block of 8."""
    path = str(tmp_path / "store")
    schema = "source string, participant string, step_num long, step_dir string, kind string, sfreq double"
    recs = spark.createDataFrame([("s", "P", 1, "1_a", "raw", 1.0), ("s", "P", 2, "2_b", "raw", 1.0)], schema).withColumn("mtime", F.timestamp_seconds(F.lit(1)))
    cut = [(1, 0, 4), (1, 4, 4), (1, 8, 4), (2, 0, 8)]
    blocks = spark.createDataFrame([(n, b, [float(100 * n + i) for i in range(b, b + k)]) for n, b, k in cut], "step_num long, start_sample long, samples array<float>")
    blocks = blocks.join(recs, "step_num").withColumns(
        {"ch_idx": F.lit(0), "ch_name": F.lit("c"), "ch_type": F.lit("eeg"), "epoch_idx": F.lit(None).cast("bigint")}
    )
    store.convert(recs, blocks, path)
    shown = views.signal_view(spark, path, "s", "P", 2, 2, onionskin=True).collect()
    assert [(r.sample_idx, r.y, r.prev_y) for r in shown] == [(i, -(200.0 + i), -(100.0 + i)) for i in range(2, 8)]
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = views.signal_view(spark, path, "s", "P", 2, 2, 6)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThan(start_sample" in plan and "LessThan(start_sample" in plan


def test_sources_that_look_like_numbers(spark, tmp_path):
    for name, person in (("1", "A1"), ("01", "B1"), ("2024-01-01", "C1")):
        (tmp_path / name / "1_load").mkdir(parents=True)
        (tmp_path / name / "1_load" / f"{person}.set").write_text("x")
    sources = registry.registry(spark, {n: f"{tmp_path}/{n}/" for n in ("1", "01", "2024-01-01")})
    path = str(tmp_path / "index")
    for _ in range(3):
        views.refresh(sources, path)
    assert [[r.participant for r in views.participant_list(spark, path, n).collect()] for n in ("1", "01", "2024-01-01")] == [["A1"], ["B1"], ["C1"]]
    with pytest.raises(KeyError):
        views.participant_list(spark, path, "001")
    assert len(list((tmp_path / "index").glob("v*"))) == 2  # the last two versions


def test_images_of_any_name(spark, tmp_path):
    folder = tmp_path / "lab" / "quality_control" / "ICA" / "set1"
    folder.mkdir(parents=True)
    (tmp_path / "lab" / "1_load").mkdir()
    (tmp_path / "lab" / "1_load" / "A.set").write_text("x")
    write_png(folder / "A-big[1].PNG", boxed(9, 7, (2, 1, 5, 4), (200, 10, 30), (255, 255, 255)), 3)
    (folder / "A-note.txt").write_text("no image")
    sources = registry.registry(spark, {"lab": f"{tmp_path}/lab/"})
    path = str(tmp_path / "index")
    views.refresh(sources, path)
    shown = views.peek_view(spark, path, sources, "lab", "A", "ICA", "set1", "A-big[1].PNG").collect()
    assert [r.status for r in shown] == ["image"] and base64.b64decode(shown[0].encoded).startswith(b"\x89PNG")
    assert [r.encoded for r in views.peek_view(spark, path, sources, "lab", "A", "ICA", "set1", "A-note.txt").collect()] == [None]
