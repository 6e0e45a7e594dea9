"""Tables brought up to date by what has changed, and versions of them."""

import os
import random
import shutil

import pytest
from conftest import boxed, write_png

from stepview.operators import changes
from stepview.plans import views
from stepview.sources import registry, versions


def build(root, people=40):
    for i in range(people):
        for step in ("1_load", "2_ica"):
            path = root / step / f"S{i}.set"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text("x")
        log = root / "logs" / f"S{i}_run.log"
        log.parent.mkdir(exist_ok=True)
        log.write_text(f"log of {i}")
        image = root / "quality_control" / "ICA" / "set1" / f"S{i}-chs1-9.png"
        image.parent.mkdir(parents=True, exist_ok=True)
        write_png(image, boxed(3, 3, (1, 1, 2, 2), (1, 2, 3), (9, 9, 9)), 3)


def contents(spark, path):
    return {
        name: sorted(map(repr, (r.asDict(True) for r in views.table(spark, path, name).select(*sorted(views.table(spark, path, name).columns)).collect())))
        for name in views.TABLES
    }


def test_only_what_changed_is_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(views, "REWRITE", 0.5)
    lab, other = tmp_path / "lab", tmp_path / "other"
    build(lab)
    build(other, 3)
    sources = registry.registry(spark, {"lab": lab, "01": other})
    path, again = str(tmp_path / "index"), str(tmp_path / "again")
    views.refresh(sources, path)
    base = versions.complete(spark, path)[-1]

    def check(whole, hit=None):
        changed = views.refresh_changed(sources, path)
        folder = versions.current(spark, path)
        assert (versions.base_of(folder) is None) == whole
        if hit is not None:
            rows = spark.read.parquet(f"{folder}/_keys/logs").collect()
            assert {tuple(r) for r in rows} == hit and views._added(spark, path, "step_files", None).count() <= 3 * len(hit)
        views.refresh(sources, again)
        assert contents(spark, path) == contents(spark, again)
        return {r.rel_path: r.change for r in changed.collect()}

    assert check(False, set()) == {}
    (lab / "2_ica" / "S7.set").unlink()
    os.utime(lab / "1_load" / "S8.set", (5, 5))
    (lab / "1_load" / ".S9-raw.fif").write_text("copy")
    # The folders that files came to or went from have new times, but are no one's.
    found = check(False, {("lab", p) for p in ("S7", "S8", "S9")})
    assert {k: v for k, v in found.items() if "." in k} == {"2_ica/S7.set": "removed", "1_load/S8.set": "modified", "1_load/.S9-raw.fif": "added"}
    # Logs and images of S11 are those of S1 as well; a new participant takes what was there before.
    (lab / "logs" / "S11_more.log").write_text("x")
    (other / "1_load" / "S").with_suffix(".set").write_text("x")
    hit = {("lab", p) for p in ("S7", "S8", "S9", "S1", "S11")} | {("01", "S")}
    check(False, hit)
    assert base in versions.complete(spark, path)  # the version that the later ones add to stays
    assert len(versions.complete(spark, path)) <= 3
    for i in range(12, 40):
        (lab / "1_load" / f"S{i}.set").unlink()
    check(True)
    shutil.rmtree(lab / "quality_control")
    (lab / "3_new").mkdir()
    check(True)
    (lab / "4_new").mkdir()
    check(False, set())
    assert views.participant_list(spark, path, "01").count() == 4
    with pytest.raises(KeyError):
        views.participant_list(spark, path, "02")


def test_sources_come_move_and_go(spark, tmp_path):
    for name in ("a", "b"):
        build(tmp_path / name, 2)
    path, again = str(tmp_path / "index"), str(tmp_path / "again")
    for given in ({"x": "a"}, {"x": "b"}, {"x": "b", "y": "a"}, {"y": "a"}, {}):
        sources = registry.registry(spark, {n: tmp_path / d for n, d in given.items()})
        if given:
            views.refresh_changed(sources, path)
            views.refresh(sources, again)
            assert contents(spark, path) == contents(spark, again)


def test_two_writers(spark, tmp_path):
    path = str(tmp_path / "v")
    with versions.new_version(spark, path) as folder:
        spark.range(1).write.parquet(folder)
    with pytest.raises(RuntimeError), versions.new_version(spark, path) as late:
        spark.range(2).write.parquet(late)
        with versions.new_version(spark, path) as early:
            spark.range(3).write.parquet(early)
    assert spark.read.parquet(versions.current(spark, path)).count() == 3
    assert not os.path.exists(late)
    with pytest.raises(ValueError), versions.new_version(spark, path) as failed:
        spark.range(4).write.parquet(failed)
        raise ValueError
    assert not os.path.exists(failed)
    with versions.new_version(spark, path) as folder:
        spark.range(5).write.parquet(folder)
    assert spark.read.parquet(versions.current(spark, path)).count() == 5


def test_random_changes(spark):
    rng = random.Random(2)
    old = {(rng.choice("ab"), f"p{rng.randrange(60)}"): rng.randrange(3) for _ in range(60)}
    new = {k: rng.choice([v, v, 9, None]) for k, v in old.items() if rng.random() < 0.8} | {("a", None): 1, ("c", "p1"): None}
    frames = [spark.createDataFrame([(*k, v) for k, v in d.items()], "source string, rel_path string, state long") for d in (old, new)]
    got = {(r.source, r.rel_path): r.change for r in changes.changes(*frames, state=["state"]).collect()}
    want = {k: "removed" if k not in new else "added" if k not in old else "modified" for k in old.keys() | new.keys() if k not in old or k not in new or old[k] != new[k]}
    assert got == want
    assert changes.changes(frames[0], frames[0], state=["state"]).count() == 0
