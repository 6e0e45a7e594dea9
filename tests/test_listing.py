"""Listing of large folders by several tasks, and the tree as a data source."""

import os

import pytest
from pyspark.sql import functions as F

from stepview.sources import listing, registry
from stepview.sources import tree as trees


def test_ranges_leave_no_name_out():
    for n in (0, 1, 2, 5, 1000, 30_000):
        found = trees.ranges((f"n{i * 7919 % 100_003}" for i in range(n)), 100)
        assert found[0][0] is None and found[-1][1] is None
        assert all(a[1] == b[0] and a[1] is not None for a, b in zip(found, found[1:]))
        assert len(found) == max(1, min(-(-n // 100), trees.SAMPLE))
    sizes = [0] * len(found)
    for i in range(n):
        name = f"n{i * 7919 % 100_003}"
        sizes[next(k for k, (low, high) in enumerate(found) if (low is None or name >= low) and (high is None or name < high))] += 1
    assert max(sizes) < 1000 and sum(sizes) == n
    assert trees.ranges(iter(["same"] * 500), 10)[0][0] is None  # cuts that fall together are one


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    """A step with 45,000 files, hidden ones and an empty folder among them."""
    root = tmp_path_factory.mktemp("large")
    step = root / "1_load"
    step.mkdir()
    for i in range(45_000):
        os.close(os.open(step / f"{'.' if i % 9 == 0 else ''}S{i}.set", os.O_CREAT))
    (step / "empty").mkdir()
    (root / "2_none").mkdir()
    deep = root / "logs" / "a" / "b"
    deep.mkdir(parents=True)
    (deep / "S1.log").write_text("x")
    (root / "other" / "deep").mkdir(parents=True)
    os.symlink(root, deep / "loop")
    return root


def test_large_folder_is_listed_by_several_tasks(spark, large):
    folders = spark.createDataFrame([("one", str(large / "1_load"), "1_load")], "source string, path string, rel_path string")
    listed = trees._listed(folders)
    assert len(listed.inputFiles()) > 1 and listed.count() == 45_001
    assert listed.select("path").distinct().count() == 45_001 and listed.where("is_dir").count() == 1
    assert listed.where(F.col("rel_path").startswith("1_load/.")).count() == 5000


def test_data_source_equals_manifest(spark, large):
    spark.dataSource.register(listing.TreeSource)
    columns = ["rel_path", "is_dir", "mtime", "size"]
    for shallow in (False, True):
        read = spark.read.format("stepview_tree").options(source="one", range=1000, shallow=str(shallow)).load(str(large))
        assert read.rdd.getNumPartitions() > 40
        want = trees.manifest(registry.registry(spark, {"one": large}), shallow=shallow)
        got = read.cache()
        assert got.select(columns).exceptAll(want.select(columns)).count() == 0 and got.count() == want.count()
    assert trees.described(read).where("suffix = '.set' and parent = '1_load'").count() == 45_000


def test_data_source_of_nothing(spark, tmp_path):
    spark.dataSource.register(listing.TreeSource)
    assert spark.read.format("stepview_tree").load(str(tmp_path)).count() == 0
    assert spark.read.format("stepview_tree").load(str(tmp_path / "none")).count() == 0
