"""Ranks, running totals and quantiles with groups cut over many chunks."""

import random
import tempfile
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepview.operators import ranking
from stepview.operators.signals import auto_scales


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one group, the rest in many, some keys NULL."""
    rng = random.Random(1)
    keys = ["hot"] * 1000 + [f"k{rng.randrange(300)}" for _ in range(1900)] + [None] * 100
    rows = [(k, rng.randrange(10**9), i, rng.choice([0.5, 1.25, rng.random()])) for i, k in enumerate(keys)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, o long, i long, v double").repartition(5).cache()


@pytest.mark.parametrize("partitions", [None, 1, 13])
def test_rank_of_skewed_groups(skewed, partitions):
    rows, df = skewed
    got = {r.i: r.pos for r in ranking.rank(df, ["k"], ["o", "i"], "pos", partitions).collect()}
    want, seen = {}, {}
    for k, o, i, _ in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        seen[k] = seen.get(k, 0) + 1
        want[i] = seen[k]
    assert got == want


def test_hot_group_spans_chunks_and_offsets_stay_few(skewed, monkeypatch):
    _, df = skewed
    written = []
    original = ranking.materialize
    monkeypatch.setattr(ranking, "materialize", lambda d, tag: written.append(original(d, tag)) or written[-1])
    ranking.rank(df, ["k"], ["o", "i"], "pos", 13)
    chunks = written[0].where("k = 'hot'").select("_chunk").distinct().count()
    largest = written[0].groupBy("_chunk").count().agg(F.max("count")).head()[0]
    assert chunks >= 4 and largest < 700


def test_rank_without_keys(skewed):
    rows, df = skewed
    got = [r.i for r in ranking.rank(df, [], ["o", "i"], "pos", 7).orderBy("pos").collect()]
    assert got == [r[2] for r in sorted(rows, key=lambda r: (r[1], r[2]))]


def test_running_total(skewed):
    rows, df = skewed
    total = ranking.running_total(df, ["k"], ["o", "i"], F.col("i"), "upto", 9)
    got = {r.i: r.upto for r in total.collect()}
    want, seen = {}, {}
    for k, o, i, _ in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        seen[k] = seen.get(k, 0) + i
        want[i] = seen[k]
    assert got == want


@pytest.mark.parametrize("partitions", [None, 11])
def test_exact_quantiles(skewed, partitions):
    rows, df = skewed
    known = df.where("k is not null")
    probs = {"a": 0.0, "q1": 0.25, "m": 0.5, "q3": 0.75, "z": 1.0}
    got = ranking.exact_quantiles(known, ["k"], "v", probs, partitions).collect()
    groups = {}
    for k, _, _, v in rows:
        groups.setdefault(k, []).append(v)
    groups.pop(None)
    assert {r.k for r in got} == set(groups)
    for r in got:
        assert np.allclose(list(r[1:]), np.quantile(groups[r.k], list(probs.values())), atol=1e-12)


def test_quantiles_skip_nan_and_null(spark):
    rows = [("a", 1.0), ("a", None), ("a", float("nan")), ("a", 3.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    assert ranking.exact_quantiles(df, ["k"], "v", {"m": 0.5}).head()["m"] == 2.0


def test_scale_of_constant_is_one(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0)], "k string, value double")
    assert auto_scales(df, ["k"]).head()["scale"] == 1.0


def test_ranks_survive_a_second_run(skewed):
    """The cut is fixed once: both uses of a ranked frame see the same numbers."""
    _, df = skewed
    ranked = ranking.rank(df, ["k"], ["o", "i"], "pos", 13)
    again = ranked.withColumnRenamed("pos", "other")
    assert ranked.join(again, "i").where("pos <> other").count() == 0


def test_shared_folder_comes_from_the_session(spark):
    assert ranking.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_no_local_folder_on_a_cluster():
    def session(master):
        conf = SimpleNamespace(get=lambda key, default: default)
        context = SimpleNamespace(getCheckpointDir=lambda: None, master=master)
        return SimpleNamespace(conf=conf, sparkContext=context)

    assert ranking.shared_dir(session("local[4]")).startswith(tempfile.gettempdir())
    with pytest.raises(ValueError):
        ranking.shared_dir(session("yarn"))
