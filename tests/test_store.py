"""The registry and the store of converted signals."""

import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stepview.operators import signals
from stepview.operators.prefix import prefix_join
from stepview.sources import registry, store
from stepview.sources import tree as trees


def batch_names(spark, arrivals):
    df = spark.createDataFrame(arrivals, "name string, directory string, arrival long")
    return {(r.name, r.directory): r.unique_name for r in registry.unique_names(df).collect()}


@pytest.mark.parametrize(
    "arrivals,want",
    [
        ([("x", "/a"), ("x", "/b"), ("x", "/a"), ("y", "/a"), ("x", "/c")], ["x", "x-2", "x", "y", "x-3"]),
        # A name given with a number: the earlier arrival keeps it.
        ([("x", "/a"), ("x-2", "/b"), ("x", "/c"), ("x", "/d")], ["x", "x-2", "x-3", "x-4"]),
        ([("x", "/a"), ("x", "/c"), ("x-2", "/b"), ("x-2", "/e")], ["x", "x-2", "x-2-2", "x-2-3"]),
        # A made name that its own directory has already been given.
        ([("x-2", "/d"), ("x", "/a"), ("x", "/b"), ("x", "/d"), ("x", "/e")], ["x-2", "x", "x-3", "x-2", "x-4"]),
        # One directory, however it is written; behind ``..`` there may be another.
        ([("x", "/d/a"), ("x", "/d/a/"), ("x", "//d/./a"), ("x", "~/q"), ("x", "~/q/."), ("x", "/d/b/../a")], ["x", "x", "x", "x-2", "x-2", "x-3"]),
    ],
)
def test_unique_names(spark, arrivals, want):
    df = spark.createDataFrame([(n, d, i) for i, (n, d) in enumerate(arrivals)], "name string, directory string, arrival long")
    got = {(r.name, r.directory): r.unique_name for r in registry.unique_names(df).collect()}
    assert [got[n, registry.normalized(d)] for n, d in arrivals] == want


@pytest.mark.parametrize("seed", range(3))
def test_unique_names_at_random(spark, seed):
    """No two directories share a name; each name is the one asked for, or numbered."""
    rng = random.Random(seed)
    pool = ["x", "x-2", "x-3", "x-2-2", "y", "y-2"]
    arrivals = [(rng.choice(pool), "/" + rng.choice("abcde"), i) for i in range(12)]
    got = batch_names(spark, arrivals)
    assert got.keys() == {(n, d) for n, d, _ in arrivals}
    assert len({(u, d) for (_, d), u in got.items()}) == len({u for u in got.values()})
    assert all(u == n or re.fullmatch(re.escape(n) + "-[1-9][0-9]*", u) for (n, _), u in got.items())
    assert got[arrivals[0][:2]] == arrivals[0][0]


def one_by_one(arrivals):
    """Registration as it is done by hand, one directory after the other."""
    sources, given = {}, {}
    for name, directory, _ in sorted(arrivals, key=lambda a: a[2]):
        candidate, n = name, 1
        while sources.get(candidate, directory) != directory:
            n += 1
            candidate = f"{name}-{n}"
        sources[candidate] = directory
        given.setdefault((name, directory), candidate)
    return given


@pytest.mark.parametrize("seed", range(2))
def test_many_unique_names_as_one_by_one(spark, seed):
    rng = random.Random(seed)
    pool = ["x", "x-2", "x-3", "x-2-2", "x-10", "y", "y-2", "z", "w-1", "w", "v-02", "v", "-2", ""]
    arrivals = [(rng.choice(pool), f"/{rng.randrange(40)}", i) for i in rng.sample(range(10_000), 700)]
    assert batch_names(spark, arrivals) == one_by_one(arrivals)


def test_jobs_of_unique_names_do_not_grow(spark):
    tracker = spark.sparkContext.statusTracker()
    counts = []
    for clashes in (1, 60):
        arrivals = [("x", "/a", 0)] + [(f"x-{k}" if k % 2 else "x", f"/{k}", k) for k in range(2, clashes + 2)]
        group = f"names-{clashes}"
        spark.sparkContext.setJobGroup(group, group)
        batch_names(spark, arrivals)
        counts.append(len(tracker.getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # Adaptive execution may split off a job for a table that is small enough.
    assert abs(counts[0] - counts[1]) <= 1 and max(counts) <= 16, counts


def test_directory_behind_a_link(spark, tmp_path):
    """``link/..`` is the parent of what the link leads to."""
    (tmp_path / "far" / "deep").mkdir(parents=True)
    (tmp_path / "far" / "a" / "1_load").mkdir(parents=True)
    (tmp_path / "far" / "a" / "1_load" / "S1.set").write_text("x")
    (tmp_path / "link").symlink_to(tmp_path / "far" / "deep")
    given = spark.createDataFrame([(f"{tmp_path}/link/../a", 1), (f"{tmp_path}/a", 2)], "directory string, n long")
    assert {r.n: r.is_dir for r in registry.checked(given).collect()} == {1: True, 2: False}
    sources = registry.registry(spark, {"lab": f"{tmp_path}/link/../a/"})
    assert trees.manifest(sources).where("name = 'S1.set'").count() == 1


def test_registry_is_rewritten_where_it_was_read(spark, tmp_path):
    path = str(tmp_path / "r")
    registry.write_registry(registry.registry(spark, {"a": "/a/", "b": "/b"}), path)
    registry.write_registry(registry.without(registry.read_registry(spark, path), "a"), path)
    assert [tuple(r) for r in registry.read_registry(spark, path).collect()] == [("b", "/b")]
    broken = registry.read_registry(spark, path).withColumn("name", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        registry.write_registry(broken, path)
    assert [tuple(r) for r in registry.read_registry(spark, path).collect()] == [("b", "/b")]


def test_registry_round_trip(spark, tmp_path):
    sources = registry.registry(spark, {"a": 1, 'b "q"': "/d\\x"})
    registry.write_registry(sources, str(tmp_path / "r"))
    again = registry.read_registry(spark, str(tmp_path / "r"))
    assert sorted(map(tuple, again.collect())) == [("a", "1"), ('b "q"', "/d\\x")]
    assert registry.registry(spark, None).count() == 0
    assert registry.directory_of(again, "a") == "1"
    with pytest.raises(KeyError):
        registry.directory_of(again, "nope")
    assert registry.without(again, "a").count() == 1 and registry.without(again, "nope").count() == 2


def test_registration_checks(spark, tmp_path):
    arrivals = spark.createDataFrame([(str(tmp_path), 1), ("/no/such", 2)], "directory string, n long")
    assert [r.is_dir for r in registry.checked(arrivals).orderBy("n").collect()] == [True, False]
    cases = [("", "/a/b/", "b"), (" n ", "/a/b", "n"), (None, "/", "/"), (None, "/x y ", "x y")]
    df = spark.createDataFrame([c[:2] for c in cases], "name string, directory string")
    got = [r[0] for r in df.select(registry.default_name(F.col("name"), F.col("directory"))).collect()]
    assert got == [c[2] for c in cases]


def recordings(spark, *rows):
    schema = "source string, participant string, step_num long, step_dir string, kind string, mtime timestamp"
    df = spark.createDataFrame(list(rows), "source string, participant string, step_num long, step_dir string, kind string, t long")
    return df.withColumn("mtime", F.timestamp_seconds("t")).select(*[c.split()[0] for c in schema.split(", ")])


def signal(recs, mark):
    return recs.select(
        *store.RECORDING, "kind", F.lit(None).cast("bigint").alias("epoch_idx"), F.lit(0).alias("ch_idx"),
        F.lit("c0").alias("ch_name"), F.lit("eeg").alias("ch_type"), F.lit(0).cast("bigint").alias("start_sample"),
        F.array(F.lit(float(mark)).cast("float")).alias("samples"),
    )


def content(spark, path):
    return {(r.participant, r.step_num): r.samples[0] for r in store.read_signal(spark, path).collect()}


def report(df):
    return {(r.participant, r.step_num): r.status for r in df.collect()}


def test_conversion(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.read_signal(spark, path).count() == 0
    first = recordings(spark, ("s", "P1", 1, "1_a", "raw", 100), ("s", "P2", 1, "1_a", "epochs", 100))
    assert set(report(store.convert(first, signal(first, 1), path)).values()) == {"Caching"}
    # P1 is newer now, P3 has come, P2 is as it was.
    later = recordings(
        spark, ("s", "P1", 1, "1_a", "raw", 200), ("s", "P2", 1, "1_a", "epochs", 100), ("s", "P3", 2, "2_b", "raw", 50)
    )
    got = report(store.convert(later, signal(later, 2), path))
    assert got == {("P1", 1): "Caching", ("P2", 1): "Already cached", ("P3", 2): "Caching"}
    assert content(spark, path) == {("P1", 1): 2.0, ("P2", 1): 1.0, ("P3", 2): 2.0}
    kinds = {r.participant: r.kind for r in store.converted(spark, path).collect()}
    assert kinds == {"P1": "raw", "P2": "epochs", "P3": "raw"}
    assert set(report(store.convert(later, signal(later, 3), path)).values()) == {"Already cached"}
    assert set(report(store.convert(later, signal(later, 4), path, clean=True)).values()) == {"Caching"}
    assert set(content(spark, path).values()) == {4.0}
    assert spark.read.parquet(f"{path}/signal").count() == 3  # nothing old is left


def test_clean_of_some_recordings_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "store")
    both = recordings(spark, ("s", "P1", 1, "1_a", "raw", 100), ("s", "P2", 1, "1_a", "raw", 100))
    store.convert(both, signal(both, 1), path)
    one = both.where("participant = 'P1'")
    assert report(store.convert(one, signal(one, 2), path, clean=True)) == {("P1", 1): "Caching"}
    assert content(spark, path) == {("P1", 1): 2.0, ("P2", 1): 1.0}
    assert set(report(store.convert(both, signal(both, 3), path)).values()) == {"Already cached"}
    assert content(spark, path) == {("P1", 1): 2.0, ("P2", 1): 1.0}


def test_recording_without_blocks_is_not_converted(spark, tmp_path):
    path = str(tmp_path / "store")
    both = recordings(spark, ("s", "P1", 1, "1_a", "raw", 100), ("s", "P2", 1, "1_a", "raw", 100))
    some = signal(both.where("participant = 'P1'"), 1)
    assert report(store.convert(both, some, path)) == {("P1", 1): "Caching", ("P2", 1): "no_signal"}
    assert report(store.convert(both, signal(both, 2), path)) == {("P1", 1): "Already cached", ("P2", 1): "Caching"}
    assert content(spark, path) == {("P1", 1): 1.0, ("P2", 1): 2.0}
    assert store.converted(spark, path).where("longest = 1").count() == 2


def test_blocks_without_their_record_do_not_count(spark, tmp_path):
    """What a job leaves behind that dies before its last write."""
    path = str(tmp_path / "store")
    recs = recordings(spark, ("s", "P1", 1, "1_a", "raw", 100))
    store.convert(recs, signal(recs, 1), path)
    stray = signal(recs, 9).withColumn("batch", F.lit("dead"))
    stray.write.mode("append").partitionBy("source", "step_num", "batch").parquet(f"{path}/signal")
    assert content(spark, path) == {("P1", 1): 1.0}


def test_window_of_one_participant_prunes(spark, tmp_path):
    path = str(tmp_path / "store")
    recs = recordings(spark, *[("s", f"P{i}", i % 3, "1_a", "raw", 100) for i in range(9)])
    store.convert(recs, signal(recs, 1), path)
    one = store.read_signal(spark, path).where("source = 's' and step_num = 1 and participant = 'P1' and start_sample < 5")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = one._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "samples" in line)
    assert "EqualTo(participant,P1)" in scan and "LessThan(start_sample,5)" in scan
    assert "step_num" in scan.split("PartitionFilters:")[1].split("PushedFilters")[0]


def test_window_and_picks_leave_row_groups_out(spark, tmp_path, monkeypatch):
    """One channel at the end of a recording of 64 channels and 256 blocks: under a tenth of the row groups."""
    monkeypatch.setattr(store, "ROW_GROUP", 32 << 10)
    path = tmp_path / "store"
    recs = recordings(spark, ("s", "P1", 1, "1_a", "raw", 100))
    blocks = signal(recs, 1).drop("ch_idx", "start_sample", "samples", "ch_name").withColumns(
        {"ch_idx": F.explode(F.sequence(F.lit(0), F.lit(63))), "start_sample": F.explode(F.sequence(F.lit(0), F.lit(255))).cast("bigint") * 50}
    )
    blocks = blocks.withColumn("samples", F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: F.rand(3).cast("float") + i))
    blocks = blocks.withColumn("ch_name", F.format_string("c%02d", "ch_idx"))
    store.convert(recs, blocks, str(path))
    groups = hit = 0
    for file in path.glob("signal/source=s/*/*/*.parquet"):
        meta = pq.read_metadata(file)
        names = {meta.schema.column(k).name: k for k in range(len(meta.schema))}
        for g in range(meta.num_row_groups):
            stats = [meta.row_group(g).column(names[c]).statistics for c in ("start_sample", "ch_name")]
            groups += 1
            hit += stats[0].max >= 250 * 50 and stats[1].min <= "c07" <= stats[1].max
    assert groups >= 40 and 0 < hit < groups / 10
    assert store.read_signal(spark, str(path)).where("ch_name = 'c07' and start_sample >= 12500").count() == 6


def test_interleaved(spark):
    (r,) = spark.range(1).select(store.interleaved(F.lit(5), F.lit(3)).alias("x"), store.interleaved(F.lit(-4), F.lit(1 << 40), bits=3).alias("y")).collect()
    assert (r.x, r.y) == (0b011011, 0b101010)


def damage(path, how):
    """Change every file of the store's signal."""
    for file in path.glob("signal/source=s/step_num=1/*/*.parquet"):
        how(file)
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)


@pytest.mark.parametrize("how", [lambda f: f.write_bytes(b"nothing"), lambda f: f.write_bytes(f.read_bytes()[:40] + b"x" * 60 + f.read_bytes()[100:])])
def test_damaged_copies_are_made_again(spark, tmp_path, how):
    path = str(tmp_path / "store")
    recs = recordings(spark, *[("s", f"P{i}", n, "1_a", "raw" if n == 1 else "epochs", 100) for i in range(3) for n in (1, 2)])
    store.convert(recs, signal(recs, 1), path)
    assert {r.readable for r in store.readable(spark, path).collect()} == {True}
    assert {r.status for r in store.statuses(recs, path, check=True).collect()} == {"fresh_raw", "fresh_epochs"}
    assert store.read_fresh(recs, path, check=True).count() == store.read_signal(spark, path).count()
    damage(tmp_path / "store", how)
    states = {(r.participant, r.step_num): r.status for r in store.statuses(recs, path, check=True).collect()}
    assert states == {(f"P{i}", n): "unreadable" if n == 1 else "fresh_epochs" for i in range(3) for n in (1, 2)}
    assert {r.status for r in store.statuses(recs, path).collect()} == {"fresh_raw", "fresh_epochs"}  # by their times alone
    with pytest.raises(Exception, match="no fresh copy"):
        store.read_fresh(recs, path, check=True).count()
    got = report(store.convert(recs, signal(recs, 2), path, check=True))
    assert got == {(f"P{i}", n): "Caching" if n == 1 else "Already cached" for i in range(3) for n in (1, 2)}
    assert content(spark, path) == {(f"P{i}", n): 2.0 if n == 1 else 1.0 for i in range(3) for n in (1, 2)}
    assert store.read_fresh(recs, path, check=True).count() == 6


def test_forced_mode_wants_every_copy_fresh(spark, tmp_path):
    path = str(tmp_path / "store")
    recs = recordings(spark, ("s", "P1", 1, "1_a", "raw", 100))
    for given, state in ((recs, "missing"), (recordings(spark, ("s", "P1", 1, "1_a", "raw", 200)), "stale")):
        with pytest.raises(Exception, match=f"no fresh copy: {state}"):
            store.read_fresh(given, path).count()
        store.convert(recs, signal(recs, 1), path)
    assert store.read_fresh(recs, path).count() == 1


def test_stored_scales_are_those_of_all_samples(spark, tmp_path):
    path = str(tmp_path / "store")
    recs = recordings(spark, ("s", "P1", 1, "1_a", "raw", 100), ("s", "P2", 1, "1_a", "raw", 100))
    for value in (1, 2):
        blocks = signal(recs, value).withColumn("samples", F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: (i * value).cast("float")))
        store.convert(recs, blocks, path, clean=True)
        want = {tuple(r) for r in signals.auto_scales(signals.explode_blocks(store.read_signal(spark, path)), ["participant", "ch_type"]).collect()}
        assert {(r.participant, r.ch_type, r.scale) for r in store.scales(spark, path).collect()} == want
        assert {s for *_, s in want} == {1 / (4 * value)}


# ------------------------------------------------------------------- prefixes


@pytest.mark.parametrize("longest", [False, True])
def test_prefix_join_is_the_theta_join(spark, longest):
    rng = random.Random(7)
    ids = {("s", "".join(rng.choice("a1%_") for _ in range(rng.randrange(1, 5)))) for _ in range(40)}
    names = {("s", "".join(rng.choice("a1%_") for _ in range(rng.randrange(1, 9)))) for _ in range(200)} | {("t", "a1")}
    got = prefix_join(
        spark.createDataFrame(sorted(names), "source string, name string"),
        spark.createDataFrame(sorted(ids), "source string, participant string"),
        by=["source"],
        longest=longest,
    )
    want = {(s, n, p) for s, n in names for t, p in ids if s == t and n.startswith(p)}
    if longest:
        want = {w for w in want if not any(o[:2] == w[:2] and len(o[2]) > len(w[2]) for o in want)}
    rows = [(r.source, r.name, r.participant) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_prefix_join_plan(spark):
    names = spark.range(1000).select(F.concat(F.lit("P"), F.col("id").cast("string")).alias("name"))
    people = spark.range(50).select(F.concat(F.lit("P"), F.col("id").cast("string")).alias("participant"))
    plan = prefix_join(names, people)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_hot_participant_is_split(spark, tmp_path):
    """A participant with most of the files: AQE reads its partition in pieces."""
    settings = {
        "spark.sql.shuffle.partitions": "64",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        number = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 500)
        names = spark.range(0, 60000, 1, 8).select(
            F.concat(F.lit("P"), number.cast("string"), F.lit("-"), F.sha2(F.col("id").cast("string"), 256)).alias("name")
        )
        people = spark.range(500).select(F.concat(F.lit("P"), F.col("id").cast("string"), F.lit("-")).alias("participant"))
        path = str(tmp_path / "joined")
        prefix_join(names, people).withColumn("task", F.spark_partition_id()).write.parquet(path)
        written = spark.read.parquet(path)
        assert written.count() == 60000
        assert written.where("participant = 'P7-'").select("task").distinct().count() > 2
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
