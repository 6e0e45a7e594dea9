"""Shape of the physical plans of the registered queries."""

import re

import pytest

from stepview.operators import prefix
from stepview.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def physical(df):
    spark = df.sparkSession
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairwise_joins_and_no_python_rows(spark, name):
    plan = physical(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "BatchEvalPython" not in plan  # row-at-a-time functions
    assert ("MapInPandas" in plan) == (name == "image_trim")


@pytest.mark.parametrize(
    "name,columns",
    [
        ("participants", {"l_orderkey", "l_linenumber", "l_returnflag"}),
        ("qc_rejects", {"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag"}),
        ("decimation_factors", {"user_id", "event_type"}),
        ("conversion_plan", {"o_orderkey", "o_orderdate", "l_orderkey", "l_linestatus", "l_shipdate"}),
        ("image_bbox", {"vec_id", "embedding"}),
    ],
)
def test_scans_read_only_what_is_used(spark, name, columns):
    plan = physical(QUERIES[name](spark, SF))
    read = re.findall(r"ReadSchema: struct<(.*?)>(?:\n|$)", plan)
    assert {field.split(":")[0] for schema in read for field in re.findall(r"\w+:", schema)} == columns


def test_whole_groups_are_not_gathered_by_windows(spark):
    """Windows are over (keys, chunk), never over the keys of a group alone."""
    for name in ("qc_items", "signal_window", "steps_for_participant"):
        plan = physical(QUERIES[name](spark, SF))
        big = [line for line in plan.splitlines() if "Window [" in line and "_before" not in line]
        assert big and all("_chunk" in line.split("windowspecdefinition")[1] for line in big)


def test_rows_that_differ_stay_dealt(spark):
    """Rows that are nearly all different are dealt in a number that AQE leaves as it is, without partial sums in front."""
    for name, least in (("has_prev", 2), ("overview", 1)):
        plan = physical(QUERIES[name](spark, SF))
        assert plan.count("REPARTITION_BY_NUM") >= least, name


def test_prefixes_that_can_not_match_are_not_shuffled(spark):
    """Of P12-x.png the prefixes P12- and P12-x end like no id of their length."""
    ids = spark.createDataFrame([("s", x) for x in ("P1", "P12", "P345", "P6789", "é")] + [("t", "P9")], "source string, participant string")
    names = spark.createDataFrame([("s", x) for x in ("P12-x.png", "P345-y", "P", "", "é1", "P9-z")], "source string, name string")
    found = prefix.prefix_join(names, ids, by=["source"])
    assert sorted((r.participant, r.name) for r in found.collect()) == [("P1", "P12-x.png"), ("P12", "P12-x.png"), ("P345", "P345-y"), ("é", "é1")]
    assert "bit_or" in physical(found)
