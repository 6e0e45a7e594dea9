"""Encoding and decoding for the digests share one pass of Python workers."""

from __future__ import annotations

from stepview.llm import bpe


def test_digests_have_one_python_step(odd):
    plan = bpe.digests(odd)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_coded_is_decode_of_encode(odd, none):
    two = bpe.decode(bpe.encode(odd).drop("text")).select("ids", "decoded", "`a.b`").collect()
    one = bpe.coded(odd)
    assert "text" not in one.columns and one.columns.count("ids") == 1
    assert sorted(map(tuple, one.select("ids", "decoded", "`a.b`").collect())) == sorted(map(tuple, two))
    assert bpe.coded(none).count() == 0
