"""Queries side by side in one session."""

from __future__ import annotations

import threading
from concurrent.futures import ThreadPoolExecutor

from stepview.llm import queries, shared

SMALL = "/root/testdata/sf0.001"


def test_queries_side_by_side(spark):
    names = ["op5_rans_files", "op6_simhash_anchors", "op10_wrapper_text", "op13_coordinate_collisions"]
    want = {n: sorted(map(repr, queries.QUERIES[n](spark, SMALL).collect())) for n in names}
    shared._shipped.clear()
    with ThreadPoolExecutor(4) as pool:
        got = dict(zip(names, pool.map(lambda n: sorted(map(repr, queries.QUERIES[n](spark, SMALL).collect())), names), strict=True))
    assert got == want


def test_scopes_of_threads(spark):
    """A scope deletes what was saved in it by its own thread, and nothing else."""
    begun, done = threading.Event(), threading.Event()
    kept = []

    def other():
        with shared.scope(spark):
            kept.append(shared.saved(spark.range(3), "other"))
            begun.set()
            done.wait()
            assert kept[0].count() == 3

    with ThreadPoolExecutor(1) as pool:
        with shared.scope(spark):
            running = pool.submit(other)
            begun.wait()
            mine = shared.saved(spark.range(4), "mine")
            outer = shared.saved(spark.range(5), "outer", outer=True)
        done.set()
        running.result()
    assert outer.count() == 5
    assert not any("mine" in p or "other" in p for p in _left(spark))
    del mine


def _left(spark):
    where, files = shared._hadoop(spark, shared.folder(spark))
    return [s.getPath().getName() for s in files.listStatus(where) if s.getPath().getName().startswith(("llm-mine", "llm-other"))]
