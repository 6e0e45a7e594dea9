"""Items planted among rare words, verbatim and with a fifth of their words replaced: all are found."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stepview.llm import latent

from .conftest import texts


@pytest.mark.parametrize("size", [1, 2, 5, 6, 8, 11, 12, 16, 40])
def test_planted_items(spark, size):
    rng = random.Random(size)
    common = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.sample(common, size) if size > 1 else [f"one{i}"])) for i in range(20)]
    docs = []
    for i, item in items:
        for replaced in (False, True):
            words = item.split()
            for k in rng.sample(range(size - size // 4), size // 5) if replaced else []:
                words[k] = "other"
            around = [f"rare{rng.randrange(10**9)}" for _ in range(300)]
            at = rng.randrange(250)
            docs.append((len(docs), " ".join(around[:at] + words + around[at:])))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in latent.matched(texts(spark, docs), benchmark).collect()}
    assert {(d, d // 2) for d, _ in docs} <= got
    if size == 40:
        assert len(got) == len(docs)
        assert latent.filtered(texts(spark, docs), benchmark.where(F.col("item_id") < 5)).count() == 30
