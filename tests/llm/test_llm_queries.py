"""Registered queries against their SQL, and the pipeline against its stages by hand."""

from __future__ import annotations

import hashlib

import pytest
from compare import difference, duck
from conftest import SF

import corpus_pipeline
from stepview.llm import bpe, latent, quality, queries, secrets, words
from stepview.llm.shared import table

from .test_collisions import survivors

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query(spark, name):
    assert difference(spark, duck(SF), SF, queries.QUERIES[name], queries.oracle_sql()[name]) is None


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    docs = table(spark, SMALL, "documents").toPandas().set_index("doc_id")["text"].to_dict()
    verdict = quality.verdicts(table(spark, SMALL, "documents")).collect()
    kept = sorted(r["doc_id"] for r in verdict if r["kept"])
    kept = sorted(survivors([(d, docs[d]) for d in kept], 80))
    items = [latent.words_of(r["text"]).tobytes() for r in table(spark, SMALL, "benchmark").collect()]
    kept = [d for d in kept if not any(x in latent.words_of(docs[d]).tobytes() for x in items)]
    assert sorted(got) == kept
    library = words.load(bpe.TOKENIZER)
    spans = {r["doc_id"]: r["spans"] for r in secrets.scan(table(spark, SMALL, "documents")).collect()}
    for d in kept:
        text, end, out = docs[d], 0, ""
        for begin, stop in sorted(tuple(map(int, s.split(":")[1:])) for s in spans[d].split(",") if s):
            if begin >= end:
                out += text[end:begin] + "[secret]"
            end = max(end, stop)
        ids = library.encode(out + text[end:], add_special_tokens=False).ids
        assert got[d]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "encoding"]
    docs = table(spark, SMALL, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns, name
        assert stage(spark, docs.limit(0), SMALL).count() == 0
