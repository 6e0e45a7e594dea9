"""Queries that apply each operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepview.llm import bpe, collisions, crosstokens, latent, lengths, periods, perspectives, quality, rans, reshard, secrets, simhash, wrapper
from stepview.llm.shared import ship, table


def op1_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


def op3_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old shards are those of the sources, so they are of very uneven size."""
    docs = table(spark, sf_dir, "documents")
    by_source = F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(reshard.SHARDS))
    return reshard.resharded(docs, by_source, reshard.SHARDS)


def op4_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op5_rans_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.round_trip(table(spark, sf_dir, "documents"))


def op6_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.histogram(lengths.encoded_lengths(table(spark, sf_dir, "documents")))


def op8_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent.matched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_bpe_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op10_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_text(table(spark, sf_dir, "pages"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstokens.digests(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digests(table(spark, sf_dir, "documents"), plant=True)


def op13_coordinate_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.near_duplicates(table(spark, sf_dir, "documents"))


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _shipped(f)
    for f in (
        op1_secret_links,
        op2_perspectives,
        op3_flow_reshard,
        op4_divergence_rules,
        op5_rans_files,
        op6_simhash_anchors,
        op7_length_histogram,
        op8_latent_leaks,
        op9_bpe_boundaries,
        op10_wrapper_text,
        op11_token_alignment,
        op12_periodic_runs,
        op13_coordinate_collisions,
    )
}


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_links": secrets.SQL, "op4_divergence_rules": quality.SQL, "op2_perspectives": perspectives.SQL}
