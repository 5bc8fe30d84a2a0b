"""The numbered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, packing, phrases, pii, quality, search, sharding, simhash, substring, tokenbin, toxicity, urlfilter, warc
from .common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.shard(table(spark, sf_dir, "documents"), 24))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(*substring.removed(table(spark, sf_dir, "documents")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.round_trip(table(spark, sf_dir, "pages")))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.digest(tokenbin.round_trip(table(spark, sf_dir, "documents")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_groups(table(spark, sf_dir, "documents"), k=4, seeds=(42,), radius=4, blocks=7, equal=3))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"))[1])


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.assess(table(spark, sf_dir, "documents")))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.digest(urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.train(urlfilter.labelled(spark))))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.top(phrases.mine(table(spark, sf_dir, "documents")))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_sharding, op2_substring_dedup, op3_toxicity, op4_pii, op5_decontamination, op6_warc, op7_token_ids, op8_simhash, op9_packing, op10_quality, op11_url_filters, op12_phrases, op13_search, pipeline)}
