"""One query per operator over its whole table, and the SQL each must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import bpe, debruijn, divergence, fingerprints, jaccard_join, line_templates, merkle, minhash_dedup, mixing, pii, quality_crf, repetition, sharding
from tidewatch.llm.tables import read

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return register


@query("op2_source_mix", mixing.SQL)
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read(spark, sf_dir))


@query("op10_rendezvous_shards", sharding.SQL)
def rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir))


@query("op8_repetition_rules")
def repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(read(spark, sf_dir))


@query("op9_substring_dedup")
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.removal_report(read(spark, sf_dir))


@query("op1_minhash_dedup")
def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read(spark, sf_dir))


@query("op4_document_fingerprints")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(read(spark, sf_dir))


@query("op7_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir))


@query("op6_line_templates", line_templates.SQL)
def recurring_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.template_report(read(spark, sf_dir))


@query("op3_line_crf_quality")
def line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.quality_report(read(spark, sf_dir), read(spark, sf_dir, "labels"))


@query("op5_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_report(read(spark, sf_dir))


@query("op11_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(read(spark, sf_dir))


@query("op12_merkle_manifest", merkle.SQL)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir))


@query("op13_source_divergence", divergence.SQL)
def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir))
