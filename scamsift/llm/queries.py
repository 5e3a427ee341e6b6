"""The registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_dedup, langid, licenses, mixing, quality_qda, quality_rules, secrets, sharding, simhash
from .common import fold, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*columns)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_documents(spark, sf_dir, "doc_id", "text"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_documents(spark, sf_dir, "doc_id", "text", "source", "lang"))
    return mixed.withColumns({c: F.round(c, 6) for c in ("factor", "prob")})


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    model = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return quality_rules.quality_rules(docs, model).drop("text")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir, "doc_id", "text"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    model = quality_qda.train(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return quality_qda.quality_score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_documents(spark, sf_dir, "doc_id", "text")).drop("text")


def tokenizer() -> bpe.Tokenizer:
    return bpe.load(public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_documents(spark, sf_dir, "doc_id", "text"), tokenizer()).drop("text")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text", "lang")
    model = langid.train(docs)
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle_rows(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_license_scan, op2_mixing, op3_quality_rules, op4_simhash, op5_quality_classifier, op6_secrets, op7_bpe, op8_language_id, op9_embedding_dedup, op10_sharding)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses.oracle(), "op2_mixing": mixing.oracle(), "op9_embedding_dedup": embed_dedup.oracle()}
