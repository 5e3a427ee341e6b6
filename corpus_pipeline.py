"""Five stages that make training data of ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but
the last return the columns of documents, whatever further columns there are and whatever
their names. An empty table gives an empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scamsift.llm import bpe, langid, mixing, secrets, simhash
from scamsift.llm.common import fresh, remove, table
from scamsift.llm.queries import tokenizer

#: Share of the tokens that mixing keeps at least, whatever rare cells there are.
LEAST_SHARE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts, texts without letters, and texts that no language's code or that two languages' codes fit go.

    Repeated rows are judged alike.
    """
    found = langid.identify(docs, langid.train(docs))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= 0.5)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest id; of a row that occurs several times one stays.

    Null and wordless texts are one class. A null id stays only if its class has no other.
    """
    return simhash.keep_one(docs)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated rows too, with secrets replaced in their texts; a null text stays null."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by their calibrated probabilities, at least ``LEAST_SHARE`` of all tokens.

    Rows with the same id are drawn alike, those without an id by their texts; null sources
    and languages are values of their own, null texts count one token.
    """
    return mixing.sample(docs, least=LEAST_SHARE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, with digests of the ids and of the text they decode to; a null text has none. Repeated rows stay."""
    return bpe.encode_documents(docs.select("doc_id", "source", "lang", "text"), tokenizer(), ids=True).drop("text")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secrets", remove_secrets), ("mixing", mix), ("bpe", encode)]

#: SQL can't express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder, before = fresh(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
