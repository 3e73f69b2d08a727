"""Stages from raw documents to token ids; each takes ``(spark, docs, sf_dir)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import exact_dedup, language, mixing, pieces, simhash
from corvane.llm.common import fresh_path, keep

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents some language wins; texts without a letter, and ties, go. An unlabelled document takes the language found."""
    found = language.identify(docs, language.fit(docs), list(COLUMNS))
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") > 0))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays."""
    return exact_dedup.exact_duplicates(docs, list(COLUMNS)).filter("kept").select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, that of the smallest id; null ids come last, then the text decides."""
    rows = keep(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "near-rows")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("digest"), F.col("_row").alias("row"))
    groups = simhash.simhash_groups(rows.select(order.alias("doc_id"), "text"))
    first = groups.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id.row").alias("_row"))
    return rows.join(first, "_row", "left_semi").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at equal shares, replicated and shuffled."""
    return mixing.mix(docs).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return pieces.encode(docs, ["doc_id", "lang", "source"])


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language_id), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing", mixed), ("SentencePiece", encoded)]

# suffix automata, fingerprint links and Viterbi have no SQL; tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
