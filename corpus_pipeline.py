"""From documents to token ids in five stages; each takes (spark, docs, sf_dir).

``run`` writes what a stage returns as Parquet to the shared scratch folder and reads it again for
the next one. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.llm import bpe, decontaminate, ngram_join, quality, secret_scan
from salesmart.llm.queries import TOKENIZERS, table, vocabulary
from salesmart.llm.steps import importable, settled
from salesmart.sinks.scratch import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts go."""
    importable(spark)
    return quality.judge(docs).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the one with the least id.

    Of several texts with that id the one with the least hash stays, and of repeated rows the one with the least other
    columns. Documents with a null id, and those without words, are no one's duplicates and all stay.
    """
    importable(spark)
    text = F.coalesce("text", F.lit(""))
    alone = F.col("doc_id").isNull() | (F.length(F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))) == 0)
    judged = ngram_join.join(docs.where(~alone).select("doc_id", "text"), ngram_join.Rule(5, 80, 100), group="group")
    found = settled(judged.select("doc_id", F.md5("text").alias("digest"), "component_id", "group"), "groups")
    least = found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id", "group").agg(F.min("digest").alias("digest"))
    first = least.select("doc_id", "digest").distinct()
    single = docs.where(~alone).withColumn("digest", F.md5("text")).join(first, ["doc_id", "digest"], "left_semi")
    rest = F.min(F.struct("lang", "source", "n_chars")).alias("rest")
    kept = single.groupBy("doc_id", "digest").agg(F.first("text").alias("text"), rest).select("doc_id", "text", "rest.*")
    return kept.unionByName(docs.where(alone)).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ten words (or a whole shorter item) of the benchmark.

    Null and empty texts, and repeated rows, stay; without a benchmark all do.
    """
    marked = decontaminate.mark(docs, table(spark, sf_dir, "benchmark"), m=10)
    return marked.where(F.size("hit_spans") == 0).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the characters of secrets masked; lengths stay, and so do null texts and repeated rows."""
    importable(spark)
    found = secret_scan.scan(docs, scratch_path(spark, "ledger"))
    return found.withColumn("text", secret_scan.redacted(F.col("text"), F.col("spans"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and whether they decode to the text; null is as empty, repeated rows stay."""
    importable(spark)
    coded = bpe.round_trip(docs, vocabulary(TOKENIZERS))
    return coded.select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: Byte-pair encoding can't be said in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
