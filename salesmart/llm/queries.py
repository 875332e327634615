"""Registered queries of the subpackage: each operator over its whole table, in the fixed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.llm import (
    bpe,
    collocations,
    conversation_trie,
    decontaminate,
    langid,
    line_dedup,
    ngram_join,
    quality,
    secret_scan,
    suffix_dedup,
    token_counts,
    toxicity,
    url_filter,
)
from salesmart.llm.steps import importable, settled
from salesmart.sinks.scratch import scratch_path

TOKENIZERS = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"

URL_RULES = (
    url_filter.Rule(url_filter.ALLOW, "org", "/"),
    url_filter.Rule(url_filter.BLOCK, "example.org", "/es/"),
    url_filter.Rule(url_filter.BLOCK, "example.org", "/en/1"),
    url_filter.Rule(url_filter.ALLOW, "com", "/fr/"),
    url_filter.Rule(url_filter.BLOCK, "com", "/de/"),
)


def vocabulary(name: str) -> str:
    """A vocabulary file of the public tokenizers on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary(TOKENIZERS)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, path).drop("text"), path)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = ngram_join.join(docs, ngram_join.Rule(words=4, num=85, den=100))
    return found.select("doc_id", "n_shingles", "component_id")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "component")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.mark(docs, table(spark, sf_dir, "benchmark"), m=10)
    lengths = F.transform("hit_spans", lambda s: s["end"] - s["start"])
    hit = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, b: a + b)
    return marked.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.judge(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.array_join("failed", ",").alias("failed"),
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = suffix_dedup.remove_repeats(docs, length=400)
    removed = F.col("n_bytes") - F.octet_length("kept")
    return cut.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        (removed > 0).alias("repeated"),
    )


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, scratch_path(spark, "ledger"))
    base = F.filter("spans", lambda s: s["rank"] < 3)

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id",
        number("assign"),
        number("access"),
        number("hex"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(langid.fold(F.col("doc_id"), 4) == 2, F.lit(False))
    learned = langid.learn_dictionaries(docs.where(F.col("doc_id").isNotNull() & ~held_out))
    found = langid.identify(docs.select("doc_id", "text"), learned)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_counts.sentencepiece_vocabulary(vocabulary(PIECES))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, pieces).select("doc_id", "n_tokens", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(langid.fold(F.col("doc_id"), 3) == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.learn(docs.where(~held_out), labels)
    found = toxicity.score(docs, model)
    return found.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    maps = line_dedup.keep_bitmaps(docs, least=20, copies=3)
    cut = line_dedup.apply(docs, maps)
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text", "lang")
    return collocations.top(collocations.collocations(docs, least=30, longest=4), 2000)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    members = settled(turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv")).distinct(), "members")
    rows = settled(conversation_trie.numbered(turns), "turns")
    start = F.col("conv") - F.col("conv") % 100
    shared = F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    return conversation_trie.trie(conversation_trie.grafted(rows, members, start, shared), members)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bpe,
        op2_ngram_join,
        op3_url_filter,
        op4_decontaminate,
        op5_quality,
        op6_suffix_dedup,
        op7_secret_scan,
        op8_language,
        op9_token_counts,
        op10_toxicity,
        op11_line_dedup,
        op12_collocations,
        op13_conversation_trie,
    )
}
