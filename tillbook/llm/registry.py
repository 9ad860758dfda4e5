"""Registered queries of the text operators, each over its whole table with production settings."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillbook.llm import (
    classifier, contamination, conversations, language, lines, mixing, near, negatives, oracle, pii, quality,
    secrets, tokens, urls,
)
from tillbook.session import based


# A vocabulary file of the public tokenizers, by its name there.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder. Batches for Python are kept small, as some texts are very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return based(spark).read.parquet(f"{folder}/{name}.parquet")


def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return quality.quality_rules(docs, labels, quality.ANY_SIZE).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_grams", "score_sum",
    )


def op2(spark: SparkSession, folder: str) -> DataFrame:
    return pii.spans_report(table(spark, folder, "documents"))


def op3(spark: SparkSession, folder: str) -> DataFrame:
    return lines.repeated_lines_removed(table(spark, folder, "documents"))


def op4(spark: SparkSession, folder: str) -> DataFrame:
    return language.language_report(table(spark, folder, "documents"))


def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return contamination.contamination_report(docs, items)


def op6(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_duplicates(table(spark, folder, "documents"))


def op7(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_files(table(spark, folder, "documents"), tokenizer_path())


def op8(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixing_report(table(spark, folder, "documents"))


def op9(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secrets_report(table(spark, folder, "documents"))


def op10(spark: SparkSession, folder: str) -> DataFrame:
    return urls.url_filter(table(spark, folder, "pages"))


def op11(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair_report(table(spark, folder, "conversations"))


def op12(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.mining_report(table(spark, folder, "embeddings"))


def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return classifier.quality_scores(docs, labels)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1,
    "op2_pii": op2,
    "op3_line_dedup": op3,
    "op4_language_id": op4,
    "op5_decontamination": op5,
    "op6_minhash_near_dedup": op6,
    "op7_token_binary": op7,
    "op8_mixing": op8,
    "op9_secrets": op9,
    "op10_url_filters": op10,
    "op11_conversation_repair": op11,
    "op12_hard_negatives": op12,
    "op13_quality_classifier": op13,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Twins of the queries that SQL can express; the others are tested against plain Python."""
    return dict(oracle.SQL)
