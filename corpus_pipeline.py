"""The corpus pipeline: five stages from raw documents to token files.

Every stage takes (spark, docs, sf_dir), with the documents its predecessor kept, and
returns a DataFrame; all but the last return the columns of ``documents``.
"""

from pyspark.sql import DataFrame, SparkSession

from tillbook.functions.shared import new_folder
from tillbook.llm import contamination, mixing, near, quality, tokens
from tillbook.llm.registry import table, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no plain rule and read like trusted ones."""
    judged = quality.quality_rules(
        docs, table(spark, sf_dir, "labels"), quality.ANY_SIZE, keep=COLUMNS
    )
    return judged.filter("kept").select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    return near.first_copies(docs).select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return contamination.without_leaks(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as many times as it is taken."""
    return mixing.repeated(docs).select(*COLUMNS)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files hold: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``."""
    return tokens.token_files(docs, tokenizer_path())


STAGES = [
    ("quality rules", good),
    ("MinHash near-dedup", distinct),
    ("benchmark decontamination", clean),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", tokenized),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        folder = new_folder(spark, f"stage-{at}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs


# Neither the paths of the join nor the tokenizer can be put in SQL.
ORACLE_SQL = None
