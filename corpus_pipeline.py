"""A corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, packing.

Of every stage but the last: the columns are those that came in, extra ones and those of any name included; an empty table stays empty; rows that repeat an
id are rows of their own; a null in any other column changes nothing; whole texts are read, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from roomlens.llm import binary, decontaminate, near_duplicates, packing, pii, toxicity


def _with_n_chars(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where the table has it."""
    from pyspark.sql import functions as F

    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, scores as toxic go. Null and empty texts score as texts without toxic words; repeated
    texts score alike; without labels of both kinds nothing is rejected."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are connected by links (five-word shingles, similarity of 0.8 or more) one stays, that of the smallest id.
    Null and empty texts link with nothing and stay. Where ids repeat, rows are told apart by id and text, and of rows equal in both one stays."""
    return near_duplicates.keep_one(docs, shingle=5, percent=80)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in benchmark windows leave the text; a document with half its words hit or more goes. Null and empty texts have no words and stay; an empty benchmark hits
    nothing."""
    return _with_n_chars(decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind. Null and empty texts stay as they are; every document stays."""
    return _with_n_chars(pii.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document with its place in a sequence of at most 2048 tokens. Null and empty texts are a piece of the end id alone; rows that
    repeat an id are packed singly; an empty table gives no rows."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = binary.new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
