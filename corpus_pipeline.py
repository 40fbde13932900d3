"""From raw documents to encoded training text, in five stages.

Each stage works on what its predecessor kept and is written as Parquet before the next one reads it, so a
stage that is repeated after a loss starts from files.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import language, leaks, near_copies, pieces, secrets
from ledgerloom.llm.files import fresh_folder
from ledgerloom.llm.learning import remainder
from ledgerloom.llm.queries import table, vocabulary
from ledgerloom.llm.ship import session_of

# A learned hierarchy of classifiers cannot be stated in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language.

    Those go that have no letter, or that fit no language half as well as the worst of the labelled documents that
    were not learned from.  Without any labelled document all stay.
    """
    model = language.fit(docs, remainder(4) != 2)
    return language.keep_known(docs, model, language.floor_of(docs, remainder(4) == 2, model))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies."""
    return near_copies.first_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands."""
    return leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in them replaced by a mark."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids, lossless) of all documents."""
    return pieces.encode(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secret_scan", secret_scan),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole table of documents, by ``doc_id``."""
    docs = table(spark, sf_dir, "documents")
    folder = fresh_folder(session_of(docs), "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs.select("doc_id", F.col("n_pieces"), "ids", "lossless")
