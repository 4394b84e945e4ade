"""A corpus pipeline of five stages, each written as Parquet and read again as the documents of the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import chosenpath, decontaminate, langid, pieces, pii
from factloom.llm.common import checkpoint_dir, table
from factloom.llm.queries import TOKENIZERS


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose language is uncertain."""
    return langid.keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of copies and near copies."""
    return chosenpath.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item or an edited copy of one."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind."""
    return pii.redact(docs)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts: doc_id, ids, log_score and n_byte_pieces."""
    return pieces.encode(docs, f"{TOKENIZERS}/piece_bpe_32k.model")


STAGES = [
    ("language_id", language_id),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("sentence_pieces", sentence_pieces),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def _drop(spark: SparkSession, path: str) -> None:
    """Removes a folder of whatever file system it is in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Stages are exchanged through Parquet in the shared checkpoint folder; a stage's folder goes
    once the next one is written."""
    folder, before = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _drop(spark, before)
        before = path
    return docs
