"""A training corpus from documents, in five stages.

Toxic documents go, repeated passages are cut, near copies thinned to one, sources
mixed to target weights, and what stays is encoded. Each stage sees all that the
one before kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.durable import shared_folder
from quire.llm import byte_bpe, line_dedup, mixing, simhash, toxicity
from quire.llm.common import table

#: Near copies share four fifths of their five-word shingles.
SHINGLE_WORDS = 5


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that the models of the labelled rows call toxic; null and empty texts have no evidence and stay,
    unless most labelled documents are toxic. Rows that repeat are judged each, alike."""
    return toxicity.keep_ordinary(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts three-line windows, and passages inside lines, that occurred before; a document of which nothing is left goes.

    Null and empty texts, which lose nothing, stay as they are; of rows with equal ids and texts none is later than the other.
    """
    out = line_dedup.line_dedup(docs)
    changed = (F.col("_n_removed") > 0) | (F.col("_n_sentences") > 0)
    left = out.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near copies.

    Documents without an id stay. Null and empty texts are copies of each other; rows that repeat one id stay or go together.
    """
    return simhash.keep_one(docs, shingle_words=SHINGLE_WORDS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents at the probabilities that bring sources, languages and topics to their target weights.

    Nulls are values of their own, empty texts weigh one, and rows that repeat one id in a cell come or go together.
    """
    return mixing.mix(docs, targets={"lang": mixing.LANGUAGES}).where("_kept").select(docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, starts_sha256, n_split, ids) of every row that is left; a null text has no ids."""
    return byte_bpe.round_trip(docs, keep_ids=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: The models, fingerprints and token ids have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each but the last returns is written to the shared folder and read again.

    A stage's files go once the next stage's are there; the last ones stay, since the result reads them.
    """
    docs, folder, before = table(spark, sf_dir, "documents"), _folder(spark), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
