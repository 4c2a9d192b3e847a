"""A corpus from raw documents to packed sequences: each stage applies one operator of ``fleetgold.llm``.

A stage takes the documents that its predecessor kept and returns those it keeps; each
is written as Parquet and reread as the next one's input, and deleted when that is written. The last one returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgold.llm import line_dedup, mixing, ngram_join, packing, qda
from fleetgold.llm.common import discard, id_crc, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels outside its held-out third."""
    model = qda.train(docs, table(spark, sf_dir, "labels"), learn=id_crc() % 3 != 1)
    return qda.keep_good(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar lines one stays; a document that loses all its lines goes."""
    cleaned = line_dedup.without_repeats(docs)
    if "n_chars" not in docs.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents one row stays: the smallest doc_id, one of equal rows, null ids last."""
    return ngram_join.without_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights; a document taken twice is two rows."""
    return mixing.repeated(mixing.mix(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids, with the ids."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("pack", pack),
]

#: SQL cannot express the classifier, the line dedup and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        after = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)  # its one reader is done
        docs = before = after
    return docs
