"""Cleaning of the documents table, stage by stage.

Every stage works on all rows its predecessor kept and returns the columns of documents, the
last one more. What a stage decides takes effect: rows it rejects are gone from its result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipway.llm import bpe, decontaminate, exact_dedup, quality, simhash
from slipway.llm.common import cut, fresh, read_table, text_of, without_rows


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of good quality reaches the threshold.

    The network learns from labelled rows of ``docs``; null and empty texts are scored too.
    """
    weights = quality.train(docs, read_table(spark, sf_dir, "labels"))
    score = fresh(docs, "score")
    scored = quality.score(docs, weights, out=score)
    return scored.filter(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id; documents without an id stay."""
    return exact_dedup.without_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id; those without one stay.

    Texts are linked if the SimHashes of their four-word shingles differ in four bits at most.
    A row is named by id and text, so that others with the same id stay.
    """
    return without_rows(docs, simhash.near_duplicates(docs, shingle=4, radius=4).filter("doc_id <> component_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.without_benchmark(docs, read_table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids, and whether these decode to the text again.

    The ids are written before they are decoded, so that a task has one Python worker at a time.
    """
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    decoded = bpe.decode(cut(bpe.encode(docs, ranks, public_tokenizers.PATTERN), "encoded"), ranks)
    return decoded.select(
        *docs.columns,
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        (F.col("decoded") == text_of().cast("binary")).alias("round_trip"),
    )


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_duplicates),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: The first stage is a trained network, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
