"""Exact duplicates by progressive refinement: length, then a hash of the head, then of all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slipway.llm.common import cut, read_table, sifted, text_of, without_rows

#: Characters of a text that the second step hashes.
HEAD_CHARS = 256


def _digest(column: str) -> Column:
    return F.sha2(F.col(column).cast("binary"), 256)


def exact_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Per row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_hash`` (xxhash64), and ``text_sha256`` on request.

    Texts that are the same code points form a group, null counting as empty; the row with
    the largest key stays. Groups of one length are split by a hash of their head, and only
    rows of groups that still have two members have their whole text hashed and compared.
    Rows that share key and text are one document: they are kept or dropped together. A null
    key never wins over another; a group of null keys only keeps all of them. Other columns
    of ``docs`` are ignored, an empty table gives an empty result.

    Groups are counted by partial sums and joined as (length, hash) pairs, so a group with a
    third of all rows is never gathered. Whole texts are hashed where they are read: those that
    a bitmap of the suspect heads lets through, a few by chance, which then are groups of one.
    With ``digest`` the hash of every text is reported, those of survivors being the ones that
    were compared.
    """
    keyed = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("_text")).select(
        "doc_id",
        "_text",
        F.xxhash64("_text").alias("text_hash"),
        F.octet_length("_text").alias("_length"),
        F.xxhash64(F.octet_length("_text"), F.substring("_text", 1, HEAD_CHARS)).alias("_head"),
    )
    # As a table the lengths are broadcast while they are few, and else joined by an exchange of
    # their own, which lets adaptive execution split a common length. The hash holds the
    # length too, so that its rows are spread again for the count.
    lengths = cut(keyed.groupBy("_length").count().filter("count > 1").select("_length"), "lengths")
    heads = keyed.select("_length", "_head").join(lengths, "_length", "left_semi").groupBy("_head").count()
    suspects = cut(heads.filter("count > 1").select(F.col("_head").alias("value")), "suspects")
    may, alone = sifted(keyed, F.col("_head"), suspects)
    survivors = cut(may.select("doc_id", "text_hash", "_length", F.unhex(_digest("_text")).alias("_whole")), "survivors")
    # Written, since a grouping beside the join it feeds is not split when a group is large.
    groups = survivors.groupBy("_length", "_whole").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    compared = survivors.join(cut(groups, "groups"), ["_length", "_whole"])
    columns = ["doc_id", "keep_id", "group_size", "text_hash"]
    compared = compared.select(*columns, F.lower(F.hex("_whole")).alias("text_sha256"))
    alone = alone.select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        "text_hash",
        (_digest("_text") if digest else F.lit(None).cast("string")).alias("text_sha256"),
    )
    found = compared.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_hash", *(["text_sha256"] if digest else []))


def without_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with all its columns and, of equal texts, the row with the largest key.

    Rows without a key are left as they are, since none can be named to be dropped. A row is
    named by key and text, so that others with the same key stay.
    """
    return without_rows(docs, exact_duplicates(docs, key=key, text=text).filter("not kept"), key=key, text=text)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents"), digest=True).drop("text_hash")


OP8_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
