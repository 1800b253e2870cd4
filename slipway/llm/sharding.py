"""Shards by a keyed permutation of global row numbers.

Row numbers come from fixed bins: a row's bin is a hash of its key and text, the number is its
place in the bin after all rows of lower bins. A Feistel network over the grid of rows and
columns that just holds all numbers permutes them; a number that lands outside walks on along
its cycle. Position p is slot p div S of shard p mod S, so shards differ by a row at most and
any row's place can be computed from its number alone.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slipway.llm.common import cut, read_table, text_of

SHARDS = 24
ROUNDS = 6
#: Bins of the numbering. Their counts are one small table, whatever the number of rows.
BINS = 4096
#: Cycle steps tried. Fewer than sqrt(n) + 1 numbers lie outside the grid's n, so a walk
#: of this length stays outside with a chance below n ** -16; the query fails if one does.
WALKS = 32


def grid(rows: int) -> tuple[int, int]:
    """Sides (a, b) of the smallest near-square grid with a * b >= rows."""
    a = max(1, isqrt(max(0, rows - 1)) + 1)
    return a, max(1, -(-rows // a))


def _mixed(value: Column, turn: Column, seed: int, below: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), turn, value), F.lit(below).cast("long"))


def _permute_once(number: Column, rows: int, seed: int) -> Column:
    a, b = grid(rows)

    def step(pair: Column, turn: Column) -> Column:
        left, right = pair["left"], pair["right"]
        moved_left = F.pmod(left + _mixed(right, turn, seed, a), F.lit(a).cast("long"))
        moved_right = F.pmod(right + _mixed(left, turn, seed, b), F.lit(b).cast("long"))
        even = turn % 2 == 0
        return F.struct(
            F.when(even, moved_left).otherwise(left).alias("left"),
            F.when(even, right).otherwise(moved_right).alias("right"),
        )

    start = F.struct(F.floor(number / F.lit(b)).alias("left"), F.pmod(number, F.lit(b).cast("long")).alias("right"))
    turns = F.array(*(F.lit(turn) for turn in range(ROUNDS)))
    return F.aggregate(turns, start, step, lambda pair: pair["left"] * F.lit(b).cast("long") + pair["right"])


def permuted(number: Column, rows: int, seed: int = 0) -> Column:
    """The place of row ``number`` among ``rows``; a bijection of [0, rows) for every seed."""
    count = F.lit(rows).cast("long")

    def walk(at: Column, _: Column) -> Column:
        return F.when((at >= 0) & (at < count), at).otherwise(_permute_once(at, rows, seed))

    steps = F.array(*(F.lit(turn) for turn in range(WALKS)))
    end = F.aggregate(steps, _permute_once(number, rows, seed), walk)
    return F.when(end < count, end).otherwise(F.raise_error(F.lit("a cycle left the rows for too long")).cast("long"))


def shard_plan(
    docs: DataFrame, shards: int = SHARDS, *, seed: int = 0, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: ``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot``.

    The result is the same for any order and partitioning of ``docs``. A null text has size 8
    and the checksum of no bytes; null keys are numbered like others. Rows alike in key and
    text are interchangeable and get places of their own. Other columns are ignored, an
    empty table gives an empty result. The text is read once and never moved.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("_text"))
    sized = cut(
        texts.select(
            "doc_id",
            (F.octet_length("_text") + 8).cast("long").alias("size"),
            F.crc32(F.col("_text").cast("binary")).alias("text_crc32"),
            F.pmod(F.xxhash64("doc_id", "_text"), F.lit(BINS).cast("long")).cast("int").alias("_bin"),
        ),
        "sized",
    )
    counts = sized.groupBy("_bin").count()
    before = W.orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_bin", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    rows = sized.count()
    within = W.partitionBy("_bin").orderBy("doc_id", "text_crc32", "size")
    numbered = sized.withColumn("_place", F.row_number().over(within) - 1).join(F.broadcast(offsets), "_bin")
    position = permuted(F.col("_before") + F.col("_place"), rows, seed)
    return numbered.withColumn("_position", position).select(
        "doc_id",
        "size",
        "text_crc32",
        F.pmod("_position", F.lit(shards).cast("long")).cast("int").alias("shard"),
        F.floor(F.col("_position") / F.lit(shards)).cast("long").alias("slot"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law held is ``rows``: counts of shards differ by one at most."""
    return shard_plan(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
