"""Joins and rankings that keep hot keys spread over many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SALTS = 16


def salt_of(*columns: Column, salts: int = SALTS) -> Column:
    """Salt in [0, salts) that a retried task computes again from the row itself."""
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    salt_by: Sequence[str],
    *,
    how: str = "left",
    salts: int = SALTS,
) -> DataFrame:
    """``left`` joined to the one row ``right`` has per key.

    Rows of a hot key are spread by ``salt_by`` over ``salts`` tasks, and the short side is
    repeated once per salt. A grouping by the key afterwards shuffles anew, which leaves
    adaptive execution free to split the salted parts further by size. It still turns the
    join into a broadcast when the measured size of ``right`` is under the session's
    threshold. One salt means a plain join, for tables that are bucketed by the key and
    need no shuffle at all.
    """
    if salts <= 1:
        return left.join(right, list(on), how)
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        left.withColumn("_salt", salt_of(*(F.col(name) for name in salt_by), salts=salts))
        .join(salted, [*on, "_salt"], how)
        .drop("_salt")
    )


def top_k(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    k: int,
    *,
    salt_by: Sequence[str] | None = None,
    rank: str = "rank",
    salts: int = SALTS,
) -> DataFrame:
    """The first ``k`` rows of every group with their rank.

    Spark cuts each group to k rows per map task before it shuffles them, so a hot group
    arrives as k rows per task. Where a few groups hold everything, that can still be much
    for one task: ``salt_by`` adds a first cut per (group, salt).
    """
    columns = df.columns
    if salt_by is not None:
        spread = W.partitionBy(*group, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", salt_of(*(F.col(name) for name in salt_by), salts=salts))
            .withColumn(rank, F.row_number().over(spread))
            .filter(F.col(rank) <= k)
            .select(*columns)
        )
    whole = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= k)

