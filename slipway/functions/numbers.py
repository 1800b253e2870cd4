"""Numeric rules that must agree with IEEE doubles to the last bit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EXACT = float(2**53)
_SPLITTER = 134217729.0  # 2**27 + 1 cuts a double into two halves whose products are exact


def _high_half(value: Column) -> Column:
    return value * F.lit(_SPLITTER) - (value * F.lit(_SPLITTER) - value)


def _lost(value: Column, high: Column, scaled: Column) -> Column:
    """What rounding took from the product of ``value`` and 100."""
    return (high * F.lit(100.0) - scaled) + (value - high) * F.lit(100.0)


def _to_cents(value: Column, scaled: Column, floor: Column, lost: Column) -> Column:
    over_half = (scaled - floor) - F.lit(0.5)
    up = (
        (over_half > 0)
        | ((over_half == 0) & (lost > 0))
        | ((over_half == 0) & (lost == 0) & (F.pmod(floor, F.lit(2)) == 1))
    )
    rounded = F.when(up, floor + 1).otherwise(floor).cast("double") / F.lit(100.0)
    # Past 2**53 hundredths a double has no cents left to round.
    return F.when(F.abs(scaled) < _EXACT, rounded).otherwise(value)


def round_cents(value: Column) -> Column:
    """``value`` to two decimals from its exact binary value, ties to even.

    ``F.round`` works on the decimal text and rounds halves up (2.675 -> 2.68); this
    gives 2.67 as Python does. What the product with 100 lost tells a product that only
    looks like a half from a true one.
    """
    scaled = value * F.lit(100.0)
    return _to_cents(value, scaled, F.floor(scaled), _lost(value, _high_half(value), scaled))


def round_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with these columns rounded as by ``round_cents``.

    In three steps, each computed once per row, which keeps the generated methods short
    enough for the JVM to compile.
    """
    first = df.select(
        "*",
        *((F.col(n) * F.lit(100.0)).alias(f"_scaled_{n}") for n in names),
        *(_high_half(F.col(n)).alias(f"_high_{n}") for n in names),
    )
    second = first.select(
        "*",
        *(F.floor(F.col(f"_scaled_{n}")).alias(f"_floor_{n}") for n in names),
        *(_lost(F.col(n), F.col(f"_high_{n}"), F.col(f"_scaled_{n}")).alias(f"_lost_{n}") for n in names),
    )

    def rounded(n: str) -> Column:
        parts = (F.col(f"_{part}_{n}") for part in ("scaled", "floor", "lost"))
        return _to_cents(F.col(n), *parts).alias(n)

    return second.select(*(rounded(n) if n in names else F.col(n) for n in df.columns))


def exact_product(*factors: Column) -> Column:
    """Product of integers as a double; exact in 64 bits, else in floating point."""
    exact = factors[0].cast("bigint")
    loose = factors[0].cast("double")
    for factor in factors[1:]:
        exact = F.try_multiply(exact, factor.cast("bigint"))
        loose = loose * factor.cast("double")
    return F.coalesce(exact.cast("double"), loose)
