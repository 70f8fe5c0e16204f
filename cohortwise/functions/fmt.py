"""Number-to-text helpers that print like the reference (half-even rounding)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed(x: Column, places: int = 0) -> Column:
    """``f"{x:.Nf}"``: half-even, no thousands separator."""
    return F.regexp_replace(F.format_number(x, places), ",", "")


def grouped(x: Column, places: int = 0) -> Column:
    """``f"{x:,.Nf}"`` (and ``f"{n:,}"`` for integers with places=0)."""
    return F.format_number(x, places)


def general(x: Column) -> Column:
    """``f"{x:g}"`` for the values listings carry (whole or short decimals)."""
    return (F.when(x == F.floor(x), F.floor(x).cast("bigint").cast("string"))
            .otherwise(x.cast("string")))


def pyround(x: Column, places: int) -> Column:
    """Half-even rounding of the exact binary value (what ``round(x, n)`` does).

    ``bround`` rounds the shortest decimal text instead (5.35 -> 5.4, while
    the binary value 5.3499... rounds to 5.3), so go through DecimalFormat,
    which rounds the exact value. ``x`` stands once in the result, so rounded
    values of rounded values stay small plans. Infinite values give
    null.
    """
    return F.regexp_replace(F.format_number(x, places), ",", "").try_cast("double")


def pyround_of(x: Column, places: int) -> Column:
    """``pyround`` of a column that is already there (``x`` stands in it several times): no text where the answer is plain.

    Away from ties the nearest whole number of ``x`` times the power of ten is
    sure, and so is its quotient, the double that its decimal text reads as.
    """
    power = 10.0 ** places
    scaled = x * F.lit(power)
    plain = (F.abs(scaled) < 1e9) & (F.abs(F.abs(scaled - F.rint(scaled)) - 0.5) > 1e-5)
    return F.when(plain, F.rint(scaled) / F.lit(power)).otherwise(pyround(x, places))


def rounded(df: DataFrame, **columns: tuple[Column, int]) -> DataFrame:
    """``df`` with each name as ``pyround`` of (value, places), in any number of rows mostly without text.

    The values are columns of their own first: they stand several times in the result.
    """
    raw = df.withColumns({f"_raw_{name}": x for name, (x, _) in columns.items()})
    return raw.withColumns({name: pyround_of(F.col(f"_raw_{name}"), places) for name, (_, places) in columns.items()}).drop(*[f"_raw_{name}" for name in columns])
