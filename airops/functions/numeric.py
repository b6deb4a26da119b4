"""Exact money and percentage arithmetic.

Values are computed on decimals or integers and cast to double only at the
end, so the result is the correctly rounded double of an exact value (the
same on any engine, whatever the summation order).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(c: Column) -> Column:
    """An exact decimal amount presented as double."""
    return c.cast("double")


def avg_money(total: Column, count: Column) -> Column:
    """round(total / count, 2), half up, on exact decimals; NULL when count is 0."""
    q = total / F.nullif(count, F.lit(0)).cast("decimal(20,0)")
    return F.round(q, 2).cast("double")


def idiv(a: Column, b: Column) -> Column:
    """Exact integer division floor(a / b) for a >= 0, b > 0 (NULL when b is NULL)."""
    a = a.cast("bigint")
    b = b.cast("bigint")
    return ((a - F.pmod(a, b)).cast("decimal(38,0)") / b.cast("decimal(38,0)")).cast("bigint")


def pct_half_up(num: Column, den: Column) -> Column:
    """ROUND(num::numeric / NULLIF(den, 0) * 100, 1), exact, as double.

    Integer form: floor((2000 * num + den) / (2 * den)) / 10 for num, den >= 0."""
    n, d = num.cast("bigint"), F.nullif(den.cast("bigint"), F.lit(0))
    return idiv(n * 2000 + d, d * 2) / F.lit(10.0)


def pct_half_even(num: Column, den: Column) -> Column:
    """round(num / den * 100, 1) with ties to even (Python ``round``), exact.

    Counts only (num, den >= 0); 0.0 when den is 0."""
    n, d = num.cast("bigint"), den.cast("bigint")
    dn = F.nullif(d, F.lit(0))
    q = idiv(n * 1000, dn)
    r = n * 1000 - q * dn
    up = (r * 2 > dn) | ((r * 2 == dn) & (F.pmod(q, F.lit(2)) == 1))
    rounded = q + F.when(up, 1).otherwise(0)
    return F.when(d == 0, F.lit(0.0)).otherwise(rounded / F.lit(10.0))


def minutes_between(start: Column, end: Column) -> Column:
    """(end - start) in fractional minutes, from exact microseconds."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(60_000_000.0)
