"""Composable predicates shared by the operators."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_date(d: dt.date | str | None) -> dt.date | None:
    if d is None or isinstance(d, dt.date):
        return d
    return dt.date.fromisoformat(d)


def payment_window(date_from=None, date_to=None, col: str = "payment_date") -> Column:
    """``payment_date >= date_from AND payment_date <= date_to`` (each optional).

    The bounds are dates compared with a timestamp: the date becomes midnight,
    so a payment after 00:00 of ``date_to`` is outside the window."""
    c = F.col(col)
    preds = [F.lit(True)]
    if _as_date(date_from) is not None:
        preds.append(c >= F.lit(_as_date(date_from)).cast("timestamp_ntz"))
    if _as_date(date_to) is not None:
        preds.append(c <= F.lit(_as_date(date_to)).cast("timestamp_ntz"))
    return reduce(lambda a, b: a & b, preds)


def ilike_any(term: str | None, *cols: str) -> Column:
    """OR of ``col ILIKE '%term%'`` (term not escaped: % and _ stay wildcards)."""
    if not term:
        return F.lit(True)
    pattern = f"%{term}%"
    return reduce(lambda a, b: a | b, [F.col(c).ilike(pattern) for c in cols])


def all_of(*preds: Column | None) -> Column:
    """AND of the given predicates, skipping ``None``."""
    ps = [p for p in preds if p is not None]
    return reduce(lambda a, b: a & b, ps) if ps else F.lit(True)
