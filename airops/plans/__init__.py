"""Plan inspection: what Spark will do for an operator.

Used by tests and when tuning: ``formatted(df)`` is ``explain("formatted")``
as text, ``operators(df)`` counts physical operators by name (exchanges,
broadcasts, joins, top-k)."""

from __future__ import annotations

import contextlib
import io
import re
from collections import Counter

from pyspark.sql import DataFrame


def formatted(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def operators(df: DataFrame) -> Counter:
    """Physical operator names in the (pre-AQE) plan, with counts."""
    text = formatted(df, "simple")
    names = re.findall(r"[+\-:\s*]*([A-Z][A-Za-z]+)(?:\s|\()", text)
    return Counter(n for n in names if n not in {"Physical", "Plan", "AdaptiveSparkPlan"})


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[([^\]]*)\]", formatted(df))
