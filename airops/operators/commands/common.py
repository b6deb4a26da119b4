"""Shared pieces of the command batches.

A command batch applies a DataFrame of requests to table snapshots with the
meaning "one at a time, in (requested_at, request_id) order", and returns an
outcome per request plus the changed tables. The serial meaning is kept
without a serial loop:

* checks that do not depend on earlier requests are joins;
* "is this the first valid request for its key" is a per-key ``min`` of the
  request order (map-side partial aggregation, so a hot key costs one row
  per map task) joined back, never a window over a whole key group;
* the code of a rejected request is the first failing check, evaluated
  against the final set of accepted requests and their order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airops.schema import STRING_LENGTHS, TABLE_SCHEMAS

OUTCOME_COLUMNS = ("request_id", "accepted", "code", "reason")


def order_key(ts: str = "requested_at", rid: str = "request_id") -> Column:
    """The processing order of a request, as one comparable value."""
    return F.struct(F.col(ts).alias("ts"), F.col(rid).alias("id"))


def first_failure(checks: list[tuple[int, str, Column]], ok_code: int,
                  ok_reason: str = "ok") -> tuple[Column, Column]:
    """(code, reason) of the first check whose condition holds, else ok."""
    checks = [(c, r, F.coalesce(cond, F.lit(False))) for c, r, cond in checks]  # NULL: passes
    code = reduce(lambda acc, c: acc.when(c[2], F.lit(c[0])), checks[1:],
                  F.when(checks[0][2], F.lit(checks[0][0])))
    reason = reduce(lambda acc, c: acc.when(c[2], F.lit(c[1])), checks[1:],
                    F.when(checks[0][2], F.lit(checks[0][1])))
    return code.otherwise(F.lit(ok_code)), reason.otherwise(F.lit(ok_reason))


def outcomes(df: DataFrame, checks: list[tuple[int, str, Column]], ok_code: int,
             ok_reason: str = "ok") -> DataFrame:
    code, reason = first_failure(checks, ok_code, ok_reason)
    return (df.withColumn("code", code.cast("int")).withColumn("reason", reason)
            .withColumn("accepted", F.col("code") < 300))


def new_ids(table: DataFrame, pk: str, rid: str = "request_id") -> Column:
    """A new key per request: (max existing key) + request_id + 1.

    Unique without a global ranking (request ids are unique and not negative);
    the max is a scalar subquery."""
    mx = table.agg(F.coalesce(F.max(pk), F.lit(0)).cast("bigint")).scalar()
    return (mx + F.col(rid) + 1).cast("bigint")


def upsert(base: DataFrame, changes: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Replace ``cols`` of the rows of ``base`` found in ``changes`` (one row per key)."""
    ch = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols],
                        F.lit(True).alias("_hit"))
    ch = ch
    j = base.join(ch, key, "left")
    return j.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
                      if c in cols else F.col(c) for c in base.columns])


def exceeds_type(table: str, fields: tuple[str, ...], updates: bool = False) -> Column:
    """A value that the declared type of its column cannot hold: a text longer than
    its column (in characters), a number outside the integer or decimal range.

    The database refuses such a row, after every check of the request. ``updates``:
    only the fields named in ``set_fields`` are written. Nulls never exceed a type."""
    types = {f.name: f.dataType for f in TABLE_SCHEMAS[table].fields}
    cond = F.lit(False)
    for f in fields:
        length = STRING_LENGTHS.get(table, {}).get(f)
        if length is not None:
            bad = F.length(f) > length
        elif isinstance(types[f], (T.IntegerType, T.DecimalType)):
            bad = F.col(f).isNotNull() & F.col(f).try_cast(types[f]).isNull()
        else:
            continue
        cond = cond | F.coalesce(F.array_contains("set_fields", f) & bad if updates else bad, F.lit(False))
    return cond


def stored(table: str, field: str) -> Column:
    """The value as its column holds it (decimals rounded), null beyond its range:
    what the CHECK constraints are applied to."""
    return F.col(field).try_cast(TABLE_SCHEMAS[table][field].dataType)


def normal_email(c: str = "email") -> Column:
    """The address with its domain in lower case (the local part stays as given):
    the form that is stored and compared."""
    return F.when(F.instr(F.col(c), "@") > 0, F.concat(
        F.regexp_extract(c, "(?s)^(.*@)", 1), F.lower(F.regexp_extract(c, "([^@]*)$", 1)))).otherwise(F.col(c))


def conform(df: DataFrame, like: DataFrame) -> DataFrame:
    """Columns of ``like``, in its order and types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in like.schema.fields])


def restrict(table: DataFrame, keys: DataFrame, col: str, key_col: str | None = None) -> DataFrame:
    """Rows of ``table`` whose ``col`` occurs among the batch's ``key_col`` values:
    a semi join, which the planner broadcasts or shuffles by the bytes of the
    keys. Duplicate keys are harmless in a semi join, so they are not removed:
    no aggregation (and no shuffle) of the batch is needed."""
    k = keys.select(F.col(key_col or col).alias(col)).filter(F.col(col).isNotNull())
    return table.join(k, col, "left_semi")
