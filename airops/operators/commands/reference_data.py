"""Create / update batches for airports, aircraft, flights, schedules and staff.

Creates with one unique key: the first request per key that passes every
other check is inserted; a later one with the same key is a 409 (a rejected
request holds nothing). Updates carry ``set_fields array<string>`` (a field
not listed is left alone, which differs from an explicit NULL); all accepted
updates of one row are applied in order, so per field the last one wins
(``max_by`` over the request order). An explicit NULL for a NOT NULL column, a
value breaking a CHECK constraint, or one that its column's type cannot hold (a
text too long, a number out of range) is the database's 500: that request is
rejected whole, holds no key, and the others of the batch go on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airops.operators.audits import EMAIL_PATTERN
from airops.operators.commands.common import (conform, exceeds_type, new_ids, normal_email, order_key,
                                              outcomes, restrict, stored)
from airops.operators.commands.fold import fold_in_blocks
from airops.schema import AIRCRAFT_STATUS, FLIGHT_STATUS, STAFF_ROLE, TABLE_SCHEMAS

# --- fixed values: outcome reasons ----------------------------------------------
R_INVALID = "invalid_request"
R_EXISTS = "already_exists"
R_404 = "not_found"
R_DB = "constraint_violation"
R_ORIGIN_404 = "origin_not_found"
R_DEST_404 = "destination_not_found"
R_SAME = "same_airports"
R_AIRCRAFT_404 = "aircraft_not_found"
R_AIRCRAFT_INACTIVE = "aircraft_not_active"
R_ARR_BEFORE_DEP = "arrival_not_after_departure"
IATA_PATTERN = r"^\p{L}{3}$"
# --- end of fixed values ----------------------------------------------------------


def _keyed_create(r: DataFrame, key: str, checks: list, dup_at: int, exists: Column):
    """Outcomes of a create batch with one unique ``key``.

    ``checks`` are (code, reason, condition) in order; the uniqueness check is
    inserted at position ``dup_at`` with the static condition ``exists``."""
    static_fail = F.coalesce(exists, F.lit(False))
    for _, _, c in checks:
        static_fail = static_fail | F.coalesce(c, F.lit(False))
    first = r.filter(~static_fail).groupBy(key).agg(F.min("_ord").alias("_acc"))
    r = r.join(first, key, "left")
    full = list(checks)
    full.insert(dup_at, (409, R_EXISTS, exists | (F.col("_acc") < F.col("_ord"))))
    return outcomes(r, full, 201)


def _not_null_violation(table: str, fields: tuple[str, ...]) -> Column:
    """An explicitly set NULL for a NOT NULL column."""
    cond = F.lit(False)
    nullable = {f.name: f.nullable for f in TABLE_SCHEMAS[table].fields}
    for f in fields:
        if not nullable[f]:
            cond = cond | (F.array_contains("set_fields", f) & F.col(f).isNull())
    return cond


def _given(field: str) -> Column:
    return F.array_contains(F.col("set_fields"), field)


def _apply_updates(base: DataFrame, pk: str, accepted: DataFrame,
                   fields: tuple[str, ...]) -> DataFrame:
    """Per row and field, the value of the last accepted request that set it."""
    aggs = []
    for f in fields:
        ordv = F.when(_given(f), F.col("_ord"))
        aggs.append(F.max_by(F.struct(F.col(f).alias("v")), ordv).alias(f"_v_{f}"))
        aggs.append(F.max(F.when(_given(f), F.lit(True))).alias(f"_s_{f}"))
    per_row = accepted.groupBy(F.col(pk)).agg(*aggs)
    j = base.join(per_row, pk, "left")
    return j.select(*[F.when(F.col(f"_s_{c}"), F.col(f"_v_{c}.v")).otherwise(F.col(c))
                      .cast(base.schema[c].dataType).alias(c)
                      if c in fields else F.col(c) for c in base.columns])


def _keyed_update(t, table: str, pk: str, r: DataFrame, fields: tuple[str, ...],
                  checks_after_404: list, extra_fail: Column | None = None, ok_code: int = 200,
                  shape_bad: Column | None = None):
    """Outcomes and new table of an update batch: request shape 422, then 404
    if the row is missing, then ``checks_after_404``, then the database's 500."""
    found = restrict(t[table], r, pk).select(pk, F.lit(True).alias("_found"))
    r = r.withColumn("_ord", order_key()).join(found, pk, "left")
    db = _not_null_violation(table, fields) | exceeds_type(table, fields, updates=True)
    if extra_fail is not None:
        db = db | extra_fail
    shape = [(422, R_INVALID, shape_bad)] if shape_bad is not None else []
    out = outcomes(r, shape + [(404, R_404, F.col("_found").isNull())] + checks_after_404
                   + [(500, R_DB, db)], ok_code)
    new = _apply_updates(t[table], pk, out.filter("accepted"), fields)
    return out.select("request_id", "accepted", "code", "reason"), {table: new}


# --- airports ------------------------------------------------------------------------

def create_airports(t, requests: DataFrame):
    """IATA code upper-cased and stripped, 3 letters (else 422); 409 if taken."""
    r = (requests.withColumn("iata_code", F.upper(F.regexp_replace(
        "iata_code", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")))
         .withColumn("terminals", F.coalesce(F.col("terminals"), F.lit(1)))
         .withColumn("_ord", order_key()))
    shape = F.coalesce(F.col("iata_code").rlike(IATA_PATTERN), F.lit(False)) & (
        F.col("airport_name").isNotNull() & F.col("city").isNotNull() & F.col("country").isNotNull())
    exists = r.join(restrict(t["airports"], r, "iata_code").select("iata_code", F.lit(True).alias("_ex")),
                    "iata_code", "left")
    out = _keyed_create(exists, "iata_code", [(422, R_INVALID, ~shape),
                                              (500, R_DB, (stored("airports", "terminals") < 1) | exceeds_type(
                                                  "airports", ("airport_name", "city", "country", "terminals")))],
                        1, F.col("_ex").isNotNull())
    acc = out.filter("accepted")
    a = t["airports"]
    new = acc.select(new_ids(a, "airport_id").alias("airport_id"), "airport_name", "iata_code",
                     "city", "country", "terminals", F.lit(True).alias("is_active"),
                     F.col("requested_at").alias("created_at"))
    return (out.select("request_id", "accepted", "code", "reason"),
            {"airports": a.unionByName(conform(new, a))})


def update_airports(t, requests: DataFrame):
    fields = ("airport_name", "city", "country", "terminals", "is_active")
    return _keyed_update(t, "airports", "airport_id", requests, fields, [],
                         _given("terminals") & (stored("airports", "terminals") < 1))


def deactivate_airports(t, requests: DataFrame):
    """Soft delete: is_active = false (deactivating again is allowed)."""
    r = requests.select("request_id", "requested_at", "airport_id",
                        F.array(F.lit("is_active")).alias("set_fields"),
                        F.lit(False).alias("is_active"))
    return _keyed_update(t, "airports", "airport_id", r, ("is_active",), [])


# --- aircraft ------------------------------------------------------------------------

def register_aircraft(t, requests: DataFrame):
    r = (requests.withColumn("status", F.coalesce(F.col("status"), F.lit("Active")))
         .withColumn("_ord", order_key()))
    shape = (F.col("registration_no").isNotNull() & F.col("model").isNotNull()
             & F.col("seat_capacity").isNotNull()
             & F.coalesce(F.col("status").isin(*AIRCRAFT_STATUS), F.lit(False)))
    r = r.join(restrict(t["aircraft"], r, "registration_no").select("registration_no", F.lit(True).alias("_ex")),
               "registration_no", "left")
    out = _keyed_create(r, "registration_no", [(422, R_INVALID, ~shape),
                                               (500, R_DB, (stored("aircraft", "seat_capacity") <= 0) | exceeds_type(
                                                   "aircraft", ("registration_no", "model", "seat_capacity")))],
                        1, F.col("_ex").isNotNull())
    acc = out.filter("accepted")
    a = t["aircraft"]
    new = acc.select(new_ids(a, "aircraft_id").alias("aircraft_id"), "registration_no", "model",
                     "seat_capacity", "status", F.col("requested_at").alias("created_at"))
    return (out.select("request_id", "accepted", "code", "reason"),
            {"aircraft": a.unionByName(conform(new, a))})


def update_aircraft(t, requests: DataFrame):
    fields = ("model", "seat_capacity", "status")
    bad_status = _given("status") & F.col("status").isNotNull() & ~F.col("status").isin(*AIRCRAFT_STATUS)
    return _keyed_update(t, "aircraft", "aircraft_id", requests, fields, [],
                         _given("seat_capacity") & (stored("aircraft", "seat_capacity") <= 0),
                         shape_bad=bad_status)


# --- flights -------------------------------------------------------------------------

def create_flights(t, requests: DataFrame):
    """Checks in order: flight_no taken 409; origin 404; destination 404; same
    airport 422; aircraft 404; aircraft not Active 422; base_fare <= 0, or a value
    that its column cannot hold, 500."""
    r = (requests.withColumn("_ord", order_key())
         .join(restrict(t["airports"], requests, "airport_id", "origin_airport_id").select(
             F.col("airport_id").alias("origin_airport_id"), F.lit(True).alias("_o")), "origin_airport_id", "left")
         .join(restrict(t["airports"], requests, "airport_id", "dest_airport_id").select(
             F.col("airport_id").alias("dest_airport_id"), F.lit(True).alias("_d")), "dest_airport_id", "left")
         .join(restrict(t["aircraft"], requests, "aircraft_id").select("aircraft_id", F.col("status").alias("_ast")),
               "aircraft_id", "left")
         .join(restrict(t["flights"], requests, "flight_no")
               .select("flight_no", F.lit(True).alias("_ex")).distinct(), "flight_no", "left"))
    shape = (F.col("flight_no").isNotNull() & F.col("origin_airport_id").isNotNull()
             & F.col("dest_airport_id").isNotNull() & F.col("aircraft_id").isNotNull()
             & F.col("base_fare").isNotNull())
    out = _keyed_create(r, "flight_no", [
        (422, R_INVALID, ~shape),
        (404, R_ORIGIN_404, F.col("_o").isNull()),
        (404, R_DEST_404, F.col("_d").isNull()),
        (422, R_SAME, F.col("origin_airport_id") == F.col("dest_airport_id")),
        (404, R_AIRCRAFT_404, F.col("_ast").isNull()),
        (422, R_AIRCRAFT_INACTIVE, F.col("_ast") != "Active"),
        (500, R_DB, (stored("flights", "base_fare") <= 0) | exceeds_type("flights", ("flight_no", "base_fare"))),
    ], 1, F.col("_ex").isNotNull())
    acc = out.filter("accepted")
    f = t["flights"]
    new = acc.select(new_ids(f, "flight_id").alias("flight_id"), "flight_no", "origin_airport_id",
                     "dest_airport_id", "aircraft_id", "base_fare",
                     F.lit("Scheduled").alias("status"), F.col("requested_at").alias("created_at"))
    return (out.select("request_id", "accepted", "code", "reason"),
            {"flights": f.unionByName(conform(new, f))})


def update_flights(t, requests: DataFrame):
    """404; if an aircraft is given (non-zero): 404, not Active 422; then set.
    Issued tickets keep their fare snapshot."""
    fields = ("aircraft_id", "base_fare", "status")
    given_ac = _given("aircraft_id") & F.col("aircraft_id").isNotNull() & (F.col("aircraft_id") != 0)
    r = requests.join(restrict(t["aircraft"], requests, "aircraft_id").select(
        "aircraft_id", F.col("status").alias("_ast")), "aircraft_id", "left")
    bad_status = _given("status") & F.col("status").isNotNull() & ~F.col("status").isin(*FLIGHT_STATUS)
    return _keyed_update(t, "flights", "flight_id", r, fields, [
        (404, R_AIRCRAFT_404, given_ac & F.col("_ast").isNull()),
        (422, R_AIRCRAFT_INACTIVE, given_ac & (F.col("_ast") != "Active")),
    ], (_given("base_fare") & (stored("flights", "base_fare") <= 0))
        | (_given("aircraft_id") & ~given_ac & F.col("aircraft_id").isNotNull()),
        shape_bad=bad_status)


# --- schedules -----------------------------------------------------------------------

def create_schedules(t, requests: DataFrame):
    """arr <= dep 422 (request validation, first); flight 404; the flight
    already has a schedule 409."""
    r = (requests.withColumn("_ord", order_key())
         .join(restrict(t["flights"], requests, "flight_id")
               .select("flight_id", F.lit(True).alias("_f")), "flight_id", "left")
         .join(restrict(t["flight_schedules"], requests, "flight_id")
               .select("flight_id", F.lit(True).alias("_ex")).distinct(), "flight_id", "left"))
    shape = (F.col("dep_datetime").isNotNull() & F.col("arr_datetime").isNotNull()
             & (F.col("arr_datetime") > F.col("dep_datetime")))
    out = _keyed_create(r, "flight_id", [(422, R_ARR_BEFORE_DEP, ~shape),
                                         (404, R_404, F.col("_f").isNull()),
                                         (500, R_DB, exceeds_type("flight_schedules", ("terminal", "gate")))],
                        2, F.col("_ex").isNotNull())
    acc = out.filter("accepted")
    s = t["flight_schedules"]
    new = acc.select(new_ids(s, "schedule_id").alias("schedule_id"), "flight_id", "dep_datetime",
                     "arr_datetime", F.lit(None).alias("actual_dep"), F.lit(None).alias("actual_arr"),
                     "terminal", "gate", F.col("requested_at").alias("created_at"))
    return (out.select("request_id", "accepted", "code", "reason"),
            {"flight_schedules": s.unionByName(conform(new, s))})


# --- staff ---------------------------------------------------------------------------

def create_staff(t, requests: DataFrame):
    """E-mail shape / role 422; e-mail taken 409 (its domain compared in lower case,
    as stored); a name or address too long 500; inserted active (directory columns
    only: credentials are not data work)."""
    r = requests.withColumn("email", normal_email()).withColumn("_ord", order_key())
    r = r.join(restrict(t["staff"], r, "email").select("email", F.lit(True).alias("_ex")), "email", "left")
    shape = (F.col("full_name").isNotNull()
             & F.coalesce(F.col("email").rlike(EMAIL_PATTERN), F.lit(False))
             & F.coalesce(F.col("role").isin(*STAFF_ROLE), F.lit(False)))
    out = _keyed_create(r, "email", [(422, R_INVALID, ~shape),
                                     (500, R_DB, exceeds_type("staff", ("full_name", "email")))], 1, F.col("_ex").isNotNull())
    acc = out.filter("accepted")
    s = t["staff"]
    new = acc.select(new_ids(s, "staff_id").alias("staff_id"), "full_name", "email", "role",
                     F.lit(True).alias("is_active"), F.col("requested_at").alias("created_at"))
    return (out.select("request_id", "accepted", "code", "reason"),
            {"staff": s.unionByName(conform(new, s))})


def update_staff(t, requests: DataFrame):
    fields = ("full_name", "role", "is_active")
    bad_role = _given("role") & F.col("role").isNotNull() & ~F.col("role").isin(*STAFF_ROLE)
    return _keyed_update(t, "staff", "staff_id", requests, fields, [], shape_bad=bad_role)


# --- schedule updates: a per-schedule fold ------------------------------------------

SCHEDULE_FIELDS = ("dep_datetime", "arr_datetime", "actual_dep", "actual_arr", "terminal", "gate")


_UNSET = -(1 << 63)  # a time that is not set, or null


def _schedule_walk(state, g: pd.DataFrame):
    """Validity of a block of one schedule's requests, in order.

    A request is valid iff the row that it leaves has arr > dep (a null time is an
    error: 500); only valid requests whose texts fit their columns move the state. A request that sets both times
    to a valid pair leaves that pair whatever the state is, so the block is cut
    after such requests, and the segments are walked in step: the k-th requests of
    all of them at once."""
    state = state or [int(g["dep0"].iat[0]), int(g["arr0"].iat[0])]
    sets_dep, sets_arr = g["sets_dep"].to_numpy(bool), g["sets_arr"].to_numpy(bool)
    dep, arr = g["dep"].fillna(_UNSET).to_numpy(np.int64), g["arr"].fillna(_UNSET).to_numpy(np.int64)
    error = (sets_dep & (dep == _UNSET)) | (sets_arr & (arr == _UNSET))
    fits = ~g["too_long"].to_numpy(bool)
    resets = sets_dep & sets_arr & ~error & (arr > dep) & fits
    first = np.flatnonzero(np.concatenate([[True], resets[:-1]]))
    size = np.diff(np.append(first, len(g)))
    # the state at the start of each segment
    now_dep = np.concatenate([[state[0]], dep[first[1:] - 1]]).astype(np.int64)
    now_arr = np.concatenate([[state[1]], arr[first[1:] - 1]]).astype(np.int64)
    valid = np.zeros(len(g), dtype=bool)
    open_ = np.arange(len(first))
    for k in range(int(size.max(initial=0))):
        open_ = open_[size[open_] > k]
        at = first[open_] + k
        new_dep, new_arr = np.where(sets_dep[at], dep[at], now_dep[open_]), np.where(sets_arr[at], arr[at], now_arr[open_])
        ok = ~error[at] & (new_arr > new_dep)
        valid[at] = ok
        ok &= fits[at]
        now_dep[open_], now_arr[open_] = np.where(ok, new_dep, now_dep[open_]), np.where(ok, new_arr, now_arr[open_])
    out = pd.DataFrame({"request_id": g["request_id"], "valid": valid, "null_error": error})
    return out, [int(now_dep[-1]), int(now_arr[-1])]


_WALKED = T.StructType([T.StructField("request_id", T.LongType()), T.StructField("valid", T.BooleanType()),
                        T.StructField("null_error", T.BooleanType())])


def update_schedules(t, requests: DataFrame):
    """404 without a schedule; the merged row must have arr > dep (422,
    nothing saved); a NULL departure or arrival, or a terminal or gate too long, is
    the database's 500.

    Each request is checked against the row left by the earlier accepted ones: a
    fold per schedule, which ``fold_in_blocks`` deals to many tasks. A block that
    holds a request with both times valid leaves the same state whatever it was
    given, so its successors are right after the second round."""
    s = restrict(t["flight_schedules"], requests, "flight_id").select(
        "flight_id", F.col("dep_datetime").alias("dep0"), F.col("arr_datetime").alias("arr0"))
    r = requests.withColumn("_ord", order_key()).join(s, "flight_id", "left")

    def micros(c: str) -> Column:
        return F.unix_micros(F.col(c).cast("timestamp")).alias(c.split("_")[0])

    too_long = exceeds_type("flight_schedules", ("terminal", "gate"), updates=True)
    cand = r.filter(F.col("dep0").isNotNull()).select(
        "flight_id", "requested_at", "request_id", micros("dep0"), micros("arr0"), micros("dep_datetime"),
        micros("arr_datetime"), _given("dep_datetime").alias("sets_dep"), _given("arr_datetime").alias("sets_arr"),
        too_long.alias("too_long"))
    folded = fold_in_blocks(cand, "flight_id", ["requested_at", "request_id"], _schedule_walk, _WALKED)
    r = r.join(folded, "request_id", "left")
    out = outcomes(r, [(404, R_404, F.col("dep0").isNull()),
                       (500, R_DB, F.col("null_error")),
                       (422, R_ARR_BEFORE_DEP, ~F.col("valid")),
                       (500, R_DB, too_long)], 200)
    new = _apply_updates(t["flight_schedules"], "flight_id", out.filter("accepted"), SCHEDULE_FIELDS)
    return out.select("request_id", "accepted", "code", "reason"), {"flight_schedules": new}
