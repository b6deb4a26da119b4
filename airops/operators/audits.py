"""Integrity audits: the constraints the reservation database enforces,
re-aimed as queries that count violations in a snapshot.

Every audit returns ``(constraint_name, table_name, violations bigint)``;
``audit_unique`` adds ``duplicated_keys``. Constraint names are those of the
data model (foreign keys, unnamed there, get the database's default
``<table>_<column>_fkey``).

Scale: uniqueness is a per-key count with map-side partial aggregation (a
hot key collapses to one row per map task); foreign keys pre-aggregate the
child per key before the anti join with the parent's keys, so a skewed key
costs one row in the join; checks and domain rules are one scan per table
with conditional counts, unpivoted with ``stack``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airops.operators.commands.fold import _kept
from airops.schema import (ENUM_COLUMNS, PRIMARY_KEYS, STRING_LENGTHS, TABLE_SCHEMAS)

# --- fixed values: constraints of the data model ---------------------------
UNIQUE_CONSTRAINTS = [  # (name, table, columns)
    ("uq_passenger_passport", "passengers", ("passport_no",)),
    ("uq_passenger_email", "passengers", ("email",)),
    ("uq_airport_iata", "airports", ("iata_code",)),
    ("uq_aircraft_registration", "aircraft", ("registration_no",)),
    ("uq_fare_class_name", "fare_classes", ("class_name",)),
    ("uq_staff_email", "staff", ("email",)),
    ("uq_flight_no", "flights", ("flight_no",)),
    ("uq_schedule_flight", "flight_schedules", ("flight_id",)),
    ("uq_seat_per_flight", "seats", ("flight_id", "seat_number")),
    ("uq_booking_pnr", "bookings", ("pnr",)),
    ("uq_passenger_per_flight", "bookings", ("flight_id", "passenger_id")),
    ("uq_ticket_booking", "tickets", ("booking_id",)),
    ("uq_ticket_no", "tickets", ("ticket_no",)),
    ("uq_payment_booking", "payments", ("booking_id",)),
    ("uq_boarding_booking", "boarding_records", ("booking_id",)),
]

FOREIGN_KEYS = [  # (table, column, parent table, parent key)
    ("flights", "origin_airport_id", "airports", "airport_id"),
    ("flights", "dest_airport_id", "airports", "airport_id"),
    ("flights", "aircraft_id", "aircraft", "aircraft_id"),
    ("flight_schedules", "flight_id", "flights", "flight_id"),
    ("seats", "flight_id", "flights", "flight_id"),
    ("seats", "fare_class_id", "fare_classes", "fare_class_id"),
    ("bookings", "passenger_id", "passengers", "passenger_id"),
    ("bookings", "flight_id", "flights", "flight_id"),
    ("bookings", "seat_id", "seats", "seat_id"),
    ("bookings", "staff_id", "staff", "staff_id"),
    ("tickets", "booking_id", "bookings", "booking_id"),
    ("tickets", "fare_class_id", "fare_classes", "fare_class_id"),
    ("payments", "booking_id", "bookings", "booking_id"),
    ("boarding_records", "booking_id", "bookings", "booking_id"),
    ("boarding_records", "passenger_id", "passengers", "passenger_id"),
    ("boarding_records", "flight_id", "flights", "flight_id"),
]

# (name, table, SQL boolean expression that must not be FALSE)
CHECK_CONSTRAINTS = [
    ("chk_gender", "passengers", "gender IN ('Male', 'Female', 'Other')"),
    ("chk_terminals", "airports", "terminals >= 1"),
    ("chk_seat_capacity", "aircraft", "seat_capacity > 0"),
    ("chk_multiplier", "fare_classes", "multiplier > 0"),
    ("chk_baggage", "fare_classes", "baggage_allowance_kg >= 0"),
    ("chk_different_airports", "flights", "origin_airport_id <> dest_airport_id"),
    ("chk_base_fare", "flights", "base_fare > 0"),
    ("chk_arr_after_dep", "flight_schedules", "arr_datetime > dep_datetime"),
    ("chk_cancel_reason", "bookings", "status != 'Cancelled' OR cancel_reason IS NOT NULL"),
    ("chk_final_fare", "tickets", "final_fare > 0"),
    ("chk_base_fare", "tickets", "base_fare > 0"),
    ("chk_multiplier", "tickets", "multiplier_snapshot > 0"),
    ("chk_amount", "payments", "amount > 0"),
    ("chk_refund_amount", "payments", "refund_amount >= 0"),
    ("chk_refund_on_cancel", "payments", "status != 'Refunded' OR refund_amount > 0"),
]

EMAIL_PATTERN = "^[^@ ]+@[^@ ]+[.][^@ ]+$"
EMAIL_COLUMNS = {"passengers": ("email",), "staff": ("email",)}
# --- end of fixed values -----------------------------------------------------

def _unpivot(agg: DataFrame, table: str, names: list[str]) -> DataFrame:
    """One-row frame of counts ``c0..cn`` -> rows (constraint_name, table_name, violations)."""
    args = ", ".join(f"'{n}', c{i}" for i, n in enumerate(names))
    return agg.selectExpr(f"stack({len(names)}, {args}) as (constraint_name, violations)") \
        .select("constraint_name", F.lit(table).alias("table_name"),
                F.coalesce(F.col("violations"), F.lit(0)).cast("bigint").alias("violations"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def unique_constraints(include_primary_keys: bool = True):
    out = [(f"{t}_pkey", t, (k,)) for t, k in PRIMARY_KEYS.items()] if include_primary_keys else []
    return out + UNIQUE_CONSTRAINTS


def _names(spark, rows: list[tuple], schema: str) -> DataFrame:
    """The (fixed, small) list of constraints as a DataFrame."""
    return spark.createDataFrame(rows, schema)


def audit_unique(t, include_primary_keys: bool = True) -> DataFrame:
    """Per unique constraint: keys that occur more than once and the excess rows.

    All constraints share one aggregation: each table contributes
    ``(constraint id, 64-bit hash of the key)`` rows (a key with a NULL
    component never conflicts, as in SQL), so unique keys cross the shuffle as
    a few bytes. Only rows whose hash repeats are then counted by the whole
    key, which makes the result exact. The repeated hashes are written first:
    where their bytes are few, the planner broadcasts them, and the whole keys of
    all other rows are not shuffled. Constraints without duplicates get a zero row."""
    cons = unique_constraints(include_primary_keys)
    parts = []
    for i, (_, table, cols) in enumerate(cons):
        df = t[table].filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))
        parts.append(df.select(F.lit(i).alias("cid"), F.xxhash64(*cols).alias("h"),
                               F.array(*[F.col(c).cast("string") for c in cols]).alias("k")))
    keys = _union(parts)
    repeated = (keys.groupBy("cid", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
                .select("cid", "h"))
    repeated = _kept(repeated, "repeated-keys")
    dup = (keys.join(repeated, ["cid", "h"], "left_semi")
           .groupBy("cid", "h", "k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
           .groupBy("cid").agg(F.count(F.lit(1)).alias("duplicated_keys"),
                               F.sum(F.col("n") - 1).alias("violations")))
    names = _names(t.spark, [(i, n, tb) for i, (n, tb, _) in enumerate(cons)],
                   "cid int, constraint_name string, table_name string")
    return (names.join(dup, "cid", "left")
            .select("constraint_name", "table_name",
                    F.coalesce(F.col("duplicated_keys"), F.lit(0)).cast("bigint").alias("duplicated_keys"),
                    F.coalesce(F.col("violations"), F.lit(0)).cast("bigint").alias("violations")))


def audit_foreign_keys(t) -> DataFrame:
    """Per foreign key: child rows whose (non-NULL) key has no parent row.

    One plan for all keys: child keys are counted per (parent table, key),
    with one counter for each of the parent's foreign keys -- a hot key becomes
    one row per map task -- and anti-joined with the union of the parent
    tables' keys on the same two columns, so both need one shuffle only."""
    slots: list[tuple[str, int]] = []  # of each foreign key: its parent and its place among the parent's
    for _, _, parent, _ in FOREIGN_KEYS:
        slots.append((parent, sum(1 for p, _ in slots if p == parent)))
    width = 1 + max(slot for _, slot in slots)
    children = _union([
        t[table].filter(F.col(col).isNotNull())
        .select(F.lit(parent).alias("parent"), F.col(col).cast("bigint").alias("key"), F.lit(slot).alias("slot"))
        for (table, col, _, _), (parent, slot) in zip(FOREIGN_KEYS, slots)])
    per_key = children.groupBy("parent", "key").agg(
        *[F.count_if(F.col("slot") == s).alias(f"n{s}") for s in range(width)])
    parent_tables = sorted({(p, k) for _, _, p, k in FOREIGN_KEYS})
    parents = _union([t[p].select(F.lit(p).alias("parent"), F.col(k).cast("bigint").alias("key"))
                      for p, k in parent_tables])
    lost = (per_key.join(parents, ["parent", "key"], "left_anti")
            .groupBy("parent").agg(*[F.sum(f"n{s}").alias(f"n{s}") for s in range(width)]))
    orphans = lost.select("parent", F.posexplode(F.array(*[f"n{s}" for s in range(width)]))
                          .alias("slot", "violations"))
    of_slot = _names(t.spark, [(i, p, s) for i, (p, s) in enumerate(slots)], "fid int, parent string, slot int")
    orphans = orphans.join(of_slot, ["parent", "slot"]).select("fid", "violations")
    names = _names(t.spark, [(i, f"{tb}_{c}_fkey", tb) for i, (tb, c, _, _) in enumerate(FOREIGN_KEYS)],
                   "fid int, constraint_name string, table_name string")
    return (names.join(orphans, "fid", "left")
            .select("constraint_name", "table_name",
                    F.coalesce(F.col("violations"), F.lit(0)).cast("bigint").alias("violations")))


def audit_checks(t) -> DataFrame:
    """Per CHECK constraint: rows for which it is FALSE (NULL passes)."""
    frames = []
    for table in TABLE_SCHEMAS:
        checks = [(n, e) for n, tb, e in CHECK_CONSTRAINTS if tb == table]
        if not checks:
            continue
        agg = t[table].agg(*[F.count(F.when(~F.expr(e), 1)).alias(f"c{i}")
                             for i, (_, e) in enumerate(checks)])
        frames.append(_unpivot(agg, table, [n for n, _ in checks]))
    return _union(frames)


def domain_rules(table: str) -> list[tuple[str, str]]:
    """(rule name, SQL condition that marks a violating row) for one table."""
    rules = []
    for f in TABLE_SCHEMAS[table].fields:
        if not f.nullable:
            rules.append((f"not_null:{f.name}", f"{f.name} IS NULL"))
    for c, n in STRING_LENGTHS.get(table, {}).items():
        rules.append((f"length:{c}", f"length({c}) > {n}"))
    for c, values in ENUM_COLUMNS.get(table, {}).items():
        lst = ", ".join(f"'{v}'" for v in values)
        rules.append((f"enum:{c}", f"{c} IS NOT NULL AND {c} NOT IN ({lst})"))
    for c in EMAIL_COLUMNS.get(table, ()):
        rules.append((f"email:{c}", f"{c} IS NOT NULL AND NOT regexp_like({c}, '{EMAIL_PATTERN}')"))
    return rules


def audit_domain(t) -> DataFrame:
    """Not-null, declared string length, enum membership and email shape."""
    frames = []
    for table in TABLE_SCHEMAS:
        rules = domain_rules(table)
        agg = t[table].agg(*[F.count(F.when(F.expr(cond), 1)).alias(f"c{i}")
                             for i, (_, cond) in enumerate(rules)])
        frames.append(_unpivot(agg, table, [n for n, _ in rules]))
    return _union(frames)
