"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import datetime as _dt
import uuid as _uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as _F

from airops.operators import audits as A
from airops.operators import listings as L
from airops.operators import reports as R
from airops.operators import views as V
from airops.operators.commands import booking_flow as BF
from airops.operators.commands import bookings_admit as BA
from airops.operators.commands import log as CL
from airops.operators.commands import passengers as PC
from airops.operators.commands import reference_data as RD
from airops.schema import TABLES
from airops.session import scratch_path
from airops.sources import store
from airops.sources.tables import airline_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# parameters of the registered queries
DATE_FROM, DATE_TO = "1994-01-01", "1996-06-30"
GENERATED_AT = "2024-06-01 00:00:00"
MANIFEST_STATUS = "No_Show"
STORE_BUCKETS = 16
PASSENGER_SEARCH = "customer#0000001"
AIRPORT_SEARCH, AIRPORT_COUNTRY = "a", "A"
FLIGHT_ORIGIN, FLIGHT_DEST = "aab", "zzz"


def _t(spark, sf_dir):
    return airline_tables(spark, sf_dir)


def _simple(name: str, fn: Callable, *args, **kw) -> None:
    QUERIES[name] = lambda spark, sf_dir: fn(_t(spark, sf_dir), *args, **kw)


# --- 2.2 reports -------------------------------------------------------------
_simple("revenue_summary", R.revenue_summary)
_simple("revenue_summary_dated", R.revenue_summary_dated, DATE_FROM, DATE_TO)
for _n in ("revenue_by_class", "revenue_by_route", "revenue_by_method", "top_flights"):
    _simple(_n, getattr(R, _n))
    _simple(f"{_n}_dated", getattr(R, _n), DATE_FROM, DATE_TO)
for _n in ("flights_by_status", "seat_occupancy", "noshow_rates", "ontime_performance",
           "overall_stats"):
    _simple(_n, getattr(R, _n))
QUERIES["revenue_report"] = lambda spark, d: R.revenue_report(_t(spark, d))
_simple("revenue_report_rows", R.revenue_report_rows)
_simple("operational_report_rows", R.operational_report_rows)
QUERIES["operational_report"] = lambda spark, d: R.operational_report(_t(spark, d))["summary"]

# --- 2.3 views ---------------------------------------------------------------


for _n in ("boarding_list", "boarding_summary", "flight_manifest", "travel_history",
           "travel_history_summary", "seat_map", "seat_availability", "flight_details"):
    _simple(_n, getattr(V, _n))
_simple("manifest_filtered", V.manifest_filtered, MANIFEST_STATUS)
_simple("manifest_header", V.manifest_header, _dt.datetime.fromisoformat(GENERATED_AT))

# --- 2.4 listings and lookups ------------------------------------------------------


_simple("list_passengers", L.list_passengers, PASSENGER_SEARCH, skip=50, limit=50)
_simple("list_passengers_total", L.list_passengers_total, PASSENGER_SEARCH)
_simple("list_airports", L.list_airports, AIRPORT_SEARCH, AIRPORT_COUNTRY, True, skip=0, limit=10)
_simple("list_airports_total", L.list_airports_total, AIRPORT_SEARCH, AIRPORT_COUNTRY, True)
_simple("list_aircraft", L.list_aircraft, "Active", skip=10, limit=20)
_simple("list_aircraft_total", L.list_aircraft_total, "Active")
_simple("list_fare_classes", L.list_fare_classes)
_simple("list_staff", L.list_staff)
_simple("list_flights", L.list_flights, "Scheduled", FLIGHT_ORIGIN, FLIGHT_DEST, skip=0, limit=50)
_simple("list_flights_total", L.list_flights_total, "Scheduled", FLIGHT_ORIGIN, FLIGHT_DEST)
_simple("list_bookings", L.list_bookings, 0, 0, "Cancelled", skip=0, limit=200)
_simple("list_bookings_deep", L.list_bookings, skip=12_000, limit=200)


def _lookup_keys(t, kind):
    br = t.extra("booking_requests")
    f = t["flights"]
    return {
        "passenger": lambda: br.select(_F.col("passenger_id").alias("key")),
        "flight": lambda: br.select(_F.col("flight_id").alias("key")),
        "schedule": lambda: br.select(_F.col("flight_id").alias("key")),
        "booking": lambda: br.select(_F.col("request_id").alias("key")),
        "payment": lambda: br.select(_F.col("request_id").alias("key")),
        "ticket": lambda: br.select(_F.col("request_id").alias("key")),
        "airport": lambda: f.select(_F.col("origin_airport_id").alias("key")).unionByName(
            f.select(_F.col("dest_airport_id").alias("key"))),
        "aircraft": lambda: f.select(_F.col("aircraft_id").alias("key")),
        "staff": lambda: t["bookings"].select(_F.col("staff_id").alias("key")),
        "fare_class": lambda: t["seats"].select(_F.col("fare_class_id").alias("key")),
    }[kind]()


def _reg_lookup(kind):
    def run(spark, d):
        t = _t(spark, d)
        return L.bulk_lookup(t, kind, _lookup_keys(t, kind))
    QUERIES[f"bulk_lookup_{kind}"] = run


for _k in L.LOOKUPS:
    _reg_lookup(_k)


def _code_keys(t, prefix):
    return t.extra("booking_requests").select(_F.lower(_F.concat(
        _F.lit(prefix), _F.lpad(_F.col("request_id").cast("string"), 8, "0"))).alias("key"))


QUERIES["bulk_lookup_pnr"] = lambda spark, d: L.bulk_lookup_pnr(
    _t(spark, d), _code_keys(_t(spark, d), "PNR"))
QUERIES["bulk_lookup_ticket_no"] = lambda spark, d: L.bulk_lookup_ticket_no(
    _t(spark, d), _code_keys(_t(spark, d), "TKT-"))

# --- 2.6 audits ------------------------------------------------------------------

for _n in ("audit_unique", "audit_foreign_keys", "audit_checks", "audit_domain"):
    _simple(_n, getattr(A, _n))

# --- 2.5 command batches -----------------------------------------------------------


def _cmd(name, fn, batch, after=None):
    def run(spark, d):
        t = _t(spark, d)
        return fn(t, t.extra(batch))
    QUERIES[name] = lambda spark, d: run(spark, d)[0]
    if after:
        for suffix, (table, proj) in after.items():
            QUERIES[f"{name}_{suffix}"] = (
                lambda spark, d, table=table, proj=proj: proj(run(spark, d)[1][table]))


_cmd("cancel_bookings", BF.cancel_bookings, "cancel_requests", {
    "after": ("bookings", lambda df: df.select("booking_id", "status", "cancel_reason",
                                               "cancelled_at")),
    "seats": ("seats", lambda df: df.select("seat_id", "status")),
    "payments": ("payments", lambda df: df.select(
        "booking_id", "status", _F.col("refund_amount").cast("double"), "updated_at")),
    "tickets": ("tickets", lambda df: df.select("ticket_id", "is_cancelled"))})


def _write_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Bookings and seats read back from a bucketed store, before (version 0) and
    after (version 1) the batch of cancellations was published to it."""
    t = _t(spark, d)
    path = scratch_path(spark, f"airops-store-{_uuid.uuid4().hex}")
    base = store.create_store(t, path, STORE_BUCKETS)
    _, changed = BF.cancel_bookings(base.tables, t.extra("cancel_requests"))
    after = store.commit_batch(base, changed)
    out = None
    for s in (base, after):
        for table, key in (("bookings", "booking_id"), ("seats", "seat_id")):
            part = s.tables[table].select(_F.lit(s.version).alias("version"), _F.lit(table).alias("table_name"),
                                          _F.col(key).alias("id"), "status")
            out = part if out is None else out.unionByName(part)
    return out


QUERIES["write_snapshot"] = _write_snapshot
_cmd("process_payments", BF.process_payments, "payment_requests", {
    "tickets": ("tickets", lambda df: df.filter(_F.col("ticket_no").startswith("TKT-R")).select(
        "booking_id", "fare_class_id", "ticket_no", _F.col("base_fare").cast("double"),
        _F.col("multiplier_snapshot").cast("double"), _F.col("final_fare").cast("double"),
        "issue_date", "is_cancelled")),
    "payments": ("payments", lambda df: df.select(
        "booking_id", "method", _F.col("amount").cast("double"), "status",
        _F.col("refund_amount").cast("double"), "payment_date", "updated_at")),
    "bookings": ("bookings", lambda df: df.select("booking_id", "status"))})
_cmd("record_boarding", BF.record_boarding, "boarding_events", {
    "after": ("boarding_records", lambda df: df.select("booking_id", "status", "boarded_at",
                                                       "passenger_id", "flight_id")),
    "seats": ("seats", lambda df: df.select("seat_id", "status"))})


_cmd("admit_bookings", BA.admit_bookings, "booking_requests", {
    "new": ("bookings", lambda df: df.filter(_F.col("pnr").startswith("R")).select(
        "passenger_id", "flight_id", "seat_id", "staff_id", "pnr", "status", "booked_at")),
    "seats": ("seats", lambda df: df.select("seat_id", "status"))})


_cmd("apply_commands", CL.apply_commands, "command_log", {
    "bookings": ("bookings", lambda df: df.select(
        "passenger_id", "flight_id", "seat_id", "pnr", "status", "cancel_reason", "cancelled_at")),
    "seats": ("seats", lambda df: df.select("seat_id", "status"))})


_cmd("register_passengers", PC.register_passengers, "passenger_requests", {
    "new": ("passengers", lambda df: df.filter(_F.col("passport_no").startswith("N")).select(
        "full_name", "gender", "passport_no", "email", "created_at"))})


_FARE = "cast(base_fare as double) as base_fare"

for _op, _batch, _table, _proj in [
    ("create_airports", "airport_create_requests", "airports",
     ["airport_name", "iata_code", "city", "country", "terminals", "is_active", "created_at"]),
    ("update_airports", "airport_update_requests", "airports",
     ["airport_id", "airport_name", "city", "country", "terminals", "is_active"]),
    ("deactivate_airports", "airport_deactivate_requests", "airports", ["airport_id", "is_active"]),
    ("register_aircraft", "aircraft_create_requests", "aircraft",
     ["registration_no", "model", "seat_capacity", "status", "created_at"]),
    ("update_aircraft", "aircraft_update_requests", "aircraft",
     ["aircraft_id", "model", "seat_capacity", "status"]),
    ("create_flights", "flight_create_requests", "flights",
     ["flight_no", "origin_airport_id", "dest_airport_id", "aircraft_id", _FARE, "status", "created_at"]),
    ("update_flights", "flight_update_requests", "flights",
     ["flight_id", "aircraft_id", _FARE, "status"]),
    ("create_schedules", "schedule_create_requests", "flight_schedules",
     ["flight_id", "dep_datetime", "arr_datetime", "terminal", "gate", "created_at"]),
    ("create_staff", "staff_create_requests", "staff", ["full_name", "email", "role", "is_active", "created_at"]),
    ("update_staff", "staff_update_requests", "staff", ["staff_id", "full_name", "role", "is_active"]),
]:
    _cmd(_op, getattr(RD, _op), _batch, {"after": (_table, lambda df, c=_proj: df.selectExpr(*c))})

_cmd("delete_passengers", PC.delete_passengers, "passenger_delete_requests", {
    "after": ("passengers", lambda df: df.select("passenger_id", "full_name"))})

_cmd("update_schedules", RD.update_schedules, "schedule_update_requests", {
    "after": ("flight_schedules", lambda df: df.select("flight_id", "dep_datetime", "arr_datetime",
                                                       "actual_dep", "gate"))})

_cmd("update_passengers", PC.update_passengers, "passenger_update_requests", {
    "after": ("passengers", lambda df: df.select("passenger_id", "full_name", "gender",
                                                 "nationality", "phone", "email"))})


# --- 2.1 sources: each bound table, whole ---------------------------------------------
def _table(name: str) -> Query:
    return lambda spark, d: _t(spark, d)[name]


for _name in TABLES:
    QUERIES[f"airline_tables_{_name}"] = _table(_name)
