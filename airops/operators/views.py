"""Denormalised views: boarding list, manifest, travel history, seat map.

The reservation system builds these one request at a time by lazy navigation
(an N+1 of single-row loads). Here each view is one join plan over all
flights / passengers at once, with an optional key filter that Catalyst
pushes down to the scans.

Join order: booking-keyed tables (tickets, payments, boarding records) are
joined on booking_id first, so they share one partitioning; flight-level
attributes (flight, schedule, airports) are assembled per flight before they
meet the bookings, so the wide booking rows are shuffled once per key.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airops.functions.numeric import pct_half_even

NOT_BOARDED = "Not Boarded"  # fixed value: status shown without a boarding record


def _flight_filter(df: DataFrame, flight_id) -> DataFrame:
    return df if flight_id is None else df.filter(F.col("flight_id") == F.lit(flight_id))


def _flight_info(t) -> DataFrame:
    """flight_id, flight_no, flight_status, origin/destination IATA."""
    oa = t.dim("airports").select(F.col("airport_id").alias("origin_airport_id"),
                                  F.col("iata_code").alias("origin_iata"))
    da = t.dim("airports").select(F.col("airport_id").alias("dest_airport_id"),
                                  F.col("iata_code").alias("destination_iata"))
    return (t["flights"].select("flight_id", "flight_no", F.col("status").alias("flight_status"),
                                "origin_airport_id", "dest_airport_id")
            .join(oa, "origin_airport_id").join(da, "dest_airport_id")
            .drop("origin_airport_id", "dest_airport_id"))


def _seat_class(t) -> DataFrame:
    fc = t.dim("fare_classes").select("fare_class_id", F.col("class_name").alias("travel_class"))
    return t["seats"].select("seat_id", "seat_number", "fare_class_id").join(fc, "fare_class_id")


def boarding_list(t, flight_id=None) -> DataFrame:
    """Confirmed bookings of each flight with passenger, seat, class, ticket and
    boarding status ('Not Boarded' without a record)."""
    b = _flight_filter(t["bookings"], flight_id).filter(F.col("status") == "Confirmed")
    b = b.join(t["flights"].select("flight_id"), "flight_id", "left_semi")
    br = t["boarding_records"].select("booking_id", F.col("status").alias("br_status"),
                                      "boarded_at")
    tk = t["tickets"].select("booking_id", "ticket_no")
    p = t["passengers"].select("passenger_id", F.col("full_name").alias("passenger_name"),
                               "passport_no")
    j = (b.select("booking_id", "pnr", "passenger_id", "flight_id", "seat_id")
         .join(tk, "booking_id", "left").join(br, "booking_id", "left")
         .join(p, "passenger_id").join(_seat_class(t), "seat_id"))
    return j.select("flight_id", "booking_id", "pnr", "passenger_id", "passenger_name",
                    "passport_no", "seat_number", "travel_class", "ticket_no",
                    F.coalesce(F.col("br_status"), F.lit(NOT_BOARDED)).alias("boarding_status"),
                    "boarded_at")


def boarding_summary(t, flight_id=None) -> DataFrame:
    """Per flight: confirmed, boarded, boarding_percent (1 dp, ties to even).

    A flight without Confirmed bookings gives a zero row."""
    b = (_flight_filter(t["bookings"], flight_id).filter(F.col("status") == "Confirmed")
         .select("booking_id", "flight_id"))
    br = t["boarding_records"].select("booking_id", F.col("status").alias("br_status"))
    agg = (b.join(br, "booking_id", "left").groupBy("flight_id")
           .agg(F.count(F.lit(1)).alias("total_confirmed"),
                F.count(F.when(F.col("br_status") == "Boarded", 1)).alias("total_boarded")))
    f = _flight_filter(t["flights"], flight_id).select(
        "flight_id", "flight_no", F.col("status").alias("flight_status"))
    j = f.join(agg, "flight_id", "left")
    conf = F.coalesce(F.col("total_confirmed"), F.lit(0)).cast("bigint")
    boarded = F.coalesce(F.col("total_boarded"), F.lit(0)).cast("bigint")
    return j.select("flight_id", "flight_no", "flight_status", conf.alias("total_confirmed"),
                    boarded.alias("total_boarded"),
                    pct_half_even(boarded, conf).alias("boarding_percent"))


MANIFEST_COLUMNS = ("flight_no", "flight_id", "scheduled_departure", "scheduled_arrival",
                    "origin_iata", "destination_iata", "passenger_id", "passenger_name",
                    "passport_no", "seat_number", "travel_class", "ticket_no", "pnr",
                    "booking_id", "booking_status", "boarding_status", "boarded_at",
                    "final_fare")


def flight_manifest(t, flight_id=None) -> DataFrame:
    """The 18-column flight manifest, each flight's rows together and by seat number.

    The manifest view's SQL is not part of the reservation system's sources
    (only its name and columns are); this definition is inferred: bookings of
    every status joined to flight, airports, passenger, seat and class, with
    schedule, ticket and boarding record optional, and boarding_status
    defaulting to 'Not Boarded' as in the boarding list."""
    b = _flight_filter(t["bookings"], flight_id).select(
        "booking_id", "pnr", "passenger_id", "flight_id", "seat_id",
        F.col("status").alias("booking_status"))
    tk = t["tickets"].select("booking_id", "ticket_no", "final_fare")
    br = t["boarding_records"].select("booking_id", F.col("status").alias("br_status"),
                                      "boarded_at")
    p = t["passengers"].select("passenger_id", F.col("full_name").alias("passenger_name"),
                               "passport_no")
    sch = t["flight_schedules"].select("flight_id",
                                       F.col("dep_datetime").alias("scheduled_departure"),
                                       F.col("arr_datetime").alias("scheduled_arrival"))
    fi = _flight_filter(_flight_info(t), flight_id).drop("flight_status").join(
        sch, "flight_id", "left")
    j = (b.join(tk, "booking_id", "left").join(br, "booking_id", "left")
         .join(p, "passenger_id").join(_seat_class(t), "seat_id").join(fi, "flight_id"))
    return (j.select(*[c for c in MANIFEST_COLUMNS if c not in ("boarding_status", "final_fare")],
                     F.coalesce(F.col("br_status"), F.lit(NOT_BOARDED)).alias("boarding_status"),
                     F.col("final_fare").cast("double").alias("final_fare"))
            .select(*MANIFEST_COLUMNS)
            .repartition("flight_id").sortWithinPartitions("flight_id", "seat_number", "booking_id"))


def manifest_filtered(t, status: str, flight_id=None) -> DataFrame:
    """Manifest rows whose boarding_status equals ``status``, case-insensitively."""
    m = flight_manifest(t, flight_id)
    return m.filter(F.lower(F.col("boarding_status")) == F.lit(status.lower()))


def manifest_header(t, generated_at: dt.datetime, status: str | None = None) -> DataFrame:
    """Per flight: flight_no, origin, destination, passenger total, generated_at.

    ``generated_at`` is a job parameter, so reruns give the same rows."""
    if status is None:  # tickets, records and schedules add no row and are not read
        m = (t["bookings"].select("flight_id", "passenger_id", "seat_id")
             .join(t["passengers"].select("passenger_id"), "passenger_id", "left_semi")
             .join(_seat_class(t).select("seat_id"), "seat_id", "left_semi"))
    else:
        m = manifest_filtered(t, status)
    counts = m.groupBy("flight_id").agg(F.count(F.lit(1)).alias("total_passengers"))
    fi = _flight_info(t)
    return (fi.join(counts, "flight_id", "left")
            .select("flight_id", "flight_no", F.col("origin_iata").alias("origin"),
                    F.col("destination_iata").alias("destination"),
                    F.coalesce(F.col("total_passengers"), F.lit(0)).cast("bigint")
                    .alias("total_passengers"),
                    # a string literal: a datetime literal would pass through the local zone
                    F.to_timestamp_ntz(F.lit(generated_at.isoformat(sep=" ")))
                    .alias("generated_at")))


def travel_history(t, passenger_id=None) -> DataFrame:
    """Every booking of each passenger, a passenger's rows together and newest
    first, with flight, schedule, seat, class, ticket and payment (the last
    three optional)."""
    b = t["bookings"]
    if passenger_id is not None:
        b = b.filter(F.col("passenger_id") == F.lit(passenger_id))
    b = b.join(t["passengers"].select("passenger_id"), "passenger_id", "left_semi")
    b = b.select("booking_id", "passenger_id", "pnr", F.col("status").alias("booking_status"),
                 "booked_at", "cancelled_at", "flight_id", "seat_id")
    tk = t["tickets"].select("booking_id", "ticket_no", "final_fare")
    pay = t["payments"].select("booking_id", F.col("status").alias("payment_status"),
                               F.col("method").alias("payment_method"))
    sch = t["flight_schedules"].select("flight_id",
                                       F.col("dep_datetime").alias("scheduled_departure"),
                                       F.col("arr_datetime").alias("scheduled_arrival"))
    fi = _flight_info(t).join(sch, "flight_id", "left")
    j = (b.join(tk, "booking_id", "left").join(pay, "booking_id", "left")
         .join(_seat_class(t), "seat_id").join(fi, "flight_id"))
    return (j.select("passenger_id", "booking_id", "pnr", "booking_status", "booked_at",
                     "cancelled_at", "flight_no", F.col("origin_iata").alias("origin"),
                     F.col("destination_iata").alias("destination"), "scheduled_departure",
                     "scheduled_arrival", "flight_status", "seat_number", "travel_class",
                     "ticket_no", F.col("final_fare").cast("double").alias("final_fare"),
                     "payment_status", "payment_method")
            .repartition("passenger_id")
            .sortWithinPartitions("passenger_id", F.desc("booked_at"), "booking_id"))


def travel_history_summary(t) -> DataFrame:
    """passenger_id, full_name, passport_no, total_trips (all bookings, 0 if none)."""
    n = t["bookings"].groupBy("passenger_id").agg(F.count(F.lit(1)).alias("total_trips"))
    p = t["passengers"].select("passenger_id", "full_name", "passport_no")
    return (p.join(n, "passenger_id", "left")
            .select("passenger_id", "full_name", "passport_no",
                    F.coalesce(F.col("total_trips"), F.lit(0)).cast("bigint").alias("total_trips")))


def seat_map(t, flight_id=None) -> DataFrame:
    """Seats of each existing flight with their class name."""
    s = _flight_filter(t["seats"], flight_id).join(t["flights"].select("flight_id"), "flight_id",
                                                   "left_semi")
    fc = t.dim("fare_classes").select("fare_class_id", "class_name")
    return s.join(fc, "fare_class_id").select("seat_id", "flight_id", "fare_class_id",
                                              "seat_number", "status", "class_name")


def seat_availability(t, flight_id=None) -> DataFrame:
    """Per flight: total, available, reserved, occupied seats (zeros without seats)."""
    st = F.col("status")
    agg = (_flight_filter(t["seats"], flight_id).groupBy("flight_id")
           .agg(F.count(F.lit(1)).alias("total_seats"),
                F.count(F.when(st == "Available", 1)).alias("available_seats"),
                F.count(F.when(st == "Reserved", 1)).alias("reserved_seats"),
                F.count(F.when(st == "Occupied", 1)).alias("occupied_seats")))
    f = _flight_filter(t["flights"], flight_id).select("flight_id")
    cols = ("total_seats", "available_seats", "reserved_seats", "occupied_seats")
    return f.join(agg, "flight_id", "left").select(
        "flight_id", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in cols])


def flight_details(t) -> DataFrame:
    """Flights with origin_iata, dest_iata and aircraft_model."""
    oa = t.dim("airports").select(F.col("airport_id").alias("origin_airport_id"),
                                  F.col("iata_code").alias("origin_iata"))
    da = t.dim("airports").select(F.col("airport_id").alias("dest_airport_id"),
                                  F.col("iata_code").alias("dest_iata"))
    ac = t["aircraft"].select("aircraft_id", F.col("model").alias("aircraft_model"))
    f = t["flights"]
    return (f.join(oa, "origin_airport_id").join(da, "dest_airport_id").join(ac, "aircraft_id")
            .select(*f.columns, "origin_iata", "dest_iata", "aircraft_model")
            .withColumn("base_fare", F.col("base_fare").cast("double")))
