"""Which booking requests are admitted, with the meaning "one at a time, in order".

Checks, in the reservation system's order: passenger 404; flight 404; flight
Departed/Arrived/Cancelled 422; passenger already holds a live booking on the
flight 409; seat not on the flight 404; seat not Available 409; flight at
capacity (Pending + Confirmed >= seat_capacity) 409; then the database's own
unique key on (flight, passenger) (a Cancelled booking still holds it) and
foreign keys give 500.

Static checks are joins against the snapshot, restricted to the batch's keys.
What a request leaves to later ones (its seat, its passenger's place, one place
of the flight) stays inside the flight, so requests are folded in order per
flight, together with the cancellations and boardings that free and take seats.
The fold runs in blocks (``fold.py``): a busy flight is walked by many tasks, and
a chain of requests that decide one another takes one round, however long,
unless it crosses blocks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airops.operators.commands.common import restrict
from airops.operators.commands.fold import _kept, fold_in_blocks
from airops.schema import CLOSED_FLIGHT_STATUS
from airops.session import drop_tables, temporary

# --- fixed values: outcome reasons ----------------------------------------------
R_INVALID = "invalid_request"
R_PAX_404 = "passenger_not_found"
R_FLIGHT_404 = "flight_not_found"
R_FLIGHT_CLOSED = "flight_closed"
R_DUPLICATE = "duplicate_booking"
R_SEAT_404 = "seat_not_on_flight"
R_SEAT_TAKEN = "seat_unavailable"
R_FULL = "flight_full"
R_DB = "constraint_violation"
# --- end of fixed values ----------------------------------------------------------


def _walk(state: dict | None, g: pd.DataFrame):
    """Codes of the booking requests of a block, in order; the state is what earlier
    requests and events changed: seats' status, live bookings, passengers who hold
    (true) or held a booking of the log, and the bookings made that events refer to."""
    state = state or {"seats": {}, "live": 0, "holds": {}, "made": []}
    seats, live, holds, made = state["seats"], state["live"], state["holds"], set(state["made"])
    ids, codes, reasons = [], [], []
    columns = ("event", "request_id", "seat_id", "passenger_id", "sstatus", "cap", "nlive", "dup", "seat_ok", "cap_ok",
               "barred", "watched")
    for event, rid, seat, pax, sstatus, cap, nlive, dup, seat_ok, cap_ok, barred, watched in zip(
            *(g[c].tolist() for c in columns)):
        seat, pax = str(seat), str(pax)
        if event == "book":
            if dup or holds.get(pax):
                code, reason = 409, R_DUPLICATE
            elif not seat_ok:
                code, reason = 404, R_SEAT_404
            elif seats.get(seat, sstatus) != "Available":
                code, reason = 409, R_SEAT_TAKEN
            elif not cap_ok:
                code, reason = 500, R_DB
            elif nlive + live >= cap:
                code, reason = 409, R_FULL
            elif barred or pax in holds:
                code, reason = 500, R_DB
            else:
                code, reason = 201, "ok"
                seats[seat], holds[pax], live = "Reserved", True, live + 1
                if watched:
                    made.add(rid)
            ids.append(rid)
            codes.append(code)
            reasons.append(reason)
        elif event == "left":  # a live booking of the snapshot was cancelled
            live -= 1
        elif event in ("free", "occupy"):
            seats[seat] = "Available" if event == "free" else "Occupied"
        elif rid in made:  # events of a booking of this log, if it was made
            seats[seat] = "Occupied" if event == "occupy_made" else "Available"
            if event == "cancel_made":
                holds[pax], live = False, live - 1
    return ({"request_id": ids, "code": codes, "reason": reasons},
            {"seats": seats, "live": live, "holds": holds, "made": sorted(made)})


_WALKED = T.StructType([T.StructField("request_id", T.LongType()), T.StructField("code", T.IntegerType()),
                        T.StructField("reason", T.StringType())])


def decide_bookings(t, books: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """request_id, code and reason of every booking request.

    ``books`` has request_id, the ids of a request and ``_ord``. ``known``: bookings
    that other commands change (``target``: the id in the snapshot, or minus the
    request's id, less one), with flight, seat, passenger, first cancellation ``c``
    and boarding ``b`` (orders, or null), ``b_first`` and ``record``."""
    with temporary() as keep:
        return keep(_kept(_decided(t, books, known), "decided"))


def _decided(t, books: DataFrame, known: DataFrame | None) -> DataFrame:
    pax = restrict(t["passengers"], books, "passenger_id").select("passenger_id", F.lit(True).alias("_pax"))
    fl = restrict(t["flights"], books, "flight_id")
    fl = fl.select("flight_id", F.col("status").alias("_fstatus"), "aircraft_id").join(
        restrict(t["aircraft"], fl, "aircraft_id").select("aircraft_id", F.col("seat_capacity").alias("cap")),
        "aircraft_id", "left").drop("aircraft_id")
    if known is None:
        known = t["bookings"].limit(0).select(
            F.col("booking_id").alias("target"), "flight_id", "seat_id", "passenger_id", F.lit("").alias("b_first"),
            F.lit(True).alias("record"), *[F.lit(None).cast(books.schema["_ord"].dataType).alias(c) for c in "cb"])
    held = restrict(t["bookings"], books, "flight_id").join(
        known.where("target >= 0").select(F.col("target").alias("booking_id"), "c"), "booking_id", "left")
    live = held.where(F.col("status").isin("Pending", "Confirmed")).groupBy("flight_id").agg(
        F.count(F.lit(1)).cast("int").alias("nlive"))
    active = F.col("status") != "Cancelled"
    pairs = held.groupBy("flight_id", "passenger_id").agg(
        F.max(active).alias("_active"), F.max(active & F.col("c").isNull()).alias("_stays"),
        F.max(F.when(active, F.col("c"))).alias("_until"))
    seat = restrict(t["seats"], books, "seat_id").select(
        "seat_id", F.col("flight_id").alias("_sflight"), F.col("status").alias("sstatus"))
    staff = restrict(t["staff"], books, "staff_id").select("staff_id", F.lit(True).alias("_staff"))
    watched = known.where("target < 0 and (c is not null or b is not null)").select(
        (-F.col("target") - 1).alias("request_id"), F.lit(True).alias("watched"))
    # written on the way: the shuffle files of the first lookups are gone when the others begin
    looked = _kept(books.select("request_id", "passenger_id", "flight_id", "seat_id", "staff_id", "_ord").join(
        pax, "passenger_id", "left").join(staff, "staff_id", "left").drop("staff_id").join(
            watched, "request_id", "left"), "looked-up")
    more = _kept(looked.join(fl, "flight_id", "left").join(live, "flight_id", "left").join(seat, "seat_id", "left"), "looked-up")
    j = more.join(pairs, ["flight_id", "passenger_id"], "left")
    shape_ok = F.col("passenger_id").isNotNull() & F.col("flight_id").isNotNull() & F.col("seat_id").isNotNull()
    static = F.when(~shape_ok, F.lit(R_INVALID)).when(F.col("_pax").isNull(), R_PAX_404).when(
        F.col("_fstatus").isNull(), R_FLIGHT_404).when(F.col("_fstatus").isin(*CLOSED_FLIGHT_STATUS), R_FLIGHT_CLOSED)
    no = F.lit(False)
    j = _kept(j.select(
        static.alias("_static"), "flight_id", "_ord", F.lit("book").alias("event"), "request_id", "seat_id", "passenger_id",
        "sstatus", "cap",
        F.coalesce("nlive", F.lit(0)).alias("nlive"),
        F.coalesce(F.col("_active") & (F.col("_stays") | (F.col("_ord") < F.col("_until"))), no).alias("dup"),
        F.coalesce(F.col("_sflight") == F.col("flight_id"), no).alias("seat_ok"), F.col("cap").isNotNull().alias("cap_ok"),
        (F.col("_active").isNotNull() | F.col("_staff").isNull()).alias("barred"),
        F.coalesce("watched", no).alias("watched")), "requests")
    drop_tables(looked, more)
    requests = j.where("_static is null").drop("_static")

    def events(of: DataFrame, **at: Column) -> DataFrame:
        return of.select("flight_id", F.inline(F.array(*[F.struct(o.alias("_ord"), F.lit(name).alias("event")) for name, o in at.items()])),
                         F.when(F.col("target") < 0, -F.col("target") - 1).otherwise(F.lit(-1)).alias("request_id"),
                         "seat_id", "passenger_id").where("_ord is not null")

    old, new = known.where("target >= 0"), known.where("target < 0")
    # a booking counts on its flight; its seat belongs to the seat's flight
    seated = old.drop("flight_id").join(restrict(t["seats"], old, "seat_id").select("seat_id", "flight_id"), "seat_id")
    c, boards = F.col("c"), F.when((F.col("b_first") == "Boarded") & F.col("record").isNull(), F.col("b"))
    happened = events(old, left=c).unionByName(events(seated, free=c, occupy=boards)).unionByName(
        events(new, cancel_made=c, occupy_made=boards))
    happened = _kept(restrict(happened, requests, "flight_id"), "events")
    stream = requests.unionByName(happened, allowMissingColumns=True)
    # one moment may free a seat and a place: any order of the two is the same
    stream = stream.select("flight_id", F.col("_ord.ts").alias("_ts"), F.col("_ord.id").alias("_id"), *requests.columns[2:])
    walked = fold_in_blocks(stream, "flight_id", ["_ts", "_id", "event"], _walk, _WALKED)
    fixed = j.where("_static is not null").select("request_id", F.when(
        F.col("_static").isin(R_INVALID, R_FLIGHT_CLOSED), 422).otherwise(404).alias("code"),
        F.col("_static").alias("reason"))
    return walked.unionByName(fixed)
