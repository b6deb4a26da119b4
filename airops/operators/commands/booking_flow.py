"""Cancel, pay and board: command batches keyed by booking.

Each returns ``(outcomes, changed)`` where ``outcomes`` has request_id,
accepted, code, reason and ``changed`` maps table names to their new
snapshots. Requests on one booking interact only through the first valid
request of that booking, found with a per-booking ``min`` of the order.

The requests with what was looked up for them are written once to the scratch
folder: the first request of a booking and the outcomes are read from there. One
plan of both would do every lookup twice, all of them sorted in the same tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airops.operators.commands.common import (conform, new_ids, order_key,
                                              outcomes, restrict, upsert)
from airops.operators.commands.fold import _kept
from airops.schema import BOARDING_STATUS, PAYMENT_METHOD

# --- fixed values: outcome reasons ----------------------------------------------
R_INVALID = "invalid_request"
R_BOOKING_404 = "booking_not_found"
R_CANCELLED = "booking_cancelled"
R_ALREADY_CANCELLED = "already_cancelled"
R_PAYMENT_EXISTS = "payment_exists"
R_DB = "constraint_violation"
R_NOT_CONFIRMED = "booking_not_confirmed"
# --- end of fixed values ----------------------------------------------------------


def _bookings_state(t, requests: DataFrame) -> DataFrame:
    """Status of the bookings the batch refers to."""
    return restrict(t["bookings"], requests, "booking_id").select(
        "booking_id", F.col("status").alias("_bstatus"), F.lit(True).alias("_bfound"))


def cancel_bookings(t, requests: DataFrame):
    """Cancel bookings: seat freed, Completed payment refunded in full, ticket
    cancelled, booking Cancelled with the reason and the request time."""
    r = (requests.select("request_id", "booking_id", "cancel_reason", "requested_at")
         .withColumn("_ord", order_key())
         .join(_bookings_state(t, requests), "booking_id", "left"))
    r = _kept(r, "cancels")
    shape_ok = F.col("cancel_reason").isNotNull() & F.col("booking_id").isNotNull()
    valid = shape_ok & F.col("_bfound").isNotNull() & (F.col("_bstatus") != "Cancelled")
    first = (r.filter(valid).groupBy("booking_id").agg(F.min("_ord").alias("_acc")))
    r = r.join(first, "booking_id", "left")
    out = outcomes(r, [
        (422, R_INVALID, ~shape_ok),
        (404, R_BOOKING_404, F.col("_bfound").isNull()),
        (409, R_ALREADY_CANCELLED, (F.col("_bstatus") == "Cancelled") | (F.col("_acc") < F.col("_ord"))),
    ], 200)
    # read by each of the tables
    acc = _kept(out.filter("accepted").select("booking_id", "cancel_reason", "requested_at"), "cancelled")
    bookings = upsert(t["bookings"], acc.select(
        "booking_id", F.lit("Cancelled").alias("status"), "cancel_reason",
        F.col("requested_at").alias("cancelled_at")), "booking_id",
        ["status", "cancel_reason", "cancelled_at"])
    freed = (acc.join(restrict(t["bookings"], requests, "booking_id")
                      .select("booking_id", "seat_id"),
                      "booking_id")
             .select("seat_id").distinct().withColumn("status", F.lit("Available")))
    seats = upsert(t["seats"], freed, "seat_id", ["status"])
    refunds = acc.select("booking_id", F.col("requested_at").alias("_at"), F.lit(True).alias("_c"))
    p = t["payments"].join(refunds, "booking_id", "left")
    refund = F.col("_c").isNotNull() & (F.col("status") == "Completed")
    payments = conform(p.withColumn("refund_amount", F.when(refund, F.col("amount"))
                                    .otherwise(F.col("refund_amount")))
                       .withColumn("updated_at", F.when(refund, F.col("_at"))
                                   .otherwise(F.col("updated_at")))
                       .withColumn("status", F.when(refund, F.lit("Refunded"))
                                   .otherwise(F.col("status"))), t["payments"])
    tickets = upsert(t["tickets"], acc.select("booking_id", F.lit(True).alias("is_cancelled")),
                     "booking_id", ["is_cancelled"])
    return (out.select("request_id", "accepted", "code", "reason"),
            {"bookings": bookings, "seats": seats, "payments": payments, "tickets": tickets})


def process_payments(t, requests: DataFrame):
    """Record a Completed payment, confirm the booking and issue its ticket
    (final_fare = base_fare x class multiplier, exact, half up). The amount
    is not compared with the fare."""
    r = (requests.select("request_id", "booking_id", "method", "amount", "requested_at")
         .withColumn("_ord", order_key())
         .join(_bookings_state(t, requests), "booking_id", "left"))
    # payments and tickets of the requested bookings, found in one pass
    marks = t["payments"].select("booking_id", F.lit(True).alias("_paid"), F.lit(None).cast("boolean").alias("_ticketed")
                                 ).unionByName(t["tickets"].select(
                                     "booking_id", F.lit(None).cast("boolean").alias("_paid"), F.lit(True).alias("_ticketed")))
    marks = restrict(marks, requests, "booking_id").groupBy("booking_id").agg(
        F.max("_paid").alias("_paid"), F.max("_ticketed").alias("_ticketed"))
    # fare of the requested bookings only: seats and flights are restricted first
    b = restrict(t["bookings"], requests, "booking_id").select("booking_id", "flight_id",
                                                                      "seat_id")
    fare = (b.join(restrict(t["seats"], b, "seat_id").select("seat_id", "fare_class_id"),
                   "seat_id")
            .join(t.dim("fare_classes").select("fare_class_id", "multiplier"), "fare_class_id")
            .join(restrict(t["flights"], b, "flight_id").select("flight_id", "base_fare"),
                  "flight_id")
            .select("booking_id", "fare_class_id", "multiplier", "base_fare"))
    # fares go another way through the shuffles than the requests
    r = _kept(r.join(marks, "booking_id", "left").join(_kept(fare, "fares"), "booking_id", "left"), "payments")
    shape_ok = (F.col("method").isin(*PAYMENT_METHOD) & F.col("amount").isNotNull()
                & F.col("booking_id").isNotNull())
    # what the columns would hold: a value that does not fit them, or that is
    # not above zero after rounding, fails this request alone
    money = T.DecimalType(12, 2)
    r = (r.withColumn("_amount", F.col("amount").try_cast(money))
         .withColumn("_fare", (F.col("base_fare") * F.col("multiplier")).try_cast(money)))
    db_fail = (F.col("_amount").isNull() | (F.col("_amount") <= 0) | F.col("_ticketed").isNotNull()
               | F.col("_fare").isNull() | (F.col("_fare") <= 0))
    cand = (shape_ok & F.col("_bfound").isNotNull() & (F.col("_bstatus") != "Cancelled")
            & F.col("_paid").isNull() & ~db_fail)
    first = r.filter(cand).groupBy("booking_id").agg(F.min("_ord").alias("_acc"))
    r = r.join(first, "booking_id", "left")
    out = outcomes(r, [
        (422, R_INVALID, ~shape_ok),
        (404, R_BOOKING_404, F.col("_bfound").isNull()),
        (409, R_CANCELLED, F.col("_bstatus") == "Cancelled"),
        (409, R_PAYMENT_EXISTS, F.col("_paid").isNotNull() | (F.col("_acc") < F.col("_ord"))),
        (500, R_DB, db_fail),
    ], 201)
    acc = out.filter("accepted")
    new_pay = acc.select(
        new_ids(t["payments"], "payment_id").alias("payment_id"), "booking_id", "method",
        F.col("_amount").alias("amount"), F.lit("Completed").alias("status"),
        F.lit(0).cast("decimal(12,2)").alias("refund_amount"),
        F.col("requested_at").alias("payment_date"), F.col("requested_at").alias("updated_at"))
    new_tk = acc.select(
        new_ids(t["tickets"], "ticket_id").alias("ticket_id"), "booking_id", "fare_class_id",
        F.concat(F.lit("TKT-R"), F.col("request_id").cast("string")).alias("ticket_no"),
        "base_fare", F.col("multiplier").alias("multiplier_snapshot"),
        F.col("_fare").alias("final_fare"),
        F.col("requested_at").alias("issue_date"), F.lit(False).alias("is_cancelled"))
    payments = t["payments"].unionByName(conform(new_pay, t["payments"]))
    tickets = t["tickets"].unionByName(conform(new_tk, t["tickets"]))
    bookings = upsert(t["bookings"], acc.select("booking_id", F.lit("Confirmed").alias("status")),
                      "booking_id", ["status"])
    return (out.select("request_id", "accepted", "code", "reason"),
            {"payments": payments, "tickets": tickets, "bookings": bookings})


def record_boarding(t, events: DataFrame):
    """Boarding events (event_id, booking_id, status, event_ts), in event order.

    The first valid event of a booking without a record inserts one
    (boarded_at = event time; seat Occupied if Boarded); every later event only
    sets the status, so the final status is the last event's."""
    e = (events.select("event_id", "booking_id", "status", "event_ts")
         .withColumn("_ord", order_key("event_ts", "event_id"))
         .join(_bookings_state(t, events), "booking_id", "left"))
    has_rec = (restrict(t["boarding_records"], events, "booking_id")
               .select("booking_id", F.lit(True).alias("_rec")).distinct())
    e = _kept(e.join(has_rec, "booking_id", "left"), "boardings")
    shape_ok = F.col("status").isin(*BOARDING_STATUS) & F.col("booking_id").isNotNull()
    valid = shape_ok & F.col("_bfound").isNotNull() & (F.col("_bstatus") == "Confirmed")
    per = (e.filter(valid).groupBy("booking_id")
           .agg(F.min("_ord").alias("_first"),
                F.min_by(F.struct("status", "event_ts", "event_id"), "_ord").alias("_f"),
                F.max_by("status", "_ord").alias("_last_status")))
    e = e.join(per, "booking_id", "left")
    out = outcomes(e.withColumnRenamed("event_id", "request_id"), [
        (422, R_INVALID, ~shape_ok),
        (404, R_BOOKING_404, F.col("_bfound").isNull()),
        (422, R_NOT_CONFIRMED, F.col("_bstatus") != "Confirmed"),
        # the boarding endpoint answers 201 for an update as well; the reason tells them apart
        (201, "status_updated", F.col("_rec").isNotNull() | (F.col("_first") < F.col("_ord"))),
    ], 201, "boarding_recorded")
    br = t["boarding_records"]
    updated = upsert(br, per.select("booking_id", F.col("_last_status").alias("status")),
                     "booking_id", ["status"])
    inserts = (per.join(has_rec, "booking_id", "left_anti")
               .join(restrict(t["bookings"], events, "booking_id")
                     .select("booking_id", "passenger_id", "flight_id", "seat_id"),
                     "booking_id"))
    new_br = inserts.withColumn("_eid", F.col("_f.event_id")).select(
        new_ids(br, "boarding_id", "_eid").alias("boarding_id"),
        "booking_id", "passenger_id", "flight_id", F.col("_last_status").alias("status"),
        F.col("_f.event_ts").alias("boarded_at"))
    records = updated.unionByName(conform(new_br, br))
    occupied = (inserts.filter(F.col("_f.status") == "Boarded").select("seat_id").distinct()
                .withColumn("status", F.lit("Occupied")))
    seats = upsert(t["seats"], occupied, "seat_id", ["status"])
    return (out.select("request_id", "accepted", "code", "reason"),
            {"boarding_records": records, "seats": seats})
