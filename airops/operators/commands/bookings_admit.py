"""``admit_bookings``: new bookings under the seat, one-per-passenger and
capacity rules, with the meaning "one request at a time, in order".

The decisions are those of ``seating.py`` for a log of booking requests alone: a
fold per flight in blocks, so that neither a hot flight nor a long chain of
requests that compete for seats in turn costs a round each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airops.operators.commands.common import conform, new_ids, order_key, upsert
from airops.operators.commands.seating import decide_bookings


def pnr_for(request_id) -> F.Column:
    """Deterministic PNR of an admitted request ('R' + base-36 request id)."""
    return F.concat(F.lit("R"), F.lpad(F.upper(F.conv(request_id.cast("string"), 10, 36)), 9, "0"))


def admit_bookings(t, requests: DataFrame):
    r = requests.select("request_id", "passenger_id", "flight_id", "seat_id", "staff_id", "requested_at").withColumn(
        "_ord", order_key())
    decided = decide_bookings(t, r)
    b = t["bookings"]
    acc = r.join(decided.where("code = 201"), "request_id", "left_semi")
    new_b = acc.select(
        new_ids(b, "booking_id").alias("booking_id"), "passenger_id", "flight_id", "seat_id",
        "staff_id", pnr_for(F.col("request_id")).alias("pnr"), F.lit("Pending").alias("status"),
        F.lit(None).cast("string").alias("cancel_reason"),
        F.lit(None).cast("timestamp_ntz").alias("cancelled_at"),
        F.col("requested_at").alias("booked_at"))
    seats = upsert(t["seats"], acc.select("seat_id", F.lit("Reserved").alias("status")), "seat_id", ["status"])
    return (decided.select("request_id", (F.col("code") < 300).alias("accepted"), "code", "reason"),
            {"bookings": b.unionByName(conform(new_b, b)), "seats": seats})
