
from pyspark.sql import functions as F

from airops.operators import audits, reports
from airops.operators.commands import booking_flow as BF
from airops.operators.commands import bookings_admit as BA


def _audit(df):
    return {r.constraint_name: r.violations for r in df.collect()}


def test_admitted_bookings_respect_capacity_and_seats(tables):
    t = tables
    out, ch = BA.admit_bookings(t, t.extra("booking_requests"))
    t2 = t.replace(**ch)
    new = t2["bookings"].filter(F.col("pnr").startswith("R"))
    assert new.count() == out.filter("accepted").count() > 0
    # never above capacity on a flight that received bookings
    live = (t2["bookings"].filter(F.col("status").isin("Pending", "Confirmed"))
            .groupBy("flight_id").agg(F.count(F.lit(1)).alias("n")))
    cap = t["flights"].join(t["aircraft"], "aircraft_id").select("flight_id", "seat_capacity")
    touched = new.select("flight_id").distinct()
    over = live.join(touched, "flight_id", "left_semi").join(cap, "flight_id") \
        .filter(F.col("n") > F.col("seat_capacity"))
    assert over.count() == 0
    # one live booking per seat among the batch's bookings and the snapshot's
    per_seat = (t2["bookings"].filter(F.col("status") != "Cancelled").groupBy("seat_id")
                .count().filter("count > 1").join(new.select("seat_id"), "seat_id", "left_semi"))
    assert per_seat.count() == 0
    # the batch adds no unique or foreign-key violation
    before_u, after_u = _audit(audits.audit_unique(t)), _audit(audits.audit_unique(t2))
    assert after_u == before_u
    before_f, after_f = _audit(audits.audit_foreign_keys(t)), _audit(audits.audit_foreign_keys(t2))
    assert after_f == before_f


def test_cancel_and_pay_keep_checks_clean(tables):
    t = tables
    base = _audit(audits.audit_checks(t))
    _, ch = BF.cancel_bookings(t, t.extra("cancel_requests"))
    t2 = t.replace(**ch)
    assert _audit(audits.audit_checks(t2)) == base
    _, ch = BF.process_payments(t, t.extra("payment_requests"))
    t3 = t.replace(**ch)
    after = _audit(audits.audit_checks(t3))
    assert after == base
    assert _audit(audits.audit_unique(t3))["uq_ticket_no"] == 0


def test_method_revenue_sums_to_completed_total(tables):
    by_method = reports.revenue_by_method(tables).agg(F.sum("method_revenue")).first()[0]
    total = (tables["payments"].filter(F.col("status") == "Completed")
             .agg(F.sum("amount").cast("double")).first()[0])
    assert abs(by_method - total) < 1e-6


def test_route_bookings_sum_to_completed_bookings(tables):
    n = reports.revenue_by_route(tables).agg(F.sum("bookings")).first()[0]
    m = (tables["payments"].filter(F.col("status") == "Completed")
         .join(tables["bookings"], "booking_id")
         .join(tables["flights"], "flight_id").count())
    assert n == m
