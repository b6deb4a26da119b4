
import datetime as dt

from pyspark.sql import functions as F

from helpers import (T0, aircraft, airport, booking, fare_class, flight, make_tables, passenger,
                     payment, seat, staff)

from airops.operators import listings as L
from airops.operators import reports as R
from airops.operators import views as V
from airops.operators.commands import booking_flow as BF
from airops.operators.commands import bookings_admit as BA
from airops.operators.commands import passengers as PC


def test_empty_payments_summary(spark):
    t = make_tables(spark)
    row = R.revenue_summary(t).collect()[0]
    assert row.total_transactions == 0
    assert row.total_revenue is None and row.average_fare is None and row.net_revenue is None


def test_date_to_excludes_after_midnight(spark):
    day = dt.datetime(2024, 3, 5)
    t = make_tables(spark, payments=[payment(1, "10.00", at=day),
                                     payment(2, "20.00", at=day + dt.timedelta(minutes=1))])
    row = R.revenue_summary(t, None, dt.date(2024, 3, 5)).collect()[0]
    assert row.total_transactions == 1 and row.total_revenue == 10.0


def test_average_is_exact_half_up(spark):
    t = make_tables(spark, payments=[payment(1, "0.01"), payment(2, "0.02")])
    assert R.revenue_summary(t).collect()[0].average_fare == 0.02  # 0.015 -> 0.02


def test_occupancy_tie_rounds_half_up(spark):
    # 23 of 80 seats = 28.75 % -> 28.8 (PostgreSQL numeric), not 28.7 (double)
    bk = [booking(i, i, 1, i) for i in range(1, 24)]
    t = make_tables(spark, flights=[flight(1)], aircraft=[aircraft(1, 80)],
                    airports=[airport(1, "AAA"), airport(2, "BBB")], bookings=bk)
    row = R.seat_occupancy(t).collect()[0]
    assert (row.confirmed_bookings, row.occupancy_percent, row.route) == (23, 28.8, "AAA → BBB")


def test_flight_without_bookings_occupancy_zero(spark):
    t = make_tables(spark, flights=[flight(1)], aircraft=[aircraft(1, 0)],
                    airports=[airport(1, "AAA"), airport(2, "BBB")])
    row = R.seat_occupancy(t).collect()[0]
    assert row.confirmed_bookings == 0 and row.occupancy_percent is None


def test_boarding_percent_half_even(spark):
    # 1 boarded of 16 confirmed = 6.25 % -> 6.2 (ties to even)
    bk = [booking(i, i, 1, i) for i in range(1, 17)]
    br = [(1, 1, 1, 1, "Boarded", T0)]
    t = make_tables(spark, flights=[flight(1)], bookings=bk, boarding_records=br)
    row = V.boarding_summary(t).collect()[0]
    assert (row.total_confirmed, row.total_boarded, row.boarding_percent) == (16, 1, 6.2)


def test_boarding_summary_zero_row(spark):
    t = make_tables(spark, flights=[flight(1)])
    row = V.boarding_summary(t).collect()[0]
    assert (row.total_confirmed, row.total_boarded, row.boarding_percent) == (0, 0, 0.0)


def test_seat_availability_flight_without_seats(spark):
    t = make_tables(spark, flights=[flight(1), flight(2)], seats=[seat(1, 1, "Reserved")])
    rows = {r.flight_id: r for r in V.seat_availability(t).collect()}
    assert rows[2].total_seats == 0 and rows[1].reserved_seats == 1


def test_history_without_ticket_payment_schedule(spark):
    t = make_tables(spark, passengers=[passenger(1)], flights=[flight(1)],
                    airports=[airport(1, "AAA"), airport(2, "BBB")], seats=[seat(1, 1)],
                    fare_classes=[fare_class(1)], bookings=[booking(1, 1, 1, 1, "Pending")])
    row = V.travel_history(t).collect()[0]
    assert row.ticket_no is None and row.payment_status is None and row.scheduled_departure is None
    assert row.origin == "AAA" and row.travel_class == "Economy"


def test_unknown_iata_drops_filter(spark):
    t = make_tables(spark, flights=[flight(1, 1, 2), flight(2, 2, 1)],
                    airports=[airport(1, "AAA"), airport(2, "BBB")], aircraft=[aircraft(1, 10)])
    assert L.list_flights_total(t, origin="zzz").collect()[0].total == 2
    assert L.list_flights_total(t, origin="aaa").collect()[0].total == 1


def test_search_term_percent_is_wildcard(spark):
    t = make_tables(spark, passengers=[passenger(1, email="ab@x.org"), passenger(2, email="a@x.org")])
    assert L.list_passengers_total(t, "a%b").collect()[0].total == 1


def _admit(spark, t, reqs):
    df = spark.createDataFrame(reqs, "request_id long, passenger_id long, flight_id long, "
                               "seat_id long, staff_id long, requested_at timestamp_ntz")
    out, ch = BA.admit_bookings(t, df)
    return {r.request_id: r.code for r in out.collect()}, ch


def _base(spark, **extra):
    rows = dict(passengers=[passenger(i) for i in (1, 2, 3)], flights=[flight(1)],
                aircraft=[aircraft(1, 2)], seats=[seat(s, 1) for s in (1, 2, 3)],
                staff=[staff(1)], airports=[airport(1, "AAA"), airport(2, "BBB")])
    rows.update(extra)
    return make_tables(spark, **rows)


def test_rebook_after_cancel_is_500(spark):
    t = _base(spark, bookings=[booking(9, 1, 1, 3, "Cancelled")])
    codes, _ = _admit(spark, t, [(1, 1, 1, 1, 1, T0)])
    assert codes == {1: 500}


def test_rejected_request_does_not_hold_seat(spark):
    # r1: unknown passenger wants seat 1 (404); r2 for seat 1 is admitted;
    # r3 same passenger again 409; r4 seat 1 taken 409; capacity 2 -> r5 admitted, r6 full
    t = _base(spark)
    at = [T0 + dt.timedelta(minutes=i) for i in range(6)]
    codes, ch = _admit(spark, t, [(1, 99, 1, 1, 1, at[0]), (2, 1, 1, 1, 1, at[1]),
                                  (3, 1, 1, 2, 1, at[2]), (4, 2, 1, 1, 1, at[3]),
                                  (5, 2, 1, 2, 1, at[4]), (6, 3, 1, 3, 1, at[5])])
    assert codes == {1: 404, 2: 201, 3: 409, 4: 409, 5: 201, 6: 409}
    seats = {r.seat_id: r.status for r in ch["seats"].collect()}
    assert seats == {1: "Reserved", 2: "Reserved", 3: "Available"}


def test_register_two_unique_keys(spark):
    # A(p1, e1), B(p1, e2), C(p2, e2): A and C admitted, B rejected on passport
    t = make_tables(spark)
    df = spark.createDataFrame(
        [(1, T0, "A", dt.date(1990, 1, 1), "Male", "X", "p1", "1", "e1@x.org"),
         (2, T0 + dt.timedelta(seconds=1), "B", dt.date(1990, 1, 1), "Male", "X", "p1", "1", "e2@x.org"),
         (3, T0 + dt.timedelta(seconds=2), "C", dt.date(1990, 1, 1), "Male", "X", "p2", "1", "e2@x.org")],
        "request_id long, requested_at timestamp_ntz, full_name string, date_of_birth date, "
        "gender string, nationality string, passport_no string, phone string, email string")
    out, ch = PC.register_passengers(t, df)
    assert {r.request_id: r.code for r in out.collect()} == {1: 201, 2: 409, 3: 201}
    assert ch["passengers"].count() == 2


def test_boarding_noshow_then_boarded(spark):
    t = _base(spark, bookings=[booking(1, 1, 1, 1, "Confirmed")])
    ev = spark.createDataFrame([(10, 1, "No_Show", T0), (11, 1, "Boarded", T0 + dt.timedelta(hours=1))],
                               "event_id long, booking_id long, status string, event_ts timestamp_ntz")
    out, ch = BF.record_boarding(t, ev)
    assert {r.request_id: (r.code, r.reason) for r in out.collect()} == {
        10: (201, "boarding_recorded"), 11: (201, "status_updated")}
    rec = ch["boarding_records"].collect()
    assert len(rec) == 1 and rec[0].status == "Boarded" and rec[0].boarded_at == T0
    # the seat stays as it was: the record was created by a No_Show
    assert {r.seat_id: r.status for r in ch["seats"].collect()}[1] == "Available"


def test_cancel_boarded_passenger_refunds(spark):
    t = _base(spark, bookings=[booking(1, 1, 1, 1, "Confirmed")], payments=[payment(1, "50.00")],
              boarding_records=[(1, 1, 1, 1, "Boarded", T0)])
    req = spark.createDataFrame([(1, 1, "why", T0), (2, 1, "again", T0 + dt.timedelta(hours=1)),
                                 (3, 1, None, T0)],
                                "request_id long, booking_id long, cancel_reason string, "
                                "requested_at timestamp_ntz")
    out, ch = BF.cancel_bookings(t, req)
    assert {r.request_id: r.code for r in out.collect()} == {1: 200, 2: 409, 3: 422}
    p = ch["payments"].collect()[0]
    assert p.status == "Refunded" and str(p.refund_amount) == "50.00"


def test_payment_issues_ticket_with_exact_fare(spark):
    t = _base(spark, bookings=[booking(1, 1, 1, 1, "Pending")], fare_classes=[fare_class(1, "Economy", "1.50")])
    req = spark.createDataFrame([(1, 1, "Card", 0, T0), (2, 1, "Card", 5, T0 + dt.timedelta(hours=1)),
                                 (3, 1, "Card", 7, T0 + dt.timedelta(hours=2))],
                                "request_id long, booking_id long, method string, amount int, "
                                "requested_at timestamp_ntz")
    req = req.withColumn("amount", req.amount.cast("decimal(12,2)"))
    out, ch = BF.process_payments(t, req)
    assert {r.request_id: r.code for r in out.collect()} == {1: 500, 2: 201, 3: 409}
    tk = ch["tickets"].collect()[0]
    assert str(tk.final_fare) == "150.00"
    assert {r.booking_id: r.status for r in ch["bookings"].collect()} == {1: "Confirmed"}


def test_delete_passengers(spark):
    t = _base(spark, bookings=[booking(1, 1, 1, 1, "Cancelled")])
    req = spark.createDataFrame([(1, T0, 2), (2, T0 + dt.timedelta(seconds=1), 2), (3, T0, 1), (4, T0, 99)],
                                "request_id long, requested_at timestamp_ntz, passenger_id long")
    out, ch = PC.delete_passengers(t, req)
    assert {r.request_id: r.code for r in out.collect()} == {1: 200, 2: 404, 3: 409, 4: 404}
    assert sorted(r.passenger_id for r in ch["passengers"].collect()) == [1, 3]


def test_update_schedules_checks_merged_row(spark):
    from airops.operators.commands import reference_data as RD
    sch = [(1, 1, T0, T0 + dt.timedelta(hours=2), None, None, None, None, T0)]
    t = _base(spark, flight_schedules=sch)
    h = lambda n: T0 + dt.timedelta(hours=n)
    req = spark.createDataFrame([
        (1, h(0), 1, ["dep_datetime"], h(3), None),     # dep after arr -> 422, nothing saved
        (2, h(1), 1, ["arr_datetime"], None, h(5)),     # arr 5 > dep 0 -> ok
        (3, h(2), 1, ["dep_datetime"], h(3), None),     # now dep 3 < arr 5 -> ok
        (4, h(3), 1, ["arr_datetime"], None, None),     # explicit NULL arrival -> 500
        (5, h(4), 2, ["gate"], None, None),             # no schedule -> 404
    ], "request_id long, requested_at timestamp_ntz, flight_id long, set_fields array<string>, "
       "dep_datetime timestamp_ntz, arr_datetime timestamp_ntz")
    for c in ("actual_dep", "actual_arr"):
        req = req.withColumn(c, F.lit(None).cast("timestamp_ntz"))
    req = req.withColumn("terminal", F.lit(None).cast("string")).withColumn("gate", F.lit("G1"))
    out, ch = RD.update_schedules(t, req)
    assert {r.request_id: r.code for r in out.collect()} == {1: 422, 2: 200, 3: 200, 4: 500, 5: 404}
    row = ch["flight_schedules"].collect()[0]
    assert (row.dep_datetime, row.arr_datetime) == (h(3), h(5))


def test_update_last_writer_wins(spark):
    from airops.operators.commands import reference_data as RD
    t = _base(spark, staff=[staff(1)])
    req = spark.createDataFrame([
        (1, T0, 1, ["full_name"], "A", "Ground_Staff", True),
        (2, T0 + dt.timedelta(seconds=2), 1, ["full_name", "role"], "B", "Pilot", True),  # bad role 422
        (3, T0 + dt.timedelta(seconds=1), 1, ["role"], "C", "Finance_Officer", True),
        (4, T0, 7, ["full_name"], "D", "Ground_Staff", True),
    ], "request_id long, requested_at timestamp_ntz, staff_id long, set_fields array<string>, "
       "full_name string, role string, is_active boolean")
    out, ch = RD.update_staff(t, req)
    assert {r.request_id: r.code for r in out.collect()} == {1: 200, 2: 422, 3: 200, 4: 404}
    row = ch["staff"].collect()[0]
    assert (row.full_name, row.role, row.is_active) == ("A", "Finance_Officer", True)


def test_update_passengers_email_moves(spark):
    # A leaves e1 at t1, B takes e1 at t2 -> ok; C takes e2 at t0 before D leaves it -> 409;
    # E re-sets its own e-mail -> ok; F unknown -> 404; G bad gender -> 422 after the e-mail check
    t = make_tables(spark, passengers=[passenger(1, email="e1@x.org"), passenger(2, email="b@x.org"),
                                       passenger(3, email="c@x.org"), passenger(4, email="e2@x.org"),
                                       passenger(5, email="e5@x.org"), passenger(7, email="g@x.org")])
    s = lambda n: T0 + dt.timedelta(seconds=n)
    rows = [(1, s(1), 1, ["email"], "a2@x.org", None), (2, s(2), 2, ["email"], "e1@x.org", None),
            (3, s(0), 3, ["email"], "e2@x.org", None), (4, s(3), 4, ["email"], "d2@x.org", None),
            (5, s(4), 5, ["email"], "e5@x.org", None), (6, s(5), 99, ["phone"], None, None),
            (7, s(6), 7, ["email", "gender"], "e1@x.org", "Robot"),
            (8, s(7), 7, ["gender"], None, "Robot")]
    req = spark.createDataFrame(rows, "request_id long, requested_at timestamp_ntz, passenger_id long, "
                                "set_fields array<string>, email string, gender string")
    for c, typ in (("full_name", "string"), ("date_of_birth", "date"), ("nationality", "string"),
                   ("phone", "string")):
        req = req.withColumn(c, F.lit(None).cast(typ))
    out, ch = PC.update_passengers(t, req)
    assert {r.request_id: r.code for r in out.collect()} == {
        1: 200, 2: 200, 3: 409, 4: 200, 5: 200, 6: 404, 7: 409, 8: 422}
    emails = {r.passenger_id: r.email for r in ch["passengers"].collect()}
    assert emails[1] == "a2@x.org" and emails[2] == "e1@x.org" and emails[3] == "c@x.org"


def test_revenue_report_document_matches_sections(tables):
    from airops import plans
    doc = R.revenue_report(tables).collect()
    assert len(doc) == 1
    d = doc[0]
    assert (d.report_type, d.date_from, d.date_to) == ("Revenue Report", "All time", "All time")
    assert d.summary.asDict() == R.revenue_summary(tables).collect()[0].asDict()
    assert [r.asDict() for r in d.by_class] == [r.asDict() for r in R.revenue_by_class(tables).collect()]
    assert [r.asDict() for r in d.top_flights] == [r.asDict() for r in R.top_flights(tables).collect()]
    assert [r.payment_method for r in d.by_method] == [
        r.payment_method for r in R.revenue_by_method(tables).collect()]
    assert "NestedLoopJoin" not in plans.formatted(R.revenue_report(tables), "simple")
    op = R.operational_report(tables)["summary"].collect()[0]
    assert op.overall_stats.asDict() == R.overall_stats(tables).collect()[0].asDict()
