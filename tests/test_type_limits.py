"""Values that a column's declared type cannot hold: that request is a 500, holds no
key, and the rest of its batch goes on; e-mail domains are stored in lower case."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from helpers import T0, aircraft, airport, flight, make_tables, passenger, staff

from airops.operators.commands import passengers as PC
from airops.operators.commands import reference_data as RD


def _at(k):
    return T0 + dt.timedelta(minutes=k)


def _codes(out):
    return {r.request_id: r.code for r in out.collect()}


def _requests(spark, schema, rows):
    return spark.createDataFrame([(k + 1, _at(k), *row) for k, row in enumerate(rows)],
                                 "request_id long, requested_at timestamp_ntz, " + schema)


PASSENGER = ("full_name string, date_of_birth date, gender string, nationality string, "
             "passport_no string, phone string, email string")


def _person(name="N", passport="P1", phone="1", email="a@b.org"):
    return (name, dt.date(1990, 1, 1), "Male", "X", passport, phone, email)


def test_register_passengers_widths_and_domains(spark):
    t = make_tables(spark, passengers=[passenger(1, "PP1", "kept@x.org")])
    r = _requests(spark, PASSENGER, [
        _person("n" * 151, "P1", email="a@b.org"),           # 500, holds neither key
        _person("n" * 150, "P1", email="Ann@B.org"),         # takes both
        _person("N", "P2", email="Ann@b.ORG"),               # the same address
        _person("N", "P3", email="ann@b.org"),               # another local part
        _person("N", "P4", phone="1" * 21, email="c@b.org"),
        _person("N", "P5", email="kept@X.ORG"),              # taken in the snapshot
        _person("é" * 150, "P6", email="d@b.org")])          # characters, not bytes
    out, changed = PC.register_passengers(t, r)
    assert _codes(out) == {1: 500, 2: 201, 3: 409, 4: 201, 5: 500, 6: 409, 7: 201}
    assert {p.email for p in changed["passengers"].collect()} == {"kept@x.org", "Ann@b.org", "ann@b.org", "d@b.org"}


def test_update_passengers_widths(spark):
    t = make_tables(spark, passengers=[passenger(1, email="one@x.org"), passenger(2, email="two@x.org")])
    schema = "passenger_id long, set_fields array<string>, " + PASSENGER.replace(", passport_no string", "")

    def row(pid, fields, **v):
        return (pid, fields, v.get("name"), None, None, v.get("nation"), v.get("phone"), v.get("email"))

    r = _requests(spark, schema, [
        row(1, ["full_name"], name="n" * 151),
        row(1, ["phone"], name="n" * 151, phone="2"),        # the long name is not set
        row(1, ["email", "nationality"], email="new@x.org", nation="n" * 101),  # moves no address
        row(2, ["email"], email="one@X.org"),                # so this one is still taken
        row(2, ["email"], email="Two@X.ORG")])
    out, changed = PC.update_passengers(t, r)
    assert _codes(out) == {1: 500, 2: 200, 3: 500, 4: 409, 5: 200}
    got = {p.passenger_id: (p.full_name, p.phone, p.email) for p in changed["passengers"].collect()}
    assert got == {1: ("P 1", "2", "one@x.org"), 2: ("P 2", "1", "Two@x.org")}


def test_create_flights_range_does_not_abort_the_batch(spark):
    t = make_tables(spark, airports=[airport(1, "AAA"), airport(2, "BBB")], aircraft=[aircraft(1, 10)])
    r = _requests(spark, "flight_no string, origin_airport_id long, dest_airport_id long, aircraft_id long, "
                  "base_fare decimal(20,4)", [
                      ("F1", 1, 2, 1, Decimal("99999999999.99")),  # 500, the number stays free
                      ("F1", 1, 2, 1, Decimal("9999999999.99")),
                      ("F" * 21, 1, 2, 1, Decimal("1")),
                      ("F2", 1, 2, 1, Decimal("0.0049")),          # stored as 0.00: the CHECK
                      ("F3", 1, 2, 1, Decimal("0.0050")),
                      ("F4", 1, 2, 1, Decimal("9999999999.9950")),  # rounds beyond the range
                      ("F" * 21, 9, 2, 1, Decimal("1"))])          # earlier checks first
    out, changed = RD.create_flights(t, r)
    assert _codes(out) == {1: 500, 2: 201, 3: 500, 4: 500, 5: 201, 6: 500, 7: 404}
    assert {f.flight_no: f.base_fare for f in changed["flights"].collect()} == {
        "F1": Decimal("9999999999.99"), "F3": Decimal("0.01")}


def test_update_flights_range(spark):
    t = make_tables(spark, flights=[flight(1)], aircraft=[aircraft(1, 10)])
    schema = "flight_id long, set_fields array<string>, aircraft_id long, base_fare decimal(20,4), status string"
    r = _requests(spark, schema, [
        (1, ["base_fare"], None, Decimal("10000000000"), None),
        (1, ["status"], None, Decimal("10000000000"), "Boarding"),
        (1, ["base_fare"], None, Decimal("7.126"), None)])
    out, changed = RD.update_flights(t, r)
    assert _codes(out) == {1: 500, 2: 200, 3: 200}
    row = changed["flights"].collect()[0]
    assert (row.base_fare, row.status) == (Decimal("7.13"), "Boarding")


def test_reference_data_integers_and_widths(spark):
    t = make_tables(spark, airports=[airport(1, "AAA")], aircraft=[aircraft(1, 10)], staff=[staff(1)])
    out, changed = RD.create_airports(t, _requests(
        spark, "airport_name string, iata_code string, city string, country string, terminals long", [
            ("n" * 201, "BBB", "c", "k", 1), ("n" * 200, "bbb", "c", "k", 1), ("n", "CCC", "c", "k", 1 << 31),
            ("n", "DDD", "c" * 101, "k", 1), ("n", "aaa", "c" * 101, "k", 1)]))
    assert _codes(out) == {1: 500, 2: 201, 3: 500, 4: 500, 5: 409}
    assert changed["airports"].count() == 2
    out, _ = RD.update_airports(t, _requests(
        spark, "airport_id long, set_fields array<string>, airport_name string, city string, country string, "
        "terminals long, is_active boolean", [
            (1, ["terminals"], None, None, None, 1 << 31, None), (1, ["city"], None, "c" * 101, None, 1 << 31, None),
            (1, ["city"], "n" * 300, "c" * 100, None, 1 << 31, None)]))
    assert _codes(out) == {1: 500, 2: 500, 3: 200}
    out, _ = RD.register_aircraft(t, _requests(
        spark, "registration_no string, model string, seat_capacity long, status string", [
            ("R" * 21, "M", 1, None), ("R", "M" * 101, 1, None), ("R", "M", 1 << 40, None), ("R", "M", 5, None)]))
    assert _codes(out) == {1: 500, 2: 500, 3: 500, 4: 201}
    out, changed = RD.create_staff(t, _requests(spark, "full_name string, email string, role string", [
        ("n" * 151, "n@X.org", "Ground_Staff"), ("n", "s1@X.ORG", "Ground_Staff"), ("n", "n@X.org", "Ground_Staff"),
        ("n", "a" * 145 + "@x.org", "Ground_Staff")]))
    assert _codes(out) == {1: 500, 2: 409, 3: 201, 4: 500}
    assert {s.email for s in changed["staff"].collect()} == {"s1@x.org", "n@x.org"}


def test_schedule_gates(spark):
    h = dt.timedelta(hours=1)
    t = make_tables(spark, flights=[flight(1), flight(2)],
                    flight_schedules=[(1, 1, T0, T0 + h, None, None, None, None, T0)])
    out, changed = RD.create_schedules(t, _requests(
        spark, "flight_id long, dep_datetime timestamp_ntz, arr_datetime timestamp_ntz, terminal string, gate string", [
            (2, T0, T0 + h, "T", "g" * 21), (2, T0, T0 + h, "T" * 20, "g")]))
    assert _codes(out) == {1: 500, 2: 201}
    schema = ("flight_id long, set_fields array<string>, dep_datetime timestamp_ntz, arr_datetime timestamp_ntz, "
              "actual_dep timestamp_ntz, actual_arr timestamp_ntz, terminal string, gate string")
    both = ["dep_datetime", "arr_datetime", "gate"]
    out, changed = RD.update_schedules(t, _requests(spark, schema, [
        (1, both, T0 + 5 * h, T0 + 6 * h, None, None, None, "g" * 21),   # 500: the times don't move
        (1, ["dep_datetime"], T0 + h / 2, None, None, None, None, "g" * 21),
        (1, both, T0 + 6 * h, T0 + 5 * h, None, None, None, "g" * 21),   # 422 comes first
        (1, ["arr_datetime"], None, T0 + 2 * h, None, None, None, None)]))
    assert _codes(out) == {1: 500, 2: 200, 3: 422, 4: 200}
    row = changed["flight_schedules"].filter(F.col("flight_id") == 1).collect()[0]
    assert (row.dep_datetime, row.arr_datetime, row.gate) == (T0 + h / 2, T0 + 2 * h, None)
