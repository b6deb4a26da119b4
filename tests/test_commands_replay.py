"""Command batches against a row-at-a-time Python replay on the sf0.001 fixture."""

from replay import replay_admit, replay_register

from airops.operators.commands.bookings_admit import admit_bookings
from airops.operators.commands.passengers import register_passengers


def test_admit_matches_serial_replay(tables):
    t = tables
    req = t.extra("booking_requests")
    out, _ = admit_bookings(t, req)
    got = {r.request_id: r.code for r in out.collect()}
    exp = replay_admit(
        [r[0] for r in t["passengers"].select("passenger_id").collect()],
        [(r[0], (r[1], r[2])) for r in t["flights"].select("flight_id", "status", "aircraft_id").collect()],
        [(r[0], r[1]) for r in t["aircraft"].select("aircraft_id", "seat_capacity").collect()],
        [(r[0], (r[1], r[2])) for r in t["seats"].select("seat_id", "flight_id", "status").collect()],
        [tuple(r) for r in t["bookings"].select("flight_id", "passenger_id", "status").collect()],
        [r[0] for r in t["staff"].select("staff_id").collect()],
        [tuple(r) for r in req.select("request_id", "passenger_id", "flight_id", "seat_id",
                                      "staff_id", "requested_at").collect()])
    assert got == exp
    assert 201 in got.values()


def test_register_matches_serial_replay(tables):
    import re
    from airops.operators.audits import EMAIL_PATTERN
    t = tables
    req = t.extra("passenger_requests")
    out, _ = register_passengers(t, req)
    got = {r.request_id: r.code for r in out.collect()}
    rows = req.collect()
    exp = replay_register(
        [tuple(r) for r in t["passengers"].select("passport_no", "email").collect()],
        [(r.request_id, r.requested_at, r.passport_no, r.email, r.gender,
          re.search(EMAIL_PATTERN, r.email) is not None) for r in rows])
    assert got == exp
    assert {201, 409, 422} <= set(got.values())


def test_update_passengers_matches_serial_replay(tables):
    from replay import replay_update_passengers

    from airops.operators.audits import EMAIL_PATTERN
    from airops.operators.commands.passengers import update_passengers
    req = tables.extra("passenger_update_requests")
    out, ch = update_passengers(tables, req)
    got = {r.request_id: r.code for r in out.collect()}
    exp = replay_update_passengers(
        {r.passenger_id: r.email for r in tables["passengers"].select("passenger_id", "email").collect()},
        [r.asDict() for r in req.collect()], EMAIL_PATTERN)
    assert got == exp
    assert {200, 404, 409, 422, 500} <= set(got.values())
    emails = [r.email for r in ch["passengers"].collect()]
    assert len(emails) == len(set(emails))
