"""Row-at-a-time Python replay of command batches: a second, serial oracle.

Test-only: runs on small collected fixtures and follows the reservation
system's handlers literally, one request at a time."""

from __future__ import annotations

CLOSED = {"Departed", "Arrived", "Cancelled"}


def replay_admit(passengers, flights, aircraft, seats, bookings, staff, requests):
    """Return {request_id: code} for booking requests processed in order."""
    pax = set(passengers)
    fl = dict(flights)            # flight_id -> (status, aircraft_id)
    cap = dict(aircraft)          # aircraft_id -> capacity
    seat = dict(seats)            # seat_id -> [flight_id, status]
    seat = {k: list(v) for k, v in seat.items()}
    bk = [list(x) for x in bookings]   # (flight_id, passenger_id, status)
    st = set(staff)
    out = {}
    for rid, pid, fid, sid, staff_id, ts in sorted(requests, key=lambda r: (r[5], r[0])):
        if pid is None or fid is None or sid is None:
            out[rid] = 422; continue
        if pid not in pax:
            out[rid] = 404; continue
        if fid not in fl:
            out[rid] = 404; continue
        if fl[fid][0] in CLOSED:
            out[rid] = 422; continue
        if any(f == fid and p == pid and s != "Cancelled" for f, p, s in bk):
            out[rid] = 409; continue
        if sid not in seat or seat[sid][0] != fid:
            out[rid] = 404; continue
        if seat[sid][1] != "Available":
            out[rid] = 409; continue
        c = cap.get(fl[fid][1])
        if c is None:
            out[rid] = 500; continue
        n = sum(1 for f, p, s in bk if f == fid and s in ("Pending", "Confirmed"))
        if n >= c:
            out[rid] = 409; continue
        if any(f == fid and p == pid for f, p, s in bk) or staff_id not in st:
            out[rid] = 500; continue
        seat[sid][1] = "Reserved"
        bk.append([fid, pid, "Pending"])
        out[rid] = 201
    return out


def replay_register(existing, requests, genders=("Male", "Female", "Other")):
    """existing: [(passport, email)]; requests: [(rid, ts, passport, email, gender, shape_ok)]."""
    passports = {p for p, _ in existing}
    emails = {e for _, e in existing}
    out = {}
    for rid, ts, pp, em, g, ok in sorted(requests, key=lambda r: (r[1], r[0])):
        if not ok:
            out[rid] = 422
        elif pp in passports:
            out[rid] = 409
        elif em in emails:
            out[rid] = 409
        elif g not in genders:
            out[rid] = 422
        else:
            passports.add(pp); emails.add(em); out[rid] = 201
    return out


def replay_update_passengers(passengers, requests, email_pattern,
                             genders=("Male", "Female", "Other"),
                             fields=("full_name", "date_of_birth", "gender", "nationality", "phone",
                                     "email")):
    """passengers: {pid: email}; requests: dicts with request_id, requested_at,
    passenger_id, set_fields and the field values. Returns {request_id: code}."""
    import re
    cur = dict(passengers)
    out = {}
    for q in sorted(requests, key=lambda r: (r["requested_at"], r["request_id"])):
        sf = set(q["set_fields"] or [])
        pid, x = q["passenger_id"], q["email"]
        sets_email = "email" in sf and x is not None
        if sets_email and re.search(email_pattern, x) is None:
            out[q["request_id"]] = 422; continue
        if pid not in cur:
            out[q["request_id"]] = 404; continue
        if sets_email and x != cur[pid] and any(e == x for p, e in cur.items() if p != pid):
            out[q["request_id"]] = 409; continue
        g = q["gender"]
        if "gender" in sf and g and g not in genders:
            out[q["request_id"]] = 422; continue
        if any(f in sf and q[f] is None for f in fields) or ("gender" in sf and g == ""):
            out[q["request_id"]] = 500; continue
        if sets_email:
            cur[pid] = x
        out[q["request_id"]] = 200
    return out


def replay_log(t, log):
    """t: table name -> list of dicts (copied); log: dicts. Applies the log one
    command at a time and returns ({request_id: (code, reason)}, tables)."""
    from decimal import ROUND_HALF_UP, Decimal
    rows = {n: [dict(r) for r in v] for n, v in t.items()}
    pax = {r["passenger_id"] for r in rows["passengers"]}
    flights = {r["flight_id"]: r for r in rows["flights"]}
    cap = {r["aircraft_id"]: r["seat_capacity"] for r in rows["aircraft"]}
    seats = {r["seat_id"]: r for r in rows["seats"]}
    staff = {r["staff_id"] for r in rows["staff"]}
    classes = {r["fare_class_id"]: r["multiplier"] for r in rows["fare_classes"]}
    bookings = {r["booking_id"]: r for r in rows["bookings"]}
    payments = {r["booking_id"]: r for r in rows["payments"]}
    tickets = {r["booking_id"]: r for r in rows["tickets"]}
    records = {r["booking_id"]: r for r in rows["boarding_records"]}
    by_flight = {}
    for r in bookings.values():
        by_flight.setdefault(r["flight_id"], []).append(r)
    top = max(bookings, default=0)
    made, out = {}, {}

    def book(q):
        f, p, s = q["flight_id"], q["passenger_id"], q["seat_id"]
        if f is None or p is None or s is None:
            return 422, "invalid_request"
        if p not in pax:
            return 404, "passenger_not_found"
        if f not in flights:
            return 404, "flight_not_found"
        if flights[f]["status"] in CLOSED:
            return 422, "flight_closed"
        mine = [b for b in by_flight.get(f, []) if b["passenger_id"] == p]
        if any(b["status"] != "Cancelled" for b in mine):
            return 409, "duplicate_booking"
        if s not in seats or seats[s]["flight_id"] != f:
            return 404, "seat_not_on_flight"
        if seats[s]["status"] != "Available":
            return 409, "seat_unavailable"
        c = cap.get(flights[f]["aircraft_id"])
        if c is None:
            return 500, "constraint_violation"
        if sum(b["status"] in ("Pending", "Confirmed") for b in by_flight.get(f, [])) >= c:
            return 409, "flight_full"
        if mine or q["staff_id"] not in staff:
            return 500, "constraint_violation"
        seats[s]["status"] = "Reserved"
        b = {"booking_id": top + q["request_id"] + 1, "passenger_id": p, "flight_id": f, "seat_id": s, "status": "Pending",
             "cancel_reason": None, "cancelled_at": None}
        bookings[b["booking_id"]] = b
        by_flight.setdefault(f, []).append(b)
        made[q["request_id"]] = b
        return 201, "ok"

    def other(q):
        kind = q["command"]
        named = q["booking_id"] is not None or q["booking_request_id"] is not None
        ok = {"pay": q["method"] in ("Cash", "Card", "Bank_Transfer") and q["amount"] is not None,
              "cancel": q["cancel_reason"] is not None,
              "board": q["boarding_status"] in ("Boarded", "No_Show")}.get(kind, False)
        if not ok or not named:
            return 422, "invalid_request"
        b = bookings.get(q["booking_id"]) if q["booking_id"] is not None else made.get(q["booking_request_id"])
        if b is None:
            return 404, "booking_not_found"
        k = b["booking_id"]
        if kind == "cancel":
            if b["status"] == "Cancelled":
                return 409, "already_cancelled"
            if b["seat_id"] in seats:
                seats[b["seat_id"]]["status"] = "Available"
            if k in payments and payments[k]["status"] == "Completed":
                payments[k].update(status="Refunded", refund_amount=payments[k]["amount"])
            if k in tickets:
                tickets[k]["is_cancelled"] = True
            b.update(status="Cancelled", cancel_reason=q["cancel_reason"], cancelled_at=q["requested_at"])
            return 200, "ok"
        if kind == "pay":
            if b["status"] == "Cancelled":
                return 409, "booking_cancelled"
            if k in payments:
                return 409, "payment_exists"
            fare = None
            if b["seat_id"] in seats and b["flight_id"] in flights:
                fare = (flights[b["flight_id"]]["base_fare"] * classes[seats[b["seat_id"]]["fare_class_id"]]).quantize(
                    Decimal("0.01"), ROUND_HALF_UP)
            if q["amount"] <= 0 or k in tickets or fare is None or fare <= 0:
                return 500, "constraint_violation"
            payments[k] = {"booking_id": k, "amount": q["amount"], "status": "Completed", "refund_amount": Decimal("0.00")}
            tickets[k] = {"booking_id": k, "final_fare": fare, "is_cancelled": False}
            b["status"] = "Confirmed"
            return 201, "ok"
        if b["status"] != "Confirmed":
            return 422, "booking_not_confirmed"
        if k in records:
            records[k]["status"] = q["boarding_status"]
            return 201, "status_updated"
        records[k] = {"booking_id": k, "status": q["boarding_status"], "boarded_at": q["requested_at"]}
        if q["boarding_status"] == "Boarded" and b["seat_id"] in seats:
            seats[b["seat_id"]]["status"] = "Occupied"
        return 201, "boarding_recorded"

    for q in sorted(log, key=lambda q: (q["requested_at"], q["request_id"])):
        out[q["request_id"]] = book(q) if q["command"] == "book" else other(q)
    return out, {"bookings": bookings, "seats": seats, "payments": payments, "tickets": tickets, "boarding_records": records}
