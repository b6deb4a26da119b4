"""DuckDB oracles for the command batches whose Spark plans are iterative
(admission fixpoints): recursive CTEs that step through the requests one at a
time, carrying the state (taken seats, passengers, e-mails) as lists -- the
serial meaning, literally, in an independent engine.
"""

from __future__ import annotations

from airops.operators.audits import EMAIL_PATTERN
from oracles.reference import applied

CLOSED = "('Departed', 'Arrived', 'Cancelled')"
B36 = "'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'"


def _case(rules: list[tuple[str, int, str]], ok: tuple[int, str]) -> tuple[str, str]:
    code = "case " + " ".join(f"when {c} then {k}" for c, k, _ in rules) + f" else {ok[0]} end"
    reason = "case " + " ".join(f"when {c} then '{r}'" for c, _, r in rules) + f" else '{ok[1]}' end"
    return code, reason


def _pnr(col: str) -> str:
    """'R' + request id in base 36, 9 digits (ids below 36^9)."""
    digits = " || ".join(f"substr({B36}, cast(({col} // {36 ** k}) % 36 as integer) + 1, 1)"
                         for k in range(8, -1, -1))
    return f"'R' || {digits}"


def _admit() -> dict[str, str]:
    rules = [
        ("q.passenger_id is null or q.flight_id is null or q.seat_id is null", 422, "invalid_request"),
        ("not q.pfound", 404, "passenger_not_found"),
        ("q.fstatus is null", 404, "flight_not_found"),
        (f"q.fstatus in {CLOSED}", 422, "flight_closed"),
        ("q.active0 or list_contains(w.pax, q.passenger_id)", 409, "duplicate_booking"),
        ("q.sflight is null or q.sflight <> q.flight_id", 404, "seat_not_on_flight"),
        ("q.sstatus <> 'Available' or list_contains(w.taken, q.seat_id)", 409, "seat_unavailable"),
        ("q.cap is null", 500, "constraint_violation"),
        ("q.nlive + w.n >= q.cap", 409, "flight_full"),
        ("q.any0 or not q.stfound", 500, "constraint_violation"),
    ]
    code, reason = _case(rules, (201, "ok"))
    walk = f"""
with recursive pre as (
  select r.*, p.passenger_id is not null pfound, f.status fstatus, a.seat_capacity cap,
   s.flight_id sflight, s.status sstatus, st.staff_id is not null stfound,
   exists (select 1 from bookings b where b.flight_id = r.flight_id and b.passenger_id = r.passenger_id
           and b.status <> 'Cancelled') active0,
   exists (select 1 from bookings b where b.flight_id = r.flight_id and b.passenger_id = r.passenger_id) any0,
   (select count(*) from bookings b where b.flight_id = r.flight_id
      and b.status in ('Pending', 'Confirmed')) nlive,
   row_number() over (partition by r.flight_id order by r.requested_at, r.request_id) rn
  from booking_requests r left join passengers p on p.passenger_id = r.passenger_id
   left join flights f on f.flight_id = r.flight_id left join aircraft a on a.aircraft_id = f.aircraft_id
   left join seats s on s.seat_id = r.seat_id left join staff st on st.staff_id = r.staff_id),
 w(flight_id, rn, taken, pax, n, request_id, code, reason) as (
  select distinct flight_id, cast(0 as bigint), cast([] as bigint[]), cast([] as bigint[]), cast(0 as bigint),
   cast(null as bigint), cast(null as integer), cast(null as varchar) from pre
  union all
  select w.flight_id, q.rn,
   case when ({code}) = 201 then list_append(w.taken, q.seat_id) else w.taken end,
   case when ({code}) = 201 then list_append(w.pax, q.passenger_id) else w.pax end,
   w.n + case when ({code}) = 201 then 1 else 0 end, q.request_id, {code}, {reason}
  from w join pre q on q.flight_id = w.flight_id and q.rn = w.rn + 1)"""
    outcomes = walk + """
select request_id, code < 300 accepted, cast(code as integer) code, reason from w where rn > 0"""
    new = walk + f"""
select r.passenger_id, r.flight_id, r.seat_id, r.staff_id, {_pnr('r.request_id')} pnr, 'Pending' status,
 r.requested_at booked_at
from w join booking_requests r on r.request_id = w.request_id where w.rn > 0 and w.code = 201"""
    seats = walk + """
select s.seat_id, case when exists (select 1 from w join booking_requests r on r.request_id = w.request_id
   where w.rn > 0 and w.code = 201 and r.seat_id = s.seat_id) then 'Reserved' else s.status end status
from seats s"""
    return {"admit_bookings": outcomes, "admit_bookings_new": new, "admit_bookings_seats": seats}


PASSENGER_REQUESTS = """
select c_custkey + 3000000 request_id,
 timestamp '2024-02-01 00:00:00' + interval '1' minute * cast(c_custkey % 100000 as integer) requested_at,
 'New ' || c_name full_name, date_add(date '1960-01-01', cast(c_custkey % 9000 as integer)) date_of_birth,
 case when c_custkey % 17 = 0 then 'Unknown' when c_custkey % 3 = 0 then 'Male'
      when c_custkey % 3 = 1 then 'Female' else 'Other' end gender,
 n_name nationality,
 case when c_custkey % 13 = 0 then 'P' || lpad(cast(c_custkey as varchar), 8, '0')
      when c_custkey % 11 = 0 then 'N' || lpad(cast(c_custkey - 1 as varchar), 8, '0')
      else 'N' || lpad(cast(c_custkey as varchar), 8, '0') end passport_no,
 '+2' || lpad(cast(c_custkey as varchar), 9, '0') phone,
 case when c_custkey % 19 = 0 then 'bad-email'
      when c_custkey % 7 = 0 then 'new.' || cast(c_custkey - 2 as varchar) || '@example.com'
      else 'new.' || cast(c_custkey as varchar) || '@example.com' end email
from customer join nation on c_nationkey = n_nationkey"""

PASSENGER_UPDATE_REQUESTS = """
select c_custkey + 7000000 request_id,
 timestamp '2024-04-01 00:00:00' + interval '1' minute * cast((c_custkey * 37) % 1000 as integer) requested_at,
 cast(case when c_custkey % 7 = 0 then c_custkey + 1000000 else c_custkey end as bigint) passenger_id,
 case when c_custkey % 19 = 0 then ['full_name'] when c_custkey % 5 = 0 then ['email', 'phone']
      when c_custkey % 5 = 1 then ['email'] when c_custkey % 17 = 0 then ['gender']
      else ['nationality', 'gender'] end set_fields,
 case when c_custkey % 19 = 0 then null else 'Upd ' || c_name end full_name,
 cast(null as date) date_of_birth,
 case when c_custkey % 17 = 0 then 'Robot' else 'Other' end gender,
 'Atlantis' nationality, '+3000' phone,
 case when c_custkey % 13 = 0 then 'broken@'
      when c_custkey % 5 = 0 then lower('customer.' || lpad(cast(c_custkey + 1 as varchar), 9, '0')) || '@example.org'
      else 'moved.' || cast(c_custkey as varchar) || '@example.org' end email
from customer"""


def _register() -> dict[str, str]:
    shape = ("q.full_name is not null and q.date_of_birth is not null and q.gender is not null and "
             "q.nationality is not null and q.passport_no is not null and q.phone is not null and "
             f"q.email is not null and coalesce(regexp_matches(q.email, '{EMAIL_PATTERN}'), false)")
    rules = [
        (f"not ({shape})", 422, "invalid_request"),
        ("q.pp0 or list_contains(w.pps, q.passport_no)", 409, "passport_exists"),
        ("q.em0 or list_contains(w.ems, q.email)", 409, "email_exists"),
        ("q.gender not in ('Male', 'Female', 'Other')", 422, "invalid_gender"),
    ]
    code, reason = _case(rules, (201, "ok"))
    walk = f"""
with recursive pre as (
  select r.*, exists (select 1 from passengers p where p.passport_no = r.passport_no) pp0,
   exists (select 1 from passengers p where p.email = r.email) em0,
   row_number() over (order by r.requested_at, r.request_id) rn
  from ({PASSENGER_REQUESTS}) r),
 w(rn, pps, ems, request_id, code, reason) as (
  select cast(0 as bigint), cast([] as varchar[]), cast([] as varchar[]), cast(null as bigint),
   cast(null as integer), cast(null as varchar)
  union all
  select q.rn, case when ({code}) = 201 then list_append(w.pps, q.passport_no) else w.pps end,
   case when ({code}) = 201 then list_append(w.ems, q.email) else w.ems end, q.request_id, {code}, {reason}
  from w join pre q on q.rn = w.rn + 1)"""
    return {
        "register_passengers": walk + """
select request_id, code < 300 accepted, cast(code as integer) code, reason from w where rn > 0""",
        "register_passengers_new": walk + f"""
select full_name, gender, passport_no, email, created_at from passengers where passport_no like 'N%'
union all
select r.full_name, r.gender, r.passport_no, r.email, r.requested_at created_at
from w join ({PASSENGER_REQUESTS}) r on r.request_id = w.request_id where w.rn > 0 and w.code = 201""",
    }


def _update_passengers() -> dict[str, str]:
    fields = ["full_name", "date_of_birth", "gender", "nationality", "phone", "email"]
    sets = "(list_contains(q.set_fields, 'email') and q.email is not null)"
    nulls = " or ".join(f"(list_contains(q.set_fields, '{f}') and q.{f} is null)" for f in fields)
    rules = [
        (f"{sets} and not coalesce(regexp_matches(q.email, '{EMAIL_PATTERN}'), false)", 422,
         "invalid_request"),
        ("not q.found", 404, "passenger_not_found"),
        (f"{sets} and len(list_filter(w.st, lambda s: s.e = q.email and s.p <> q.passenger_id)) > 0 "
         f"and q.email <> coalesce(list_filter(w.st, lambda s: s.p = q.passenger_id)[1].e, '')", 409, "email_exists"),
        ("list_contains(q.set_fields, 'gender') and q.gender is not null and q.gender <> '' and "
         "q.gender not in ('Male', 'Female', 'Other')", 422, "invalid_gender"),
        (f"{nulls} or (list_contains(q.set_fields, 'gender') and q.gender = '')", 500,
         "constraint_violation"),
    ]
    code, reason = _case(rules, (200, "ok"))
    walk = f"""
with recursive pre as (
  select r.*, exists (select 1 from passengers p where p.passenger_id = r.passenger_id) found,
   row_number() over (order by r.requested_at, r.request_id) rn
  from ({PASSENGER_UPDATE_REQUESTS}) r),
 w(rn, st, request_id, code, reason) as (
  select cast(0 as bigint), (select list({{'p': passenger_id, 'e': email}}) from passengers),
   cast(null as bigint), cast(null as integer), cast(null as varchar)
  union all
  select q.rn,
   case when ({code}) = 200 and {sets}
        then list_transform(w.st, lambda s: case when s.p = q.passenger_id then {{'p': s.p, 'e': q.email}} else s end)
        else w.st end,
   q.request_id, {code}, {reason}
  from w join pre q on q.rn = w.rn + 1)"""
    acc = f"""
, acc as (select r.* from w join ({PASSENGER_UPDATE_REQUESTS}) r on r.request_id = w.request_id
          where w.rn > 0 and w.code = 200)"""
    return {
        "update_passengers": walk + """
select request_id, code < 300 accepted, cast(code as integer) code, reason from w where rn > 0""",
        "update_passengers_after": walk + acc + "\n" + applied(
            "passengers", "passenger_id", "select * from acc", fields,
            ["passenger_id", "full_name", "gender", "nationality", "phone", "email"]),
    }


def _log_rows() -> str:
    """The mixed command log: (request id * 16 + tag, time, command, and its fields)."""
    blank = {"booking_id": "bigint", "ref": "bigint", "passenger_id": "bigint", "flight_id": "bigint", "seat_id": "bigint",
             "staff_id": "bigint", "method": "varchar", "amount": "decimal(12,2)", "cancel_reason": "varchar",
             "boarding_status": "varchar"}

    def part(source: str, key: str, tag: int, command: str, at: str, where: str = "true", **given: str) -> str:
        fields = ", ".join(f"cast({given.get(c, 'null')} as {kind}) {c}" for c, kind in blank.items())
        return (f"select {key} * 16 + {tag} rid, {at} moment, '{command}' command, {fields} from {source} where {where}")

    new, ref = ("booking_requests", "request_id"), {"ref": "request_id * 16"}
    old, own = ("bookings_x", "booking_id"), {"booking_id": "booking_id"}

    def later(of: str, hours: str) -> str:
        return f"{of} + interval '1' hour * ({hours})"

    return " union all ".join([
        part(*new, 0, "book", "requested_at", **{c: c for c in ("passenger_id", "flight_id", "seat_id", "staff_id")}),
        part(*new, 1, "pay", later("requested_at", "if(request_id % 10 = 1, -1, 1)"), "request_id % 3 <> 0", method="'Card'",
             amount="if(request_id % 35 = 0, 0, 250)", **ref),
        part(*new, 2, "board", later("requested_at", "30"), "request_id % 2 = 0", boarding_status="'Boarded'", **ref),
        part(*new, 3, "cancel", later("requested_at", "if(request_id % 4 = 0, 20, 72)"), "request_id % 3 = 1",
             cancel_reason="'ill'", **ref),
        part(*old, 4, "pay", later("booked_at", "1"), method="'Cash'", amount="amount", **own),
        part(*old, 5, "board", later("booked_at", "30"), boarding_status="'Boarded'", **own),
        part(*old, 6, "board", later("booked_at", "31"), "o_orderstatus = 'F'", boarding_status="'No_Show'", **own),
        part(*old, 7, "cancel", later("booked_at", "48"), cancel_reason="if(booking_id % 22 = 0, null, 'schedule change')",
             **own)])


def _apply_commands() -> dict[str, str]:
    """Each flight's commands stepped through in order; the state is lists of what
    changed: seats (s, st), bookings (b, st, paid, rec), passengers of new bookings."""
    gone = "list_filter(bs, lambda y: y.b = x.b)[-1].st"
    verdict = f"""case
 when command = 'book' then case
  when passenger_id is null or flight_id is null or seat_id is null then '422 invalid_request'
  when not pfound then '404 passenger_not_found' when fstatus is null then '404 flight_not_found'
  when fstatus in {CLOSED} then '422 flight_closed'
  when len(list_filter(pairs, lambda x: coalesce({gone}, x.st) <> 'Cancelled')) > 0
   or len(list_filter(list_filter(np, lambda x: x.p = passenger_id), lambda x: {gone} <> 'Cancelled')) > 0
   then '409 duplicate_booking'
  when sflight is null or sflight <> flight_id then '404 seat_not_on_flight'
  when coalesce(list_filter(ss, lambda x: x.s = seat_id)[-1].st, sstatus) <> 'Available' then '409 seat_unavailable'
  when cap is null then '500 constraint_violation'
  when nlive + live >= cap then '409 flight_full'
  when len(pairs) > 0 or len(list_filter(np, lambda x: x.p = passenger_id)) > 0 or not stfound
   then '500 constraint_violation'
  else '201 ok' end
 when (command = 'pay' and (method is null or amount is null)) or (command = 'cancel' and cancel_reason is null)
  then '422 invalid_request'
 when st is null then '404 booking_not_found'
 when command = 'cancel' then if(st = 'Cancelled', '409 already_cancelled', '200 ok')
 when command = 'pay' then case when st = 'Cancelled' then '409 booking_cancelled' when paid then '409 payment_exists'
  when amount <= 0 or ticketed or fare is null or fare <= 0 then '500 constraint_violation' else '201 ok' end
 when st <> 'Confirmed' then '422 booking_not_confirmed' when rec then '201 status_updated'
 else '201 boarding_recorded' end"""
    walk = f"""
with recursive log as ({_log_rows()}),
 owned as (
  select l.*, coalesce(l.booking_id, -l.ref - 1) target, coalesce(b.flight_id, r.flight_id, l.flight_id, -2) g,
   coalesce(b.seat_id, r.seat_id) tseat, b.status status0
  from log l left join bookings b on b.booking_id = l.booking_id left join booking_requests r on r.request_id * 16 = l.ref),
 pair as (select flight_id, passenger_id, list({{'b': booking_id, 'st': status}}) pairs from bookings group by all),
 taken as (select flight_id, count(*) n from bookings where status in ('Pending', 'Confirmed') group by all),
 pre as (
  select o.*, p.passenger_id is not null pfound, f.status fstatus, a.seat_capacity cap, coalesce(k.n, 0) nlive,
   coalesce(c.pairs, []) pairs, s.flight_id sflight, s.status sstatus, h.staff_id is not null stfound,
   o.booking_id in (select booking_id from payments) paid0, o.booking_id in (select booking_id from tickets) ticketed,
   o.booking_id in (select booking_id from boarding_records) rec0, cast(tf.base_fare * fc.multiplier as decimal(12,2)) fare,
   row_number() over (partition by o.g order by o.moment, o.rid) rn
  from owned o left join passengers p on p.passenger_id = o.passenger_id left join flights f on f.flight_id = o.flight_id
   left join aircraft a on a.aircraft_id = f.aircraft_id left join taken k on k.flight_id = o.flight_id
   left join pair c on c.flight_id = o.flight_id and c.passenger_id = o.passenger_id
   left join seats s on s.seat_id = o.seat_id left join staff h on h.staff_id = o.staff_id
   left join flights tf on tf.flight_id = o.g left join seats ts on ts.seat_id = o.tseat
   left join fare_classes fc on fc.fare_class_id = ts.fare_class_id),
 w(g, rn, ss, bs, np, live, rid, verdict, seat_after) as (
  select distinct g, cast(0 as bigint), cast([] as struct(s bigint, st varchar)[]),
   cast([] as struct(b bigint, st varchar, paid boolean, rec boolean)[]), cast([] as struct(p bigint, b bigint)[]),
   cast(0 as bigint), cast(null as bigint), cast(null as varchar), cast(null as struct(s bigint, st varchar)) from pre
  union all
  select g, rn, if(seat_after is null, ss, list_append(ss, seat_after)),
   case when verdict not like '20%' or verdict like '%updated' then bs
    when command = 'book' then list_append(bs, {{'b': -rid - 1, 'st': 'Pending', 'paid': false, 'rec': false}})
    when command = 'pay' then list_append(bs, {{'b': target, 'st': 'Confirmed', 'paid': true, 'rec': rec}})
    when command = 'cancel' then list_append(bs, {{'b': target, 'st': 'Cancelled', 'paid': paid, 'rec': rec}})
    else list_append(bs, {{'b': target, 'st': st, 'paid': paid, 'rec': true}}) end,
   if(verdict = '201 ok' and command = 'book', list_append(np, {{'p': passenger_id, 'b': -rid - 1}}), np),
   live + case when verdict = '201 ok' and command = 'book' then 1 when verdict = '200 ok' then -1 else 0 end,
   rid, verdict, seat_after
  from (select *, case when verdict = '201 ok' and command = 'book' then {{'s': seat_id, 'st': 'Reserved'}}
     when verdict = '200 ok' then {{'s': tseat, 'st': 'Available'}}
     when verdict = '201 boarding_recorded' and boarding_status = 'Boarded' then {{'s': tseat, 'st': 'Occupied'}} end seat_after
   from (select *, {verdict} verdict
    from (select q.*, w.ss, w.bs, w.np, w.live, coalesce(c.st, q.status0) st, coalesce(c.paid, q.paid0, false) paid,
      coalesce(c.rec, q.rec0, false) rec
     from w join pre q on q.g = w.g and q.rn = w.rn + 1,
      lateral (select list_filter(w.bs, lambda x: x.b = q.target)[-1] c) as last(c)))))
, done as (select w.rid, w.verdict, w.seat_after, l.* exclude (rid) from w join owned l on l.rid = w.rid where w.rn > 0)"""
    made = "select * from done where command = 'book' and verdict = '201 ok'"
    return {
        "apply_commands": walk + """
select rid request_id, verdict < '3' accepted, cast(substr(verdict, 1, 3) as integer) code, substr(verdict, 5) reason from done""",
        "apply_commands_bookings": walk + f"""
, every as (
  select booking_id target, passenger_id, flight_id, seat_id, pnr, status, cancel_reason, cancelled_at from bookings
  union all select -rid - 1, passenger_id, flight_id, seat_id, {_pnr('rid')}, 'Pending', null, null from ({made}))
select e.passenger_id, e.flight_id, e.seat_id, e.pnr,
 case when c.rid is not null then 'Cancelled' when p.rid is not null then 'Confirmed' else e.status end status,
 coalesce(c.cancel_reason, e.cancel_reason) cancel_reason, coalesce(c.moment, e.cancelled_at) cancelled_at
from every e left join (select * from done where command = 'cancel' and verdict = '200 ok') c on c.target = e.target
 left join (select * from done where command = 'pay' and verdict = '201 ok') p on p.target = e.target""",
        "apply_commands_seats": walk + """
select s.seat_id, coalesce(x.st, s.status) status
from seats s left join (select seat_after.s seat_id, arg_max(seat_after.st, (moment, rid)) st from done
 where seat_after is not null group by all) x on x.seat_id = s.seat_id""",
    }


def bodies() -> dict[str, str]:
    out = {}
    out.update(_apply_commands())
    out.update(_admit())
    out.update(_register())
    out.update(_update_passengers())
    return out
