"""SQL text of the fixture mapping (FIXTURES.md), used as the oracle's prefix.

The Spark side derives the same tables with the DataFrame API in
``fixtures.py``; this text is only for the independent DuckDB oracle, which
receives it as a ``WITH`` prefix. Final columns are cast to the target types
of ``airops.schema`` so that both sides agree on types.
"""

from __future__ import annotations

EPOCH = "timestamp '2024-01-01 00:00:00'"

# (name, select) in dependency order
VIEWS: list[tuple[str, str]] = [
    ("airports", f"""
select cast(n_nationkey as bigint) airport_id, 'Airport ' || n_name airport_name,
 'AA' || chr(65 + n_nationkey) iata_code, n_name city, r_name country,
 cast(1 + n_nationkey % 4 as integer) terminals, n_nationkey % 12 <> 11 is_active,
 {EPOCH} + interval '1' hour * n_nationkey created_at
from nation join region on n_regionkey = r_regionkey"""),
    ("aircraft", f"""
select cast(s_suppkey as bigint) aircraft_id,
 'REG-' || lpad(cast(s_suppkey as varchar), 6, '0') registration_no, s_name model,
 cast(20 + 10 * (s_suppkey % 5) as integer) seat_capacity,
 case when s_suppkey % 10 = 7 then 'Maintenance' when s_suppkey % 10 = 9 then 'Retired'
      else 'Active' end status, {EPOCH} created_at
from supplier"""),
    ("fare_classes", f"""
select cast(r_regionkey as bigint) fare_class_id,
 case r_regionkey when 0 then 'Economy' when 1 then 'Economy Plus' when 2 then 'Premium'
      when 3 then 'Business' else 'First' end class_name,
 cast(1.00 + 0.50 * r_regionkey as decimal(4,2)) multiplier,
 cast(20 + 5 * r_regionkey as integer) baggage_allowance_kg, r_name description,
 {EPOCH} created_at
from region"""),
    ("passengers", f"""
select cast(c_custkey as bigint) passenger_id, c_name full_name,
 date_add(date '1950-01-01', cast(c_custkey % 18000 as integer)) date_of_birth,
 case c_custkey % 3 when 0 then 'Male' when 1 then 'Female' else 'Other' end gender,
 n_name nationality, 'P' || lpad(cast(c_custkey as varchar), 8, '0') passport_no,
 '+1' || lpad(cast(c_custkey as varchar), 9, '0') phone,
 lower(replace(c_name, '#', '.')) || '@example.org' email,
 {EPOCH} + interval '1' hour * cast(c_custkey % 500 as integer) created_at
from customer join nation on c_nationkey = n_nationkey"""),
    ("staff", f"""
select cast(s_suppkey as bigint) staff_id, s_name full_name,
 lower(replace(s_name, '#', '.')) || '@example.org' email,
 case s_suppkey % 5 when 0 then 'Super_Admin' when 1 then 'Operations_Manager'
      when 2 then 'Reservation_Agent' when 3 then 'Ground_Staff' else 'Finance_Officer' end role,
 s_suppkey % 9 <> 8 is_active, {EPOCH} created_at
from supplier"""),
    ("flights", f"""
select cast(p_partkey as bigint) flight_id, 'FL' || lpad(cast(p_partkey as varchar), 6, '0') flight_no,
 cast(p_partkey % 25 as bigint) origin_airport_id,
 cast((p_partkey + 1 + p_size % 24) % 25 as bigint) dest_airport_id,
 cast(p_partkey % (select count(*) from supplier) as bigint) aircraft_id,
 cast(p_retailprice as decimal(12,2)) base_fare,
 case p_partkey % 7 when 0 then 'Scheduled' when 1 then 'Boarding' when 2 then 'Cancelled'
      when 3 then 'Departed' else 'Arrived' end status,
 {EPOCH} + interval '1' hour * cast(p_partkey % 500 as integer) created_at
from part"""),
    ("flight_schedules", f"""
select cast(event_id as bigint) schedule_id, cast(event_id as bigint) flight_id,
 cast(date_trunc('hour', ts) as timestamp) dep_datetime,
 cast(date_trunc('hour', ts) + interval '2' hour as timestamp) arr_datetime,
 cast(case event_type when 'error' then null when 'view' then date_trunc('hour', ts)
      when 'signup' then date_trunc('hour', ts) - interval '5' minute else ts end as timestamp) actual_dep,
 cast(null as timestamp) actual_arr,
 'T' || cast(1 + event_id % 4 as varchar) terminal,
 case when event_id % 6 <> 0 then 'G' || cast(event_id % 30 as varchar) end gate,
 {EPOCH} created_at
from events join part on event_id = p_partkey where event_type <> 'click'"""),
    ("charges", """
select l_orderkey, min(l_partkey) flight_id,
 cast(sum(cast(l_extendedprice as decimal(12,2))) as decimal(12,2)) amount
from lineitem group by l_orderkey"""),
    ("bookings0", """
select o_orderkey booking_id, o_custkey passenger_id, flight_id,
 o_custkey % (select count(*) from supplier) staff_id,
 case o_orderpriority when '5-LOW' then 'Cancelled' when '4-NOT SPECIFIED' then 'Pending'
      else 'Confirmed' end status,
 o_orderdate + interval '1' hour * cast(o_orderkey % 24 as integer) booked_at, amount, o_orderstatus,
 cast(row_number() over (partition by flight_id order by o_orderkey) as bigint) seat_idx
from orders join charges on l_orderkey = o_orderkey"""),
    ("bookings_y", """
select b.* exclude (status, seat_idx),
 case when b.seat_idx <= a.seat_capacity then b.status else 'Cancelled' end status,
 case when b.seat_idx <= a.seat_capacity then b.seat_idx else 1 + b.booking_id % a.seat_capacity end seat_idx
from bookings0 b join flights f on b.flight_id = f.flight_id
 join aircraft a on f.aircraft_id = a.aircraft_id"""),
    ("bookings_x", """
select cast(b.booking_id as bigint) booking_id, cast(b.passenger_id as bigint) passenger_id,
 cast(b.flight_id as bigint) flight_id, cast(b.flight_id * 100 + b.seat_idx as bigint) seat_id,
 cast(b.staff_id as bigint) staff_id, 'PNR' || lpad(cast(b.booking_id as varchar), 8, '0') pnr, b.status,
 case when b.status = 'Cancelled' then 'changed plans' end cancel_reason,
 case when b.status = 'Cancelled' then b.booked_at + interval '12' hour end cancelled_at,
 b.booked_at, b.amount, b.o_orderstatus, cast(b.seat_idx as bigint) seat_idx
from bookings_y b"""),
    ("boarding_records", """
select b.booking_id boarding_id, b.booking_id, b.passenger_id, b.flight_id,
 case when b.booking_id % 8 = 0 then 'No_Show' else 'Boarded' end status,
 b.booked_at + interval '24' hour boarded_at
from bookings_x b join flights f on b.flight_id = f.flight_id
where b.status = 'Confirmed' and f.status in ('Boarding', 'Departed', 'Arrived')
 and b.o_orderstatus <> 'O'"""),
    ("seats", f"""
select f.flight_id * 100 + n.n seat_id, f.flight_id,
 cast(case when n.n <= 2 then 4 when n.n <= 4 then 3 when n.n <= 8 then 2 when n.n <= 12 then 1
      else 0 end as bigint) fare_class_id,
 lpad(cast(n.n as varchar), 3, '0') || 'A' seat_number,
 case when br.status = 'Boarded' then 'Occupied' when b.booking_id is not null then 'Reserved'
      else 'Available' end status, {EPOCH} created_at
from flights f join aircraft a on f.aircraft_id = a.aircraft_id
 join (select unnest(generate_series(1, 60)) n) n on n.n <= a.seat_capacity
 left join bookings_x b on b.flight_id = f.flight_id and b.seat_idx = n.n and b.status <> 'Cancelled'
 left join boarding_records br on br.booking_id = b.booking_id"""),
    ("payments", """
select booking_id payment_id, booking_id,
 case booking_id % 3 when 0 then 'Cash' when 1 then 'Card' else 'Bank_Transfer' end method, amount,
 case when status = 'Cancelled' then 'Refunded' when booking_id % 50 = 0 then 'Pending'
      else 'Completed' end status,
 case when status = 'Cancelled' then amount else cast(0 as decimal(12,2)) end refund_amount,
 booked_at + interval '30' minute payment_date, booked_at + interval '30' minute updated_at
from bookings_x where status = 'Confirmed' or (status = 'Cancelled' and o_orderstatus <> 'P')"""),
    ("tickets", """
select p.booking_id ticket_id, p.booking_id, s.fare_class_id,
 'TKT-' || lpad(cast(p.booking_id as varchar), 8, '0') ticket_no, f.base_fare,
 fc.multiplier multiplier_snapshot, cast(f.base_fare * fc.multiplier as decimal(12,2)) final_fare,
 p.payment_date issue_date, b.status = 'Cancelled' is_cancelled
from payments p join bookings_x b on p.booking_id = b.booking_id
 join flights f on b.flight_id = f.flight_id join seats s on s.seat_id = b.seat_id
 join fare_classes fc on fc.fare_class_id = s.fare_class_id
where p.status <> 'Pending'"""),
    ("bookings", """
select booking_id, passenger_id, flight_id, seat_id, staff_id, pnr, status, cancel_reason,
 cancelled_at, booked_at from bookings_x"""),
    ("booking_requests", """
select o_orderkey request_id, case when o_orderkey % 40 = 0 then -1 else o_custkey end passenger_id,
 case when o_orderkey % 45 = 0 then -1 else cast(floor(o_custkey / 6) as bigint) % (select count(*) from part) end flight_id,
 (cast(floor(o_custkey / 6) as bigint) % (select count(*) from part)) * 100 + 1
  + cast(floor(o_custkey / 2) as bigint) % 20 seat_id,
 o_custkey % (select count(*) from supplier) staff_id, o_orderdate requested_at
from orders"""),
    ("cancel_requests", """
select booking_id + 1000000 request_id, booking_id,
 case when booking_id % 22 = 0 then null else 'schedule change' end cancel_reason,
 booked_at + interval '48' hour requested_at
from bookings_x"""),
    ("payment_requests", """
select booking_id + 2000000 request_id, booking_id, 'Card' method,
 case when booking_id % 35 = 0 then cast(0 as decimal(12,2)) else amount end amount,
 booked_at + interval '1' hour requested_at
from bookings_x"""),
    ("boarding_events", """
select booking_id * 2 event_id, booking_id, 'Boarded' status, booked_at + interval '30' hour event_ts
from bookings_x
union all
select booking_id * 2 + 1 event_id, booking_id, 'No_Show' status, booked_at + interval '31' hour event_ts
from bookings_x where o_orderstatus = 'F'"""),
]


def with_prefix(body: str, only: set[str] | None = None) -> str:
    """``WITH <views> <body>``: the fixture views as CTEs ahead of a query."""
    names = [n for n, _ in VIEWS]
    needed = set(names) if only is None else _closure(only)
    ctes = [f"{n} as ({sql.strip()})" for n, sql in VIEWS if n in needed]
    body = body.strip()
    if body[:15].lower() == "with recursive ":
        return "with recursive " + ",\n".join(ctes) + ",\n" + body[15:]
    if body[:5].lower() == "with ":  # the body's own CTEs follow the views
        return "with " + ",\n".join(ctes) + ",\n" + body[5:]
    return "with " + ",\n".join(ctes) + "\n" + body


_DEPS = {
    "airports": set(), "aircraft": set(), "fare_classes": set(), "passengers": set(),
    "staff": set(), "flights": set(), "flight_schedules": set(), "charges": set(),
    "bookings0": {"charges"}, "bookings_y": {"bookings0", "flights", "aircraft"}, "bookings_x": {"bookings_y"},
    "boarding_records": {"bookings_x", "flights"},
    "seats": {"flights", "aircraft", "bookings_x", "boarding_records"},
    "payments": {"bookings_x"},
    "tickets": {"payments", "bookings_x", "flights", "seats", "fare_classes"},
    "bookings": {"bookings_x"}, "booking_requests": set(), "cancel_requests": {"bookings_x"},
    "payment_requests": {"bookings_x"}, "boarding_events": {"bookings_x"},
}


def _closure(names: set[str]) -> set[str]:
    out: set[str] = set()
    todo = list(names)
    while todo:
        n = todo.pop()
        if n in out:
            continue
        out.add(n)
        todo.extend(_DEPS[n])
    return out
