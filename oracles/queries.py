"""Independent DuckDB SQL for each registered query (the correctness oracle).

Each body runs after the fixture views (``fixture_sql.with_prefix``). Money
is computed exactly (DECIMAL / HUGEINT) and cast to DOUBLE at the end, as on
the Spark side; percentages use integer arithmetic.
"""

from __future__ import annotations

from airops.operators import audits as _A
from airops.registry import (AIRPORT_COUNTRY, AIRPORT_SEARCH, DATE_FROM, DATE_TO, FLIGHT_DEST, FLIGHT_ORIGIN,
                             GENERATED_AT, MANIFEST_STATUS, PASSENGER_SEARCH)
from airops.schema import TABLE_SCHEMAS
from oracles import reference as _ref
from oracles import serial as _serial
from oracles.fixture_sql import with_prefix


def avg2(total: str, count: str) -> str:
    """round(total / count, 2) half up, exact, as double (total >= 0)."""
    return (f"cast((cast({total} * 100 as hugeint) * 2 + {count}) // (2 * {count}) as double)"
            " / 100.0")


def pct_up(n: str, d: str) -> str:
    return f"((cast({n} as bigint) * 2000 + nullif({d}, 0)) // (2 * nullif({d}, 0))) / 10.0"


def pct_even(n: str, d: str) -> str:
    q = f"((cast({n} as bigint) * 1000) // nullif({d}, 0))"
    r = f"(cast({n} as bigint) * 1000 - {q} * {d})"
    return (f"case when {d} = 0 then 0.0 else ({q} + case when 2 * {r} > {d} or "
            f"(2 * {r} = {d} and {q} % 2 = 1) then 1 else 0 end) / 10.0 end")


def dated(date_from: str | None, date_to: str | None, col: str = "p.payment_date") -> str:
    s = ""
    if date_from:
        s += f" and {col} >= cast(date '{date_from}' as timestamp)"
    if date_to:
        s += f" and {col} <= cast(date '{date_to}' as timestamp)"
    return s


def _paid(df=None, dt=None, statuses: str = "'Completed'") -> str:
    """A CTE ``paid``: the payments of a report's window, one row each."""
    return (f"paid as (select * from payments p where p.status in ({statuses}){dated(df, dt)})")


#: Airport pairs of the flights, labelled.
_LEGS = """legs as (
 select flight_id, flight_no, aircraft_id,
  (select iata_code from airports where airport_id = origin_airport_id)
  || ' → ' || (select iata_code from airports where airport_id = dest_airport_id) route
 from flights)"""


def _takings(df=None, dt=None) -> str:
    """CTEs ``legs`` and ``takings``: number and sum of the payments of each flight that has any."""
    return f"""{_LEGS}, {_paid(df, dt)}, takings as (
 select flight_id, count(*) n, sum(amount) total
 from (select booking_id, flight_id from bookings) natural join (select booking_id, amount from paid)
 group by flight_id)"""


def _summary(df=None, dt=None) -> str:
    both = "'Completed', 'Refunded'"
    return f"""
select n total_transactions, cast(gross as double) total_revenue, {avg2('gross', 'n')} average_fare,
 cast(back as double) total_refunds, cast(gross - back as double) net_revenue
from (with {_paid(df, dt, both)} select count(*) n, sum(amount) gross, sum(refund_amount) back from paid)"""


def _by_class(df=None, dt=None) -> str:
    return f"""
select class_name, n tickets_sold, cast(total as double) class_revenue, {avg2('total', 'n')} avg_fare,
 cast(multiplier as double) multiplier
from (with {_paid(df, dt)}, sold as (
  select fare_class_id, final_fare from tickets
  where not is_cancelled and booking_id in (select booking_id from paid)
   and booking_id in (select booking_id from bookings))
 select class_name, multiplier, count(*) n, sum(final_fare) total
 from sold natural join (select fare_class_id, class_name, multiplier from fare_classes)
 group by all)"""


def _by_route(df=None, dt=None) -> str:
    return f"""
select route, n bookings, cast(total as double) route_revenue, {avg2('total', 'n')} avg_fare
from (with {_takings(df, dt)}
 select route, cast(sum(n) as bigint) n, sum(total) total from takings natural join legs group by route)"""


def _by_method(df=None, dt=None) -> str:
    return f"""
select payment_method, n transaction_count, cast(total as double) method_revenue
from (with {_paid(df, dt)}
 select distinct method payment_method, count(*) over same n, sum(amount) over same total
 from paid window same as (partition by method))"""


def _top(df=None, dt=None) -> str:
    return f"""
select flight_no, route, n passengers, cast(total as double) flight_revenue
from (with {_takings(df, dt)}
 select flight_no, route, n, total, row_number() over (order by total desc, flight_no) place
 from takings natural join legs)
where place <= 10"""


REPORTS: dict[str, str] = {
    "revenue_summary": _summary(),
    "revenue_summary_dated": f"""
select '{DATE_FROM}' date_from, '{DATE_TO}' date_to, s.* from ({_summary(DATE_FROM, DATE_TO)}) s""",
    "revenue_by_class": _by_class(),
    "revenue_by_class_dated": _by_class(DATE_FROM, DATE_TO),
    "revenue_by_route": _by_route(),
    "revenue_by_route_dated": _by_route(DATE_FROM, DATE_TO),
    "revenue_by_method": _by_method(),
    "revenue_by_method_dated": _by_method(DATE_FROM, DATE_TO),
    "top_flights": _top(),
    "top_flights_dated": _top(DATE_FROM, DATE_TO),
    "flights_by_status": "select status, count(*) flight_count from flights group by status",
    "seat_occupancy": f"""
select flight_no, route, seat_capacity, n confirmed_bookings, {pct_up('n', 'seat_capacity')} occupancy_percent
from (with {_LEGS}
 select flight_no, route, seat_capacity,
  (select count(*) from bookings b where b.flight_id = legs.flight_id and b.status = 'Confirmed') n
 from legs natural join (select aircraft_id, seat_capacity from aircraft))""",
    "noshow_rates": f"""
select flight_no, n total_boarded, missing no_shows, there boarded, {pct_up('missing', 'n')} noshow_percent
from (select flight_id, count(*) n, count(*) filter (status = 'No_Show') missing,
       count(*) filter (status = 'Boarded') there
      from boarding_records group by flight_id)
 natural join (select flight_id, flight_no from flights)""",
    "ontime_performance": """
select flight_no, dep_datetime scheduled_dep, actual_dep,
 if(us is null, 'Not Departed', if(us > 0, 'Delayed', 'On Time')) departure_status,
 greatest(coalesce(us, 0), 0) / 60000000.0 delay_minutes
from (select flight_id, dep_datetime, actual_dep, epoch_us(actual_dep) - epoch_us(dep_datetime) us
      from flight_schedules)
 natural join (select flight_id, flight_no from flights)""",
    "overall_stats": """
select * from (
 with known as (select * from bookings where flight_id in (select flight_id from flights))
 select (select count(*) from flights) total_flights, (select count(*) from known) total_bookings,
  (select count(*) from passengers where passenger_id in (select passenger_id from known)) total_passengers,
  (select count(*) from known where status = 'Cancelled') cancelled_bookings)""",
}

BODIES: dict[str, str] = {}
BODIES.update(REPORTS)


# --- 2.3 views -----------------------------------------------------------------
_MANIFEST = """
select f.flight_no, f.flight_id, fs.dep_datetime scheduled_departure, fs.arr_datetime scheduled_arrival,
 oa.iata_code origin_iata, da.iata_code destination_iata, p.passenger_id, p.full_name passenger_name,
 p.passport_no, s.seat_number, fc.class_name travel_class, t.ticket_no, b.pnr, b.booking_id,
 b.status booking_status, coalesce(br.status, 'Not Boarded') boarding_status, br.boarded_at,
 cast(t.final_fare as double) final_fare
from bookings b join flights f on b.flight_id = f.flight_id
 join airports oa on f.origin_airport_id = oa.airport_id
 join airports da on f.dest_airport_id = da.airport_id
 join passengers p on b.passenger_id = p.passenger_id
 join seats s on b.seat_id = s.seat_id join fare_classes fc on s.fare_class_id = fc.fare_class_id
 left join flight_schedules fs on fs.flight_id = f.flight_id
 left join tickets t on t.booking_id = b.booking_id
 left join boarding_records br on br.booking_id = b.booking_id"""

VIEWS_SQL: dict[str, str] = {
    "boarding_list": """
select b.flight_id, b.booking_id, b.pnr, p.passenger_id, p.full_name passenger_name, p.passport_no,
 s.seat_number, fc.class_name travel_class, t.ticket_no,
 coalesce(br.status, 'Not Boarded') boarding_status, br.boarded_at
from bookings b join flights f on b.flight_id = f.flight_id
 join passengers p on b.passenger_id = p.passenger_id
 join seats s on b.seat_id = s.seat_id join fare_classes fc on s.fare_class_id = fc.fare_class_id
 left join tickets t on t.booking_id = b.booking_id
 left join boarding_records br on br.booking_id = b.booking_id
where b.status = 'Confirmed'""",
    "boarding_summary": f"""
select f.flight_id, f.flight_no, f.status flight_status, count(b.booking_id) total_confirmed,
 count(case when br.status = 'Boarded' then 1 end) total_boarded,
 {pct_even("count(case when br.status = 'Boarded' then 1 end)", 'count(b.booking_id)')} boarding_percent
from flights f left join bookings b on b.flight_id = f.flight_id and b.status = 'Confirmed'
 left join boarding_records br on br.booking_id = b.booking_id
group by f.flight_id, f.flight_no, f.status""",
    "flight_manifest": _MANIFEST,
    "manifest_filtered": f"select * from ({_MANIFEST}) m where lower(boarding_status) = lower('{MANIFEST_STATUS}')",
    "manifest_header": f"""
select f.flight_id, f.flight_no, oa.iata_code origin, da.iata_code destination,
 (select count(*) from ({_MANIFEST}) m where m.flight_id = f.flight_id) total_passengers,
 timestamp '{GENERATED_AT}' generated_at
from flights f join airports oa on f.origin_airport_id = oa.airport_id
 join airports da on f.dest_airport_id = da.airport_id""",
    "travel_history": """
select b.passenger_id, b.booking_id, b.pnr, b.status booking_status, b.booked_at, b.cancelled_at,
 f.flight_no, oa.iata_code origin, da.iata_code destination, fs.dep_datetime scheduled_departure,
 fs.arr_datetime scheduled_arrival, f.status flight_status, s.seat_number, fc.class_name travel_class,
 t.ticket_no, cast(t.final_fare as double) final_fare, pay.status payment_status, pay.method payment_method
from bookings b join passengers p on b.passenger_id = p.passenger_id
 join flights f on b.flight_id = f.flight_id
 join airports oa on f.origin_airport_id = oa.airport_id
 join airports da on f.dest_airport_id = da.airport_id
 join seats s on b.seat_id = s.seat_id join fare_classes fc on s.fare_class_id = fc.fare_class_id
 left join flight_schedules fs on fs.flight_id = f.flight_id
 left join tickets t on t.booking_id = b.booking_id
 left join payments pay on pay.booking_id = b.booking_id""",
    "travel_history_summary": """
select p.passenger_id, p.full_name, p.passport_no, count(b.booking_id) total_trips
from passengers p left join bookings b on b.passenger_id = p.passenger_id
group by p.passenger_id, p.full_name, p.passport_no""",
    "seat_map": """
select s.seat_id, s.flight_id, s.fare_class_id, s.seat_number, s.status, fc.class_name
from seats s join flights f on s.flight_id = f.flight_id
 join fare_classes fc on s.fare_class_id = fc.fare_class_id""",
    "seat_availability": """
select f.flight_id, count(s.seat_id) total_seats,
 count(case when s.status = 'Available' then 1 end) available_seats,
 count(case when s.status = 'Reserved' then 1 end) reserved_seats,
 count(case when s.status = 'Occupied' then 1 end) occupied_seats
from flights f left join seats s on s.flight_id = f.flight_id group by f.flight_id""",
    "flight_details": """
select f.flight_id, f.flight_no, f.origin_airport_id, f.dest_airport_id, f.aircraft_id,
 cast(f.base_fare as double) base_fare, f.status, f.created_at, oa.iata_code origin_iata,
 da.iata_code dest_iata, ac.model aircraft_model
from flights f join airports oa on f.origin_airport_id = oa.airport_id
 join airports da on f.dest_airport_id = da.airport_id join aircraft ac on f.aircraft_id = ac.aircraft_id""",
}
BODIES.update(VIEWS_SQL)


# --- 2.4 listings and lookups ------------------------------------------------------

def _flight_page(where: str, skip: int, limit: int) -> str:
    return f"""
select f.*, oa.iata_code origin_iata, da.iata_code dest_iata, ac.model aircraft_model
from (select flight_id, flight_no, origin_airport_id, dest_airport_id, aircraft_id,
        cast(base_fare as double) base_fare, status, created_at from flights {where}
      order by created_at desc, flight_id limit {limit} offset {skip}) f
 join airports oa on f.origin_airport_id = oa.airport_id
 join airports da on f.dest_airport_id = da.airport_id join aircraft ac on f.aircraft_id = ac.aircraft_id"""


_FLIGHT_WHERE = f"""where status = 'Scheduled'
 and ((select min(airport_id) from airports where iata_code = upper('{FLIGHT_ORIGIN}')) is null
      or origin_airport_id = (select min(airport_id) from airports where iata_code = upper('{FLIGHT_ORIGIN}')))
 and ((select min(airport_id) from airports where iata_code = upper('{FLIGHT_DEST}')) is null
      or dest_airport_id = (select min(airport_id) from airports where iata_code = upper('{FLIGHT_DEST}')))"""
_PAX_WHERE = (f"where full_name ilike '%{PASSENGER_SEARCH}%' or passport_no ilike '%{PASSENGER_SEARCH}%'"
              f" or email ilike '%{PASSENGER_SEARCH}%' or phone ilike '%{PASSENGER_SEARCH}%'")
_AIRPORT_WHERE = (f"where (airport_name ilike '%{AIRPORT_SEARCH}%' or iata_code ilike '%{AIRPORT_SEARCH}%'"
                  f" or city ilike '%{AIRPORT_SEARCH}%') and country ilike '%{AIRPORT_COUNTRY}%'"
                  " and is_active = true")

LISTINGS_SQL: dict[str, str] = {
    "list_passengers": f"select * from passengers {_PAX_WHERE} order by created_at desc, passenger_id limit 50 offset 50",
    "list_passengers_total": f"select count(*) total from passengers {_PAX_WHERE}",
    "list_airports": f"select * from airports {_AIRPORT_WHERE} order by iata_code, airport_id limit 10",
    "list_airports_total": f"select count(*) total from airports {_AIRPORT_WHERE}",
    "list_aircraft": "select * from aircraft where status = 'Active' order by registration_no, aircraft_id limit 20 offset 10",
    "list_aircraft_total": "select count(*) total from aircraft where status = 'Active'",
    "list_fare_classes": """select fare_class_id, class_name, cast(multiplier as double) multiplier,
 baggage_allowance_kg, description, created_at from fare_classes""",
    "list_staff": "select staff_id, full_name, email, role, is_active, created_at from staff",
    "list_flights": _flight_page(_FLIGHT_WHERE, 0, 50),
    "list_flights_total": f"select count(*) total from flights {_FLIGHT_WHERE}",
    "list_bookings": "select * from bookings where status = 'Cancelled' order by booked_at desc, booking_id limit 200 offset 0",
    "list_bookings_deep": "select * from bookings order by booked_at desc, booking_id limit 200 offset 12000",
}

# bulk lookups: kind -> (table, key column, SQL of the key set)
LOOKUP_KEYS = {
    "passenger": ("passengers", "passenger_id", "select passenger_id key from booking_requests"),
    "flight": ("flights", "flight_id", "select flight_id key from booking_requests"),
    "schedule": ("flight_schedules", "flight_id", "select flight_id key from booking_requests"),
    "booking": ("bookings", "booking_id", "select request_id key from booking_requests"),
    "payment": ("payments", "booking_id", "select request_id key from booking_requests"),
    "ticket": ("tickets", "booking_id", "select request_id key from booking_requests"),
    "airport": ("airports", "airport_id",
                "select origin_airport_id key from flights union all select dest_airport_id from flights"),
    "aircraft": ("aircraft", "aircraft_id", "select aircraft_id key from flights"),
    "staff": ("staff", "staff_id", "select staff_id key from bookings"),
    "fare_class": ("fare_classes", "fare_class_id", "select fare_class_id key from seats"),
}


def _lookup_sql(table: str, col: str, keys: str) -> str:
    fields = [f for f in TABLE_SCHEMAS[table].fields if f.name != col]
    sel = ", ".join(f"cast(t.{f.name} as double) {f.name}" if f.dataType.typeName() == "decimal"
                    else f"t.{f.name}" for f in fields)
    return (f"select k.key, t.{col} is not null found, {sel} from (select distinct key from ({keys})) k"
            f" left join {table} t on k.key = t.{col}")


for _kind, (_tb, _col, _keys) in LOOKUP_KEYS.items():
    LISTINGS_SQL[f"bulk_lookup_{_kind}"] = _lookup_sql(_tb, _col, _keys)

LISTINGS_SQL["bulk_lookup_pnr"] = """
select k.key, b.booking_id is not null found, b.* from
 (select distinct lower('PNR' || lpad(cast(request_id as varchar), 8, '0')) key from booking_requests) k
 left join bookings b on upper(k.key) = b.pnr"""
LISTINGS_SQL["bulk_lookup_ticket_no"] = """
select k.key, t.ticket_id is not null found, t.ticket_id, t.booking_id, t.fare_class_id, t.ticket_no,
 cast(t.base_fare as double) base_fare, cast(t.multiplier_snapshot as double) multiplier_snapshot,
 cast(t.final_fare as double) final_fare, t.issue_date, t.is_cancelled from
 (select distinct lower('TKT-' || lpad(cast(request_id as varchar), 8, '0')) key from booking_requests) k
 left join tickets t on upper(k.key) = t.ticket_no"""
BODIES.update(LISTINGS_SQL)


# --- 2.6 audits ------------------------------------------------------------------


def _audit_unique_sql() -> str:
    parts = []
    for name, table, cols in _A.unique_constraints():
        keys = ", ".join(cols)
        nn = " and ".join(f"{c} is not null" for c in cols)
        parts.append(f"select '{name}' constraint_name, '{table}' table_name, "
                     f"cast(count(*) as bigint) duplicated_keys, cast(coalesce(sum(n - 1), 0) as bigint) violations "
                     f"from (select {keys}, count(*) n from {table} where {nn} group by {keys} having count(*) > 1) d")
    return "\nunion all\n".join(parts)


def _audit_fk_sql() -> str:
    parts = []
    for table, col, parent, pkey in _A.FOREIGN_KEYS:
        parts.append(f"select '{table}_{col}_fkey' constraint_name, '{table}' table_name, "
                     f"cast(count(*) as bigint) violations from {table} c "
                     f"where c.{col} is not null and not exists (select 1 from {parent} p where p.{pkey} = c.{col})")
    return "\nunion all\n".join(parts)


def _audit_checks_sql() -> str:
    return "\nunion all\n".join(
        f"select '{n}' constraint_name, '{tb}' table_name, "
        f"cast(count(case when not ({e}) then 1 end) as bigint) violations from {tb}"
        for n, tb, e in _A.CHECK_CONSTRAINTS)


def _audit_domain_sql() -> str:
    parts = []
    for table in TABLE_SCHEMAS:
        for n, cond in _A.domain_rules(table):
            cond = cond.replace("regexp_like(", "regexp_matches(")
            parts.append(f"select '{n}' constraint_name, '{table}' table_name, "
                         f"cast(count(case when {cond} then 1 end) as bigint) violations from {table}")
    return "\nunion all\n".join(parts)


BODIES.update({
    "audit_unique": _audit_unique_sql(),
    "audit_foreign_keys": _audit_fk_sql(),
    "audit_checks": _audit_checks_sql(),
    "audit_domain": _audit_domain_sql(),
})


# --- 2.5 command batches (booking-keyed) ----------------------------------------------
_CANCEL_OUT = """
select r.request_id, r.booking_id, r.cancel_reason, r.requested_at,
 case when r.cancel_reason is null or r.booking_id is null then 422 when b.booking_id is null then 404
      when b.status = 'Cancelled' or r.vrn > 1 then 409 else 200 end code
from (select c.*, case when c.cancel_reason is not null then row_number() over
        (partition by c.booking_id, c.cancel_reason is not null order by c.requested_at, c.request_id) end vrn
      from cancel_requests c) r
left join bookings b on b.booking_id = r.booking_id"""


COMMANDS_SQL: dict[str, str] = {
    "cancel_bookings": f"""
select request_id, code < 300 accepted, cast(code as integer) code,
 case when code = 422 then 'invalid_request' when code = 404 then 'booking_not_found'
      when code = 409 then 'already_cancelled' else 'ok' end reason
from ({_CANCEL_OUT}) o""",
    "cancel_bookings_after": f"""
select b.booking_id, case when a.booking_id is not null then 'Cancelled' else b.status end status,
 case when a.booking_id is not null then a.cancel_reason else b.cancel_reason end cancel_reason,
 case when a.booking_id is not null then a.requested_at else b.cancelled_at end cancelled_at
from bookings b left join (select * from ({_CANCEL_OUT}) o where code = 200) a on a.booking_id = b.booking_id""",
}

_PAY_OUT = """
select r.*, case
  when r.method not in ('Cash', 'Card', 'Bank_Transfer') or r.amount is null or r.booking_id is null then 422
  when r.bstatus is null then 404
  when r.bstatus = 'Cancelled' then 409
  when r.paid or (r.acc is not null and r.acc_ts < r.requested_at)
       or (r.acc_ts = r.requested_at and r.acc < r.request_id) then 409
  when r.dbfail then 500 else 201 end code
from (
 select q.*,
  first_value(case when q.cand then q.requested_at end ignore nulls) over w acc_ts,
  first_value(case when q.cand then q.request_id end ignore nulls) over w acc
 from (
  select p.*, b.status bstatus, exists (select 1 from payments x where x.booking_id = p.booking_id) paid,
   (p.amount <= 0 or exists (select 1 from tickets x where x.booking_id = p.booking_id)
    or f.base_fare is null) dbfail,
   f.base_fare, fc.multiplier, s.fare_class_id,
   (p.method in ('Cash', 'Card', 'Bank_Transfer') and p.amount is not null and b.status is not null
    and b.status <> 'Cancelled' and not exists (select 1 from payments x where x.booking_id = p.booking_id)
    and not (p.amount <= 0 or exists (select 1 from tickets x where x.booking_id = p.booking_id)
             or f.base_fare is null)) cand
  from payment_requests p left join bookings b on b.booking_id = p.booking_id
   left join seats s on s.seat_id = b.seat_id
   left join fare_classes fc on fc.fare_class_id = s.fare_class_id
   left join flights f on f.flight_id = b.flight_id and s.seat_id is not null and fc.fare_class_id is not null
 ) q
 window w as (partition by q.booking_id order by case when q.cand then 0 else 1 end, q.requested_at, q.request_id
              rows between unbounded preceding and unbounded following)
) r"""

COMMANDS_SQL["process_payments"] = f"""
select request_id, code < 300 accepted, cast(code as integer) code,
 case when code = 422 then 'invalid_request' when code = 404 then 'booking_not_found'
      when code = 409 and bstatus = 'Cancelled' then 'booking_cancelled'
      when code = 409 then 'payment_exists' when code = 500 then 'constraint_violation' else 'ok' end reason
from ({_PAY_OUT}) o"""
COMMANDS_SQL["process_payments_tickets"] = f"""
select booking_id, fare_class_id, 'TKT-R' || cast(request_id as varchar) ticket_no,
 cast(base_fare as double) base_fare, cast(multiplier as double) multiplier_snapshot,
 cast(cast(base_fare * multiplier as decimal(12,2)) as double) final_fare, requested_at issue_date,
 false is_cancelled
from ({_PAY_OUT}) o where code = 201"""

_BOARD_OUT = """
select e.*, case
  when e.status not in ('Boarded', 'No_Show') or e.booking_id is null then 422
  when e.bstatus is null then 404
  when e.bstatus <> 'Confirmed' then 422
  when e.has_rec or e.vrn > 1 then 200 else 201 end code
from (
 select v.*, case when v.valid then row_number() over
   (partition by v.booking_id, v.valid order by v.event_ts, v.event_id) end vrn
 from (
  select x.*, b.status bstatus, exists (select 1 from boarding_records r where r.booking_id = x.booking_id) has_rec,
   coalesce(x.status in ('Boarded', 'No_Show') and b.status = 'Confirmed', false) valid
  from boarding_events x left join bookings b on b.booking_id = x.booking_id) v
) e"""
COMMANDS_SQL["record_boarding"] = f"""
select event_id request_id, code < 300 accepted, cast(case when code = 200 then 201 else code end as integer) code,
 case when code = 422 and bstatus is not null and status in ('Boarded', 'No_Show') then 'booking_not_confirmed'
      when code = 422 then 'invalid_request' when code = 404 then 'booking_not_found'
      when code = 200 then 'status_updated' else 'boarding_recorded' end reason
from ({_BOARD_OUT}) o"""
COMMANDS_SQL["record_boarding_after"] = f"""
with v as (select * from ({_BOARD_OUT}) o where code < 300),
 last as (select booking_id, arg_max(status, (epoch_us(event_ts), event_id)) st from v group by booking_id),
 first as (select booking_id, arg_min(struct_pack(s := status, ts := event_ts, id := event_id),
                  (epoch_us(event_ts), event_id)) f from v group by booking_id)
select r.booking_id, coalesce(l.st, r.status) status, r.boarded_at, r.passenger_id, r.flight_id
from boarding_records r left join last l on l.booking_id = r.booking_id
union all
select f.booking_id, l.st status, f.f.ts boarded_at, b.passenger_id, b.flight_id
from first f join last l on l.booking_id = f.booking_id join bookings b on b.booking_id = f.booking_id
where not exists (select 1 from boarding_records r where r.booking_id = f.booking_id)"""

# the other tables that a batch changes
COMMANDS_SQL["cancel_bookings_seats"] = f"""
with c as (select distinct b.seat_id from ({_CANCEL_OUT}) o join bookings b on b.booking_id = o.booking_id
           where o.code = 200)
select s.seat_id, case when c.seat_id is not null then 'Available' else s.status end status
from seats s left join c on c.seat_id = s.seat_id"""
COMMANDS_SQL["write_snapshot"] = f"""
select 0 as version, 'bookings' as table_name, booking_id as id, status from bookings
union all select 0, 'seats', seat_id, status from seats
union all select 1, 'bookings', booking_id, status from ({COMMANDS_SQL["cancel_bookings_after"]}) b
union all select 1, 'seats', seat_id, status from ({COMMANDS_SQL["cancel_bookings_seats"]}) s"""
COMMANDS_SQL["cancel_bookings_payments"] = f"""
with c as (select booking_id, requested_at from ({_CANCEL_OUT}) o where code = 200)
select p.booking_id, case when hit then 'Refunded' else p.status end status,
 cast(case when hit then p.amount else p.refund_amount end as double) refund_amount,
 case when hit then p.requested_at else p.updated_at end updated_at
from (select x.*, c.requested_at, c.booking_id is not null and x.status = 'Completed' hit
      from payments x left join c on c.booking_id = x.booking_id) p"""
COMMANDS_SQL["cancel_bookings_tickets"] = f"""
select t.ticket_id, t.is_cancelled or exists (
  select 1 from ({_CANCEL_OUT}) o where o.code = 200 and o.booking_id = t.booking_id) is_cancelled
from tickets t"""
COMMANDS_SQL["process_payments_payments"] = f"""
select booking_id, method, cast(amount as double) amount, status, cast(refund_amount as double) refund_amount,
 payment_date, updated_at from payments
union all
select booking_id, method, cast(amount as double), 'Completed', 0.0, requested_at, requested_at
from ({_PAY_OUT}) o where code = 201"""
COMMANDS_SQL["process_payments_bookings"] = f"""
select b.booking_id, case when exists (select 1 from ({_PAY_OUT}) o where o.code = 201 and o.booking_id = b.booking_id)
 then 'Confirmed' else b.status end status from bookings b"""
COMMANDS_SQL["record_boarding_seats"] = f"""
with c as (select distinct b.seat_id from ({_BOARD_OUT}) o join bookings b on b.booking_id = o.booking_id
           where o.code = 201 and o.status = 'Boarded')
select s.seat_id, case when c.seat_id is not null then 'Occupied' else s.status end status
from seats s left join c on c.seat_id = s.seat_id"""
BODIES.update(COMMANDS_SQL)


# --- the report documents as rows: one line per entry of a section, in its order ---------
_REPORT_SECTIONS = {
    "revenue_report_rows": [
        ("by_class", "revenue_by_class", "class_name", "tickets_sold", "class_revenue", "avg_fare"),
        ("by_route", "revenue_by_route", "route", "bookings", "route_revenue", "avg_fare"),
        ("by_method", "revenue_by_method", "payment_method", "transaction_count", "method_revenue", "null"),
        ("top_flights", "top_flights", "flight_no", "passengers", "flight_revenue", "null")],
    "operational_report_rows": [
        ("flights_by_status", "flights_by_status", "status", "flight_count", "cast(flight_count as double)",
         "null")],
}


def _report_rows(name: str) -> str:
    lines = [f"""
select '{section}' section, row_number() over (order by {amount} desc nulls last, {label}) as position,
 {label} entry, cast({n} as bigint) entries, {amount} amount, cast({average} as double) average
from ({BODIES[query]}) x""" for section, query, label, n, amount, average in _REPORT_SECTIONS[name]]
    if name == "revenue_report_rows":
        lines.append(f"""
select 'summary', 1, 'All time', total_transactions, net_revenue, average_fare from ({BODIES['revenue_summary']}) x""")
    else:
        lines += [f"""
select 'overall_stats', {k}, '{c}', cast({c} as bigint), cast({c} as double), cast(null as double)
from ({BODIES['overall_stats']}) x""" for k, c in enumerate(
            ("total_flights", "total_bookings", "total_passengers", "cancelled_bookings"), start=1)]
    return "\nunion all\n".join(lines)


BODIES.update({name: _report_rows(name) for name in _REPORT_SECTIONS})


BODIES.update(_ref.bodies())


BODIES.update(_serial.bodies())

# --- 2.1 sources ------------------------------------------------------------------------
BODIES.update({f"airline_tables_{t}": f"select * from {t}" for t in TABLE_SCHEMAS})


def oracle_sql() -> dict[str, str]:
    return {k: with_prefix(v) for k, v in BODIES.items()}
