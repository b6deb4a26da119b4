"""DuckDB oracle for the reference-data command batches and their request
fixtures (``airops/sources/requests.py`` as SQL text).

The serial meaning in SQL: a request is accepted iff it passes every static
check and is the first such request for its unique key (creates); updates
apply accepted requests per row in order, the last one setting a field wins.
"""

from __future__ import annotations

TS = "timestamp '2024-03-01 00:00:00' + interval '1' minute * cast({k} % 100000 as integer)"


def _ts(k: str) -> str:
    return TS.format(k=k)


def _letter(n: str) -> str:
    return f"chr(cast(65 + ({n}) % 26 as integer))"


def _of(table: str, times: int = 1, over: int = 1, more: int = 0) -> str:
    return f"(select greatest(count(*) * {times} // {over} + {more}, 1) from {table})"


def _padding(cond: str, n: int) -> str:
    return f"case when {cond} then repeat('x', {n}) else '' end"


def _fare(cond: str) -> str:
    return f"case when {cond} then cast(99999999999.99 as decimal(13,2)) else cast(c_acctbal as decimal(12,2)) end base_fare"


def _too_long(limits: dict[str, int], row: str = "r", updates: bool = True) -> str:
    """A text longer than its column, of the written fields."""
    return "(" + " or ".join(
        (f"list_contains({row}.set_fields, '{f}') and " if updates else "") + f"coalesce(length({row}.{f}) > {n}, false)"
        for f, n in limits.items()) + ")"


REQUESTS = {
    "airport_create_requests": f"""
select s_suppkey + 4000000 request_id, {_ts('s_suppkey')} requested_at, 'Airport of ' || s_name || {_padding('s_suppkey % 18 = 7', 200)} airport_name,
 case when s_suppkey % 10 = 0 then lower('aa' || {_letter('s_suppkey % 25')})
      when s_suppkey % 15 = 1 then 'A1B'
      when s_suppkey % 9 = 0 then {_letter('s_suppkey - 1')} || {_letter('cast(floor((s_suppkey - 1) / 26) as bigint)')} || 'Z'
      else ' ' || {_letter('s_suppkey')} || {_letter('cast(floor(s_suppkey / 26) as bigint)')} || 'Z ' end iata_code,
 'City' city, 'Country' country,
 case when s_suppkey % 12 = 5 then 0 else cast(s_suppkey % 3 + 1 as integer) end terminals
from supplier""",
    "airport_update_requests": f"""
select s_suppkey + 4100000 request_id, {_ts('s_suppkey')} requested_at, cast(s_suppkey % 30 as bigint) airport_id,
 case when s_suppkey % 3 = 0 then ['city'] when s_suppkey % 3 = 1 then ['terminals', 'is_active']
      else ['airport_name', 'country'] end set_fields,
 'Renamed ' || s_name airport_name, 'City ' || cast(s_suppkey % 7 as varchar) || {_padding('s_suppkey % 21 = 3', 100)} city, 'Country X' country,
 case when s_suppkey % 20 = 1 then 0 else cast(s_suppkey % 4 + 1 as integer) end terminals,
 s_suppkey % 2 = 0 is_active
from supplier""",
    "airport_deactivate_requests": f"""
select s_suppkey + 4200000 request_id, {_ts('s_suppkey')} requested_at, cast(s_suppkey % 28 as bigint) airport_id
from supplier""",
    "aircraft_create_requests": f"""
select p_partkey + 4300000 request_id, {_ts('p_partkey')} requested_at,
 'REG-' || lpad(cast(p_partkey % {_of('supplier', 3, 2)} as varchar), 6, '0') registration_no, p_brand || {_padding('p_partkey % 13 = 5', 100)} model,
 case when p_partkey % 17 = 3 then 0 else cast(20 + p_partkey % 50 as integer) end seat_capacity,
 case when p_partkey % 23 = 0 then 'Grounded' when p_partkey % 4 = 0 then 'Maintenance' end status
from part""",
    "aircraft_update_requests": f"""
select p_partkey + 4400000 request_id, {_ts('p_partkey')} requested_at, cast(p_partkey % {_of('supplier', 6, 5)} as bigint) aircraft_id,
 case when p_partkey % 3 = 0 then ['model'] when p_partkey % 3 = 1 then ['seat_capacity', 'status']
      else ['status'] end set_fields, p_brand || {_padding('p_partkey % 21 = 0', 100)} model,
 case when p_partkey % 19 = 1 then 0 else cast(30 + p_partkey % 40 as integer) end seat_capacity,
 case when p_partkey % 29 = 2 then 'Flying' when p_partkey % 2 = 0 then 'Active' else 'Maintenance' end status
from part""",
    "flight_create_requests": f"""
select c_custkey + 4500000 request_id, {_ts('c_custkey')} requested_at,
 case when c_custkey % 50 = 0 then 'FL' || lpad(cast(c_custkey as varchar), 6, '0')
      else 'FN' || lpad(cast(c_custkey % {_of('part', 1, 2)} as varchar), 6, '0') || {_padding('c_custkey % 41 = 7', 20)} end flight_no,
 cast(c_custkey % 27 as bigint) origin_airport_id, cast((c_custkey * 7) % 26 as bigint) dest_airport_id,
 cast(c_custkey % {_of('supplier', more=5)} as bigint) aircraft_id, {_fare('c_custkey % 43 = 8')}
from customer""",
    "flight_update_requests": f"""
select c_custkey + 4600000 request_id, {_ts('c_custkey')} requested_at, cast(c_custkey % {_of('part', more=100)} as bigint) flight_id,
 case when c_custkey % 4 = 0 then ['aircraft_id'] when c_custkey % 4 = 1 then ['base_fare']
      when c_custkey % 4 = 2 then ['status', 'base_fare'] else ['status'] end set_fields,
 cast(c_custkey % {_of('supplier', more=10)} as bigint) aircraft_id, {_fare('c_custkey % 44 = 1')},
 case when c_custkey % 37 = 2 then 'Delayed' when c_custkey % 2 = 0 then 'Boarding' else 'Departed' end status
from customer""",
    "schedule_create_requests": f"""
select p_partkey + 4700000 request_id, {_ts('p_partkey')} requested_at,
 cast(case when p_partkey % 97 = 0 then p_partkey + 1000000 else p_partkey % {_of('part', 3, 4)} end as bigint) flight_id,
 timestamp '2024-05-01 00:00:00' + interval '1' hour * cast(p_partkey % 1000 as integer) dep_datetime,
 timestamp '2024-05-01 00:00:00' + interval '1' hour * cast(p_partkey % 1000 as integer)
   + interval '1' hour * cast(p_partkey % 7 - 1 as integer) arr_datetime,
 'T' || cast(p_partkey % 3 + 1 as varchar) terminal, 'G' || cast(p_partkey % 40 as varchar) || {_padding('p_partkey % 53 = 2', 20)} gate
from part""",
    "staff_create_requests": f"""
select c_custkey + 4800000 request_id, {_ts('c_custkey')} requested_at, c_name || {_padding('c_custkey % 47 = 3', 150)} full_name,
 case when c_custkey % 31 = 0 then 'not an email'
      when c_custkey % 25 = 0 then 'supplier.' || lpad(cast(c_custkey % {_of('supplier')} as varchar), 9, '0') || '@example.org'
      when c_custkey % 10 = 0 then 'agent' || cast(c_custkey - 1 as varchar) || '@Example.COM'
      else 'agent' || cast(c_custkey as varchar) || '@example.com' end email,
 case c_custkey % 6 when 0 then 'Super_Admin' when 1 then 'Operations_Manager' when 2 then 'Reservation_Agent'
      when 3 then 'Ground_Staff' when 4 then 'Finance_Officer' else 'Pilot' end role
from customer""",
    "passenger_delete_requests": f"""
select c_custkey + 5000000 request_id, {_ts('c_custkey')} requested_at,
 cast(case when c_custkey % 13 = 0 then c_custkey + 1000000 when c_custkey % 7 = 0 then c_custkey - 1
           else c_custkey end as bigint) passenger_id
from customer""",
    "schedule_update_requests": f"""
select o_orderkey + 6000000 request_id, {_ts('o_orderkey')} requested_at,
 cast(case when o_orderkey % 11 = 0 then 0 when o_orderkey % 17 = 5 then 1 else o_custkey % {_of('part')} + 1 end as bigint) flight_id,
 case when o_orderkey % 23 = 0 then ['arr_datetime'] when o_orderkey % 4 = 0 then ['dep_datetime']
      when o_orderkey % 4 = 1 then ['arr_datetime'] when o_orderkey % 4 = 2 then ['dep_datetime', 'arr_datetime', 'gate']
      else ['gate', 'actual_dep'] end set_fields,
 timestamp '2024-06-01 00:00:00' + interval '1' hour * cast(o_orderkey % 48 as integer) dep_datetime,
 case when o_orderkey % 23 = 0 then null else
   timestamp '2024-06-01 00:00:00' + interval '1' hour * cast(o_orderkey % 50 - 2 as integer) end arr_datetime,
 cast(null as timestamp) actual_dep, cast(null as timestamp) actual_arr, cast(null as varchar) terminal,
 'G' || cast(o_orderkey % 9 as varchar) || {_padding('o_orderkey % 58 = 6', 20)} gate
from orders""",
    "staff_update_requests": f"""
select c_custkey + 4900000 request_id, {_ts('c_custkey')} requested_at, cast(c_custkey % {_of('supplier', more=10)} as bigint) staff_id,
 case when c_custkey % 3 = 0 then ['full_name'] when c_custkey % 3 = 1 then ['role', 'is_active']
      else ['is_active'] end set_fields,
 'Staff ' || c_name || {_padding('c_custkey % 51 = 0', 150)} full_name, case when c_custkey % 11 = 1 then 'Pilot' else 'Ground_Staff' end role,
 c_custkey % 2 = 0 is_active
from customer""",
}

OK_REASON = "ok"


def _case(checks: list[tuple[int, str, str]], ok_code: int) -> tuple[str, str]:
    code = "case " + " ".join(f"when coalesce({c}, false) then {k}" for k, _, c in checks) + \
        f" else {ok_code} end"
    reason = "case " + " ".join(f"when coalesce({c}, false) then '{r}'" for _, r, c in checks) + \
        f" else '{OK_REASON}' end"
    return code, reason


def create_outcomes(req: str, joins: str, key: str, checks, dup_at: int, exists: str,
                    prep: str = "r.*") -> tuple[str, str]:
    """(outcomes SQL, accepted-rows SQL) of a keyed create.

    Static conditions are evaluated once (columns c0..cn, ex_) where the
    request and its joins are in scope; the uniqueness check adds "an earlier
    candidate with the same key"."""
    conds = ", ".join(f"coalesce({c}, false) c{i}" for i, (_, _, c) in enumerate(checks))
    static = " or ".join(["ex_"] + [f"c{i}" for i in range(len(checks))])
    base = (f"select q.*, coalesce({exists}, false) ex_, {conds} "
            f"from (select {prep} from ({req}) r) q {joins}")
    cand = f"select z.*, not ({static}) cand from ({base}) z"
    ranked = (f"select b.*, first_value(case when b.cand then b.requested_at end) over w acc_ts, "
              f"first_value(case when b.cand then b.request_id end) over w acc_id from ({cand}) b "
              f"window w as (partition by b.{key} order by case when b.cand then 0 else 1 end, "
              f"b.requested_at, b.request_id rows between unbounded preceding and unbounded following)")
    earlier = "(x.acc_ts < x.requested_at or (x.acc_ts = x.requested_at and x.acc_id < x.request_id))"
    full = [(k, r, f"x.c{i}") for i, (k, r, _) in enumerate(checks)]
    full.insert(dup_at, (409, "already_exists", f"x.ex_ or {earlier}"))
    code, reason = _case(full, 201)
    out = f"select x.*, {code} code, {reason} reason from ({ranked}) x"
    outcomes = f"select request_id, code < 300 accepted, cast(code as integer) code, reason from ({out}) o"
    return outcomes, f"select * from ({out}) o where code < 300"


def update_outcomes(req: str, table: str, pk: str, checks_after_404, db_fail: str,
                    shape_bad: str | None = None, joins: str = "") -> tuple[str, str]:
    found = f"exists (select 1 from {table} t where t.{pk} = r.{pk})"
    checks = ([(422, "invalid_request", shape_bad)] if shape_bad else []) + \
        [(404, "not_found", f"not {found}")] + list(checks_after_404) + \
        [(500, "constraint_violation", db_fail)]
    code, reason = _case(checks, 200)
    out = f"select r.*, {code} code, {reason} reason from ({req}) r {joins}"
    outcomes = f"select request_id, code < 300 accepted, cast(code as integer) code, reason from ({out}) o"
    return outcomes, f"select * from ({out}) o where code < 300"


def applied(table: str, pk: str, accepted_sql: str, fields: list[str], cols: list[str]) -> str:
    """The table after applying accepted updates (last setter per field wins)."""
    sets = []
    for f in fields:
        sets.append(f"""(select a.{f} from ({accepted_sql}) a where a.{pk} = t.{pk} and list_contains(a.set_fields, '{f}')
           order by a.requested_at desc, a.request_id desc limit 1)""")
    exprs = []
    for c in cols:
        if c in fields:
            i = fields.index(c)
            has = (f"exists (select 1 from ({accepted_sql}) a where a.{pk} = t.{pk} "
                   f"and list_contains(a.set_fields, '{c}'))")
            exprs.append(f"case when {has} then {sets[i]} else t.{c} end {c}")
        else:
            exprs.append(f"t.{c}")
    return f"select {', '.join(exprs)} from {table} t"


def bodies() -> dict[str, str]:
    R = REQUESTS
    out: dict[str, str] = {}

    def reg(name, pair, after):
        out[name] = pair[0]
        out[f"{name}_after"] = after

    # airports
    o, acc = create_outcomes(
        R["airport_create_requests"], "", "iata_code",
        [(422, "invalid_request", "not (coalesce(regexp_matches(q.iata_code, '^[A-Z]{3}$'), false) and "
          "q.airport_name is not null and q.city is not null and q.country is not null)"),
         (500, "constraint_violation", f"q.terminals < 1 or {_too_long({'airport_name': 200, 'city': 100, 'country': 100}, 'q', False)}")], 1,
        "exists (select 1 from airports a where a.iata_code = q.iata_code)",
        prep="r.request_id, r.requested_at, r.airport_name, upper(trim(r.iata_code)) iata_code, r.city, "
             "r.country, coalesce(r.terminals, 1) terminals")
    reg("create_airports", (o,), f"""select airport_name, iata_code, city, country, terminals, is_active, created_at from airports
 union all select airport_name, iata_code, city, country, terminals, true, requested_at from ({acc}) n""")
    o, acc = update_outcomes(R["airport_update_requests"], "airports", "airport_id", [],
                             "(list_contains(r.set_fields, 'terminals') and r.terminals < 1) or "
                             + _too_long({"airport_name": 200, "city": 100, "country": 100}))
    reg("update_airports", (o,), applied("airports", "airport_id", acc,
        ["airport_name", "city", "country", "terminals", "is_active"],
        ["airport_id", "airport_name", "city", "country", "terminals", "is_active"]))
    dreq = (f"select request_id, requested_at, airport_id, ['is_active'] set_fields, false is_active "
            f"from ({R['airport_deactivate_requests']}) d")
    o, acc = update_outcomes(dreq, "airports", "airport_id", [], "false")
    reg("deactivate_airports", (o,), applied("airports", "airport_id", acc, ["is_active"],
                                             ["airport_id", "is_active"]))
    # aircraft
    o, acc = create_outcomes(
        R["aircraft_create_requests"], "", "registration_no",
        [(422, "invalid_request", "not (q.registration_no is not null and q.model is not null and "
          "q.seat_capacity is not null and coalesce(q.status in ('Active', 'Maintenance', 'Retired'), false))"),
         (500, "constraint_violation", f"q.seat_capacity <= 0 or {_too_long({'registration_no': 20, 'model': 100}, 'q', False)}")], 1,
        "exists (select 1 from aircraft a where a.registration_no = q.registration_no)",
        prep="r.request_id, r.requested_at, r.registration_no, r.model, r.seat_capacity, "
             "coalesce(r.status, 'Active') status")
    reg("register_aircraft", (o,), f"""select registration_no, model, seat_capacity, status, created_at from aircraft
 union all select registration_no, model, seat_capacity, status, requested_at from ({acc}) n""")
    o, acc = update_outcomes(
        R["aircraft_update_requests"], "aircraft", "aircraft_id", [],
        "(list_contains(r.set_fields, 'seat_capacity') and r.seat_capacity <= 0) or " + _too_long({"model": 100}),
        shape_bad="list_contains(r.set_fields, 'status') and r.status is not null and "
                  "r.status not in ('Active', 'Maintenance', 'Retired')")
    reg("update_aircraft", (o,), applied("aircraft", "aircraft_id", acc,
        ["model", "seat_capacity", "status"], ["aircraft_id", "model", "seat_capacity", "status"]))
    # flights
    o, acc = create_outcomes(
        R["flight_create_requests"],
        "left join aircraft ac on ac.aircraft_id = q.aircraft_id", "flight_no",
        [(422, "invalid_request", "not (q.flight_no is not null and q.origin_airport_id is not null and "
          "q.dest_airport_id is not null and q.aircraft_id is not null and q.base_fare is not null)"),
         (404, "origin_not_found", "not exists (select 1 from airports a where a.airport_id = q.origin_airport_id)"),
         (404, "destination_not_found", "not exists (select 1 from airports a where a.airport_id = q.dest_airport_id)"),
         (422, "same_airports", "q.origin_airport_id = q.dest_airport_id"),
         (404, "aircraft_not_found", "ac.aircraft_id is null"),
         (422, "aircraft_not_active", "ac.status <> 'Active'"),
         (500, "constraint_violation", f"q.base_fare <= 0 or q.base_fare >= 1e10 or {_too_long({'flight_no': 20}, 'q', False)}")], 1,
        "exists (select 1 from flights f where f.flight_no = q.flight_no)")
    reg("create_flights", (o,), f"""select flight_no, origin_airport_id, dest_airport_id, aircraft_id, cast(base_fare as double) base_fare, status, created_at from flights
 union all select flight_no, origin_airport_id, dest_airport_id, aircraft_id, cast(base_fare as double), 'Scheduled', requested_at from ({acc}) n""")
    given_ac = "(list_contains(r.set_fields, 'aircraft_id') and r.aircraft_id is not null and r.aircraft_id <> 0)"
    o, acc = update_outcomes(
        R["flight_update_requests"], "flights", "flight_id",
        [(404, "aircraft_not_found", f"{given_ac} and ac.aircraft_id is null"),
         (422, "aircraft_not_active", f"{given_ac} and ac.status <> 'Active'")],
        "(list_contains(r.set_fields, 'base_fare') and (r.base_fare <= 0 or r.base_fare >= 1e10)) or "
        f"(list_contains(r.set_fields, 'aircraft_id') and not {given_ac} and r.aircraft_id is not null)",
        shape_bad="list_contains(r.set_fields, 'status') and r.status is not null and r.status not in "
                  "('Scheduled', 'Boarding', 'Departed', 'Arrived', 'Cancelled')",
        joins="left join aircraft ac on ac.aircraft_id = r.aircraft_id")
    reg("update_flights", (o,), "select * replace (cast(base_fare as double) as base_fare) from (" + applied(
        "flights", "flight_id", acc, ["aircraft_id", "base_fare", "status"],
        ["flight_id", "aircraft_id", "base_fare", "status"]) + ") u")
    # schedules
    o, acc = create_outcomes(
        R["schedule_create_requests"], "", "flight_id",
        [(422, "arrival_not_after_departure", "not (q.dep_datetime is not null and q.arr_datetime is not null "
          "and q.arr_datetime > q.dep_datetime)"),
         (404, "not_found", "not exists (select 1 from flights f where f.flight_id = q.flight_id)"),
         (500, "constraint_violation", _too_long({"terminal": 20, "gate": 20}, "q", False))], 2,
        "exists (select 1 from flight_schedules s where s.flight_id = q.flight_id)")
    reg("create_schedules", (o,), f"""select flight_id, dep_datetime, arr_datetime, terminal, gate, created_at from flight_schedules
 union all select flight_id, dep_datetime, arr_datetime, terminal, gate, requested_at from ({acc}) n""")
    # staff
    o, acc = create_outcomes(
        R["staff_create_requests"], "", "email",
        [(422, "invalid_request", "not (q.full_name is not null and "
          "coalesce(regexp_matches(q.email, '^[^@ ]+@[^@ ]+[.][^@ ]+$'), false) and coalesce(q.role in "
          "('Super_Admin', 'Operations_Manager', 'Reservation_Agent', 'Ground_Staff', 'Finance_Officer'), false))"),
         (500, "constraint_violation", _too_long({"full_name": 150, "email": 150}, "q", False))],
        1, "exists (select 1 from staff s where s.email = q.email)",
        prep="r.* replace (case when contains(r.email, '@') then regexp_extract(r.email, '^(.*@)', 1) || "
             "lower(regexp_extract(r.email, '([^@]*)$', 1)) else r.email end as email)")
    reg("create_staff", (o,), f"""select full_name, email, role, is_active, created_at from staff
 union all select full_name, email, role, true, requested_at from ({acc}) n""")
    o, acc = update_outcomes(
        R["staff_update_requests"], "staff", "staff_id", [], _too_long({"full_name": 150}),
        shape_bad="list_contains(r.set_fields, 'role') and r.role is not null and r.role not in "
                  "('Super_Admin', 'Operations_Manager', 'Reservation_Agent', 'Ground_Staff', 'Finance_Officer')")
    reg("update_staff", (o,), applied("staff", "staff_id", acc, ["full_name", "role", "is_active"],
                                      ["staff_id", "full_name", "role", "is_active"]))
    # schedule updates: a recursive walk per schedule (the serial meaning, literally)
    sreq = R["schedule_update_requests"]
    nd = "(case when list_contains(q.set_fields, 'dep_datetime') then q.dep_datetime else w.dep end)"
    na = "(case when list_contains(q.set_fields, 'arr_datetime') then q.arr_datetime else w.arr end)"
    ok = f"({nd} is not null and {na} is not null and {na} > {nd})"
    long = _too_long({"terminal": 20, "gate": 20}, "q")
    fits = f"({ok} and not {long})"
    walk = f"""
with recursive q as (
  select r.*, s.dep_datetime dep0, s.arr_datetime arr0,
   row_number() over (partition by r.flight_id order by r.requested_at, r.request_id) rn
  from ({sreq}) r join flight_schedules s on s.flight_id = r.flight_id),
 w(flight_id, rn, dep, arr, request_id, valid, nullerr) as (
  select distinct flight_id, cast(0 as bigint), dep0, arr0, cast(null as bigint), cast(null as boolean),
   cast(null as boolean) from q
  union all
  select w.flight_id, q.rn, case when {fits} then {nd} else w.dep end,
   case when {fits} then {na} else w.arr end, q.request_id, {ok}, {nd} is null or {na} is null
  from w join q on q.flight_id = w.flight_id and q.rn = w.rn + 1
 )
select request_id, valid, nullerr from w where rn > 0"""
    scodes = f"""
select r.*, case when not exists (select 1 from flight_schedules s where s.flight_id = r.flight_id) then 404
 when v.nullerr then 500 when not v.valid then 422
 when {_too_long({'terminal': 20, 'gate': 20})} then 500 else 200 end code
from ({sreq}) r left join ({walk}) v on v.request_id = r.request_id"""
    out["update_schedules"] = f"""
select request_id, code < 300 accepted, cast(code as integer) code,
 case code when 404 then 'not_found' when 500 then 'constraint_violation'
      when 422 then 'arrival_not_after_departure' else 'ok' end reason
from ({scodes}) c"""
    out["update_schedules_after"] = applied(
        "flight_schedules", "flight_id", f"select * from ({scodes}) c where code = 200",
        ["dep_datetime", "arr_datetime", "actual_dep", "actual_arr", "terminal", "gate"],
        ["flight_id", "dep_datetime", "arr_datetime", "actual_dep", "gate"])

    # passenger deletes
    dq = f"""
select d.*, exists (select 1 from passengers p where p.passenger_id = d.passenger_id) found_,
 exists (select 1 from bookings b where b.passenger_id = d.passenger_id) used_
from ({R['passenger_delete_requests']}) d"""
    ranked = f"""
select z.*, first_value(case when z.found_ and not z.used_ then z.requested_at end) over w acc_ts,
 first_value(case when z.found_ and not z.used_ then z.request_id end) over w acc_id
from ({dq}) z
window w as (partition by z.passenger_id order by case when z.found_ and not z.used_ then 0 else 1 end,
             z.requested_at, z.request_id rows between unbounded preceding and unbounded following)"""
    codes = f"""
select x.*, case when not x.found_ or x.acc_ts < x.requested_at
      or (x.acc_ts = x.requested_at and x.acc_id < x.request_id) then 404
 when x.used_ then 409 else 200 end code from ({ranked}) x"""
    out["delete_passengers"] = f"""
select request_id, code < 300 accepted, cast(code as integer) code,
 case code when 404 then 'passenger_not_found' when 409 then 'passenger_has_bookings' else 'ok' end reason
from ({codes}) c"""
    out["delete_passengers_after"] = f"""
select passenger_id, full_name from passengers p
where not exists (select 1 from ({codes}) c where c.code = 200 and c.passenger_id = p.passenger_id)"""
    return out
