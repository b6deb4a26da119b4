"""Derive the twelve airline tables (and request batches) from the TPC-H-like
test tables, with the DataFrame API.

Same rows as the SQL text in ``oracles/fixture_sql.py`` (checked in tests), but planned
for scale:

* nation/region-derived dimensions (airports, fare_classes) have a fixed size
  (25 and 5 rows); everything derived from part, supplier, customer, orders or
  lineitem grows with the data. All joins are left to the planner (broadcast
  below its byte threshold or by AQE from runtime sizes, sort-merge at scale).
* ``seat_idx`` (the order of a booking within its flight) only matters up to
  the largest aircraft (``MAX_SEATS``): the window is filtered with
  ``row_number() <= MAX_SEATS`` so Spark inserts a partial WindowGroupLimit
  before the shuffle, and a hot flight ships at most MAX_SEATS rows per map
  partition instead of all of its orders.
* the seat rows of a flight are generated from ``sequence(1, capacity)`` (no theta
  join), after its bookings were joined to the flight: no seat row is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


# --- fixed values of the fixture mapping (FIXTURES.md) ----------------------
EPOCH = "2024-01-01 00:00:00"
# the largest seat_capacity of aircraft() below
MAX_SEATS = 60
FARE_CLASS_NAMES = ("Economy", "Economy Plus", "Premium", "Business", "First")
# --- end of fixed values -----------------------------------------------------

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def read_raw(spark, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in RAW_TABLES}


def _epoch() -> Column:
    return F.to_timestamp_ntz(F.lit(EPOCH))


def _hours(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), n.cast("int"))


def _minutes(n: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(n))


def _hour_floor(ts: Column) -> Column:
    """Truncate a timestamp_ntz to the hour with NTZ arithmetic only
    (``date_trunc`` returns a zoned timestamp and would pass through the
    session time zone)."""
    epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    micros = F.timestamp_diff("MICROSECOND", epoch, ts)
    return F.timestamp_add("MICROSECOND", micros - F.pmod(micros, F.lit(3_600_000_000)), epoch)


def _pad(c: Column, width: int) -> Column:
    return F.lpad(c.cast("string"), width, "0")


def _n_parts(raw) -> Column:
    return raw["part"].select(F.count(F.lit(1))).scalar()


def _n_suppliers(raw) -> Column:
    # scalar subquery: stays inside the plan, no driver round trip
    return raw["supplier"].select(F.count(F.lit(1))).scalar()


def airports(raw) -> DataFrame:
    n, r = raw["nation"], raw["region"]
    k = F.col("n_nationkey")
    return (n.join(r, n.n_regionkey == r.r_regionkey)
            .select(k.cast("bigint").alias("airport_id"),
                    F.concat(F.lit("Airport "), F.col("n_name")).alias("airport_name"),
                    F.concat(F.lit("AA"), F.char(F.lit(65) + k)).alias("iata_code"),
                    F.col("n_name").alias("city"), F.col("r_name").alias("country"),
                    (F.lit(1) + k % 4).cast("int").alias("terminals"),
                    (k % 12 != 11).alias("is_active"),
                    (_epoch() + _hours(k)).alias("created_at")))


def aircraft(raw) -> DataFrame:
    k = F.col("s_suppkey")
    return raw["supplier"].select(
        k.cast("bigint").alias("aircraft_id"),
        F.concat(F.lit("REG-"), _pad(k, 6)).alias("registration_no"),
        F.col("s_name").alias("model"),
        (F.lit(20) + F.lit(10) * (k % 5)).cast("int").alias("seat_capacity"),
        F.when(k % 10 == 7, "Maintenance").when(k % 10 == 9, "Retired").otherwise("Active")
        .alias("status"),
        _epoch().alias("created_at"))


def fare_classes(raw) -> DataFrame:
    k = F.col("r_regionkey")
    name = F.when(k == 0, FARE_CLASS_NAMES[0])
    for i, nm in enumerate(FARE_CLASS_NAMES[1:-1], start=1):
        name = name.when(k == i, nm)
    name = name.otherwise(FARE_CLASS_NAMES[-1])
    return raw["region"].select(
        k.cast("bigint").alias("fare_class_id"), name.alias("class_name"),
        (F.lit(1.00).cast("decimal(3,2)") + F.lit(0.5).cast("decimal(2,1)") * k)
        .cast("decimal(4,2)").alias("multiplier"),
        (F.lit(20) + F.lit(5) * k).cast("int").alias("baggage_allowance_kg"),
        F.col("r_name").alias("description"), _epoch().alias("created_at"))


def passengers(raw) -> DataFrame:
    c, n = raw["customer"], raw["nation"]
    k = F.col("c_custkey")
    return (c.join(n.select("n_nationkey", "n_name"),
                   c.c_nationkey == n.n_nationkey)
            .select(k.cast("bigint").alias("passenger_id"), F.col("c_name").alias("full_name"),
                    F.date_add(F.lit("1950-01-01").cast("date"), (k % 18000).cast("int"))
                    .alias("date_of_birth"),
                    F.when(k % 3 == 0, "Male").when(k % 3 == 1, "Female").otherwise("Other")
                    .alias("gender"),
                    F.col("n_name").alias("nationality"),
                    F.concat(F.lit("P"), _pad(k, 8)).alias("passport_no"),
                    F.concat(F.lit("+1"), _pad(k, 9)).alias("phone"),
                    F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))),
                             F.lit("@example.org")).alias("email"),
                    (_epoch() + _hours(k % 500)).alias("created_at")))


def staff(raw) -> DataFrame:
    k = F.col("s_suppkey")
    role = (F.when(k % 5 == 0, "Super_Admin").when(k % 5 == 1, "Operations_Manager")
            .when(k % 5 == 2, "Reservation_Agent").when(k % 5 == 3, "Ground_Staff")
            .otherwise("Finance_Officer"))
    return raw["supplier"].select(
        k.cast("bigint").alias("staff_id"), F.col("s_name").alias("full_name"),
        F.concat(F.lower(F.replace(F.col("s_name"), F.lit("#"), F.lit("."))),
                 F.lit("@example.org")).alias("email"),
        role.alias("role"), (k % 9 != 8).alias("is_active"), _epoch().alias("created_at"))


def flights(raw) -> DataFrame:
    k = F.col("p_partkey")
    status = (F.when(k % 7 == 0, "Scheduled").when(k % 7 == 1, "Boarding")
              .when(k % 7 == 2, "Cancelled").when(k % 7 == 3, "Departed").otherwise("Arrived"))
    return raw["part"].select(
        k.cast("bigint").alias("flight_id"),
        F.concat(F.lit("FL"), _pad(k, 6)).alias("flight_no"),
        (k % 25).cast("bigint").alias("origin_airport_id"),
        ((k + 1 + F.col("p_size") % 24) % 25).cast("bigint").alias("dest_airport_id"),
        (k % _n_suppliers(raw)).cast("bigint").alias("aircraft_id"),
        F.col("p_retailprice").cast("decimal(12,2)").alias("base_fare"),
        status.alias("status"),
        (_epoch() + _hours(k % 500)).alias("created_at"))


def flight_schedules(raw) -> DataFrame:
    e = raw["events"].filter(F.col("event_type") != "click")  # flights without a schedule
    # existence check against part: a semi join, part columns are not needed
    e = e.join(raw["part"].select("p_partkey"), e.event_id == F.col("p_partkey"), "left_semi")
    k = F.col("event_id")
    hour = _hour_floor(F.col("ts"))
    actual = (F.when(F.col("event_type") == "error", F.lit(None))
              .when(F.col("event_type") == "view", hour)
              .when(F.col("event_type") == "signup", hour - _minutes(5))
              .otherwise(F.col("ts")))
    return e.select(
        k.cast("bigint").alias("schedule_id"), k.cast("bigint").alias("flight_id"),
        hour.alias("dep_datetime"), (hour + _hours(F.lit(2))).alias("arr_datetime"),
        actual.cast("timestamp_ntz").alias("actual_dep"),
        F.lit(None).cast("timestamp_ntz").alias("actual_arr"),
        F.concat(F.lit("T"), (F.lit(1) + k % 4).cast("string")).alias("terminal"),
        F.when(k % 6 != 0, F.concat(F.lit("G"), (k % 30).cast("string"))).alias("gate"),
        _epoch().alias("created_at"))


def _charges(raw) -> DataFrame:
    return (raw["lineitem"].groupBy("l_orderkey")
            .agg(F.min("l_partkey").alias("flight_id"),
                 F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).cast("decimal(12,2)")
                 .alias("amount")))


def bookings_wide(raw, flights_df: DataFrame, aircraft_df: DataFrame) -> DataFrame:
    """Bookings with the helper columns amount, o_orderstatus and seat_idx."""
    o = raw["orders"].select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate",
                             "o_orderstatus")
    b0 = o.join(_charges(raw), o.o_orderkey == F.col("l_orderkey"))
    k = F.col("o_orderkey")
    status = (F.when(F.col("o_orderpriority") == "5-LOW", "Cancelled")
              .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "Pending")
              .otherwise("Confirmed"))
    b0 = b0.select(k.alias("booking_id"), F.col("o_custkey").alias("passenger_id"), "flight_id",
                   (F.col("o_custkey") % _n_suppliers(raw)).alias("staff_id"),
                   status.alias("status"),
                   (F.col("o_orderdate") + _hours(k % 24)).alias("booked_at"),
                   "amount", "o_orderstatus")
    w = Window.partitionBy("flight_id").orderBy("booking_id")
    first = (b0.select("booking_id", "flight_id").withColumn("seat_idx", F.row_number().over(w).cast("bigint"))
             .filter(F.col("seat_idx") <= MAX_SEATS))
    cap = (flights_df.select("flight_id", "aircraft_id")
           .join(aircraft_df.select("aircraft_id", "seat_capacity"), "aircraft_id")
           .select("flight_id", "seat_capacity"))
    seated = (first.join(cap, "flight_id").filter(F.col("seat_idx") <= F.col("seat_capacity"))
              .select("booking_id", "seat_idx"))
    # orders beyond the capacity are cancelled bookings of a seat that another holds;
    # the orders still lie by their key here, so that only the seats found are dealt by it
    b = b0.join(seated, "booking_id", "left").join(cap, "flight_id")
    over = F.col("seat_idx").isNull()
    b = b.withColumn("status", F.when(over, "Cancelled").otherwise(F.col("status"))).withColumn(
        "seat_idx", F.when(over, F.lit(1) + F.col("booking_id") % F.col("seat_capacity"))
        .otherwise(F.col("seat_idx")))
    cancelled = F.col("status") == "Cancelled"
    return b.select(
        F.col("booking_id").cast("bigint").alias("booking_id"),
        F.col("passenger_id").cast("bigint").alias("passenger_id"),
        F.col("flight_id").cast("bigint").alias("flight_id"),
        (F.col("flight_id") * 100 + F.col("seat_idx")).cast("bigint").alias("seat_id"),
        F.col("staff_id").cast("bigint").alias("staff_id"),
        F.concat(F.lit("PNR"), _pad(F.col("booking_id"), 8)).alias("pnr"),
        "status",
        F.when(cancelled, F.lit("changed plans")).alias("cancel_reason"),
        F.when(cancelled, F.col("booked_at") + _hours(F.lit(12))).alias("cancelled_at"),
        "booked_at", "amount", "o_orderstatus", "seat_idx")


BOOKINGS_WIDE_SCHEMA = T.StructType([
    T.StructField("booking_id", T.LongType()), T.StructField("passenger_id", T.LongType()),
    T.StructField("flight_id", T.LongType()), T.StructField("seat_id", T.LongType()),
    T.StructField("staff_id", T.LongType()), T.StructField("pnr", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("cancel_reason", T.StringType()),
    T.StructField("cancelled_at", T.TimestampNTZType()), T.StructField("booked_at", T.TimestampNTZType()),
    T.StructField("amount", T.DecimalType(12, 2)), T.StructField("o_orderstatus", T.StringType()),
    T.StructField("seat_idx", T.LongType()),
])

BOOKING_COLUMNS = ("booking_id", "passenger_id", "flight_id", "seat_id", "staff_id", "pnr",
                   "status", "cancel_reason", "cancelled_at", "booked_at")


def boarding_records(bw: DataFrame, flights_df: DataFrame) -> DataFrame:
    open_flights = (flights_df.filter(F.col("status").isin("Boarding", "Departed", "Arrived"))
                    .select("flight_id"))
    # orders still open are not boarded yet
    b = (bw.filter((F.col("status") == "Confirmed") & (F.col("o_orderstatus") != "O"))
         .join(open_flights, "flight_id", "left_semi"))
    return b.select(
        F.col("booking_id").alias("boarding_id"), "booking_id", "passenger_id", "flight_id",
        F.when(F.col("booking_id") % 8 == 0, "No_Show").otherwise("Boarded").alias("status"),
        (F.col("booked_at") + _hours(F.lit(24))).alias("boarded_at"))


def seats(raw, flights_df, aircraft_df, bw, boarding_df) -> DataFrame:
    cap = F.col("seat_capacity")
    fa = (flights_df.select("flight_id", "aircraft_id")
          .join(aircraft_df.select("aircraft_id", "seat_capacity"), "aircraft_id"))
    live = (bw.filter(F.col("status") != "Cancelled")
            .select("flight_id", F.col("seat_idx").alias("n"), "booking_id"))
    br = boarding_df.select("booking_id", F.col("status").alias("br_status"))
    # bookings meet their flight before its seats are laid out: the seats themselves,
    # most of them without a booking, cross no shuffle
    taken = (live.join(br, "booking_id", "left").groupBy("flight_id")
             .agg(F.collect_list(F.struct("n", "booking_id", "br_status")).alias("taken")))
    held = F.coalesce("taken", F.array().cast(taken.schema["taken"].dataType))
    row = taken.schema["taken"].dataType.elementType.simpleString()
    every = F.when(cap >= 1, F.sequence(F.lit(1), cap)).otherwise(F.array().cast("array<int>")).cast("array<bigint>")
    # ``taken``: what is booked, once a booking; then the seats that nobody booked
    free = F.transform(F.array_except(every, F.transform(held, lambda x: x["n"])), lambda k: F.struct(
        k.alias("n"), F.lit(None).cast("bigint").alias("booking_id"), F.lit(None).cast("string").alias("br_status")).cast(row))
    s = (fa.repartition("flight_id").join(taken, "flight_id", "left")
         .select("flight_id", F.inline(F.concat(F.filter(held, lambda x: F.array_contains(every, x["n"])), free))))
    n = F.col("n")
    fc = (F.when(n <= 2, 4).when(n <= 4, 3).when(n <= 8, 2).when(n <= 12, 1).otherwise(0))
    status = (F.when(F.col("br_status") == "Boarded", "Occupied")
              .when(F.col("booking_id").isNotNull(), "Reserved").otherwise("Available"))
    return s.select(
        (F.col("flight_id") * 100 + n).cast("bigint").alias("seat_id"), "flight_id",
        fc.cast("bigint").alias("fare_class_id"),
        F.concat(_pad(n, 3), F.lit("A")).alias("seat_number"),
        status.alias("status"), _epoch().alias("created_at"))


def payments(bw: DataFrame) -> DataFrame:
    st, k = F.col("status"), F.col("booking_id")
    p = bw.filter((st == "Confirmed") | ((st == "Cancelled") & (F.col("o_orderstatus") != "P")))
    pay_ts = F.col("booked_at") + _minutes(30)
    return p.select(
        k.alias("payment_id"), "booking_id",
        F.when(k % 3 == 0, "Cash").when(k % 3 == 1, "Card").otherwise("Bank_Transfer")
        .alias("method"),
        "amount",
        F.when(st == "Cancelled", "Refunded").when(k % 50 == 0, "Pending").otherwise("Completed")
        .alias("status"),
        F.when(st == "Cancelled", F.col("amount")).otherwise(F.lit(0).cast("decimal(12,2)"))
        .alias("refund_amount"),
        pay_ts.alias("payment_date"), pay_ts.alias("updated_at"))


def tickets(payments_df, bw, flights_df, seats_df, fare_df) -> DataFrame:
    p = payments_df.filter(F.col("status") != "Pending").select("booking_id", "payment_date")
    b = bw.select("booking_id", "flight_id", "seat_id", F.col("status").alias("b_status"))
    t = (p.join(b, "booking_id")
         .join(flights_df.select("flight_id", "base_fare"), "flight_id")
         .join(seats_df.select("seat_id", "fare_class_id"), "seat_id")
         .join(fare_df.select("fare_class_id", "multiplier"),
               "fare_class_id"))
    return t.select(
        F.col("booking_id").alias("ticket_id"), "booking_id", "fare_class_id",
        F.concat(F.lit("TKT-"), _pad(F.col("booking_id"), 8)).alias("ticket_no"),
        "base_fare", F.col("multiplier").alias("multiplier_snapshot"),
        (F.col("base_fare") * F.col("multiplier")).cast("decimal(12,2)").alias("final_fare"),
        F.col("payment_date").alias("issue_date"),
        (F.col("b_status") == "Cancelled").alias("is_cancelled"))


def table_builders(raw, get: Callable[[str], DataFrame]) -> dict[str, Callable[[], DataFrame]]:
    """How each of the twelve tables and the wide bookings (``_bookings_wide``) are derived.

    ``get(name)`` gives a table that another one is built from (e.g. its written copy)."""
    return {
        "passengers": lambda: passengers(raw), "airports": lambda: airports(raw), "aircraft": lambda: aircraft(raw),
        "fare_classes": lambda: fare_classes(raw), "staff": lambda: staff(raw), "flights": lambda: flights(raw),
        "flight_schedules": lambda: flight_schedules(raw),
        "_bookings_wide": lambda: bookings_wide(raw, get("flights"), get("aircraft")),
        "bookings": lambda: get("_bookings_wide").select(*BOOKING_COLUMNS),
        "boarding_records": lambda: boarding_records(get("_bookings_wide"), get("flights")),
        "seats": lambda: seats(raw, get("flights"), get("aircraft"), get("_bookings_wide"), get("boarding_records")),
        "payments": lambda: payments(get("_bookings_wide")),
        "tickets": lambda: tickets(get("payments"), get("_bookings_wide"), get("flights"), get("seats"),
                                   get("fare_classes")),
    }


# --- request batches (FIXTURES.md "booking_requests" ...) -------------------

def booking_requests(raw) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    flight = F.floor(c / 6) % _n_parts(raw)  # a few customers ask for the same flight and seats
    return raw["orders"].select(
        k.alias("request_id"),
        F.when(k % 40 == 0, F.lit(-1).cast("bigint")).otherwise(c).alias("passenger_id"),
        F.when(k % 45 == 0, F.lit(-1).cast("bigint")).otherwise(flight).alias("flight_id"),
        (flight * 100 + 1 + F.floor(c / 2) % 20).cast("bigint").alias("seat_id"),
        (c % _n_suppliers(raw)).alias("staff_id"),
        F.col("o_orderdate").alias("requested_at"))


def cancel_requests(bw: DataFrame) -> DataFrame:
    k = F.col("booking_id")
    return bw.select(
        (k + 1000000).alias("request_id"), "booking_id",
        F.when(k % 22 == 0, F.lit(None).cast("string")).otherwise(F.lit("schedule change"))
        .alias("cancel_reason"),
        (F.col("booked_at") + _hours(F.lit(48))).alias("requested_at"))


def payment_requests(bw: DataFrame) -> DataFrame:
    k = F.col("booking_id")
    return bw.select(
        (k + 2000000).alias("request_id"), "booking_id", F.lit("Card").alias("method"),
        F.when(k % 35 == 0, F.lit(0).cast("decimal(12,2)")).otherwise(F.col("amount"))
        .alias("amount"),
        (F.col("booked_at") + _hours(F.lit(1))).alias("requested_at"))


def boarding_events(bw: DataFrame) -> DataFrame:
    k = F.col("booking_id")
    a = bw.select(
        (k * 2).alias("event_id"), "booking_id", F.lit("Boarded").alias("status"),
        (F.col("booked_at") + _hours(F.lit(30))).alias("event_ts"))
    b = bw.filter(F.col("o_orderstatus") == "F").select(
        (k * 2 + 1).alias("event_id"), "booking_id", F.lit("No_Show").alias("status"),
        (F.col("booked_at") + _hours(F.lit(31))).alias("event_ts"))
    return a.unionByName(b)


def passenger_requests(raw) -> DataFrame:
    """Registration requests, one per customer, with planted conflicts (not in
    FIXTURES.md; the reservation system has no seed data for it): every 13th
    reuses an existing passport, every 11th the passport of the previous
    request, every 7th the e-mail of the request two before, every 19th has a
    malformed e-mail and every 17th an unknown gender."""
    c, n = raw["customer"], raw["nation"]
    k = F.col("c_custkey")
    pp = (F.when(k % 13 == 0, F.concat(F.lit("P"), _pad(k, 8)))
          .when(k % 11 == 0, F.concat(F.lit("N"), _pad(k - 1, 8)))
          .otherwise(F.concat(F.lit("N"), _pad(k, 8))))
    em = (F.when(k % 19 == 0, F.lit("bad-email"))
          .when(k % 7 == 0, F.concat(F.lit("new."), (k - 2).cast("string"), F.lit("@example.com")))
          .otherwise(F.concat(F.lit("new."), k.cast("string"), F.lit("@example.com"))))
    gender = (F.when(k % 17 == 0, "Unknown").when(k % 3 == 0, "Male").when(k % 3 == 1, "Female")
              .otherwise("Other"))
    return (c.join(n.select("n_nationkey", "n_name"),
                   c.c_nationkey == n.n_nationkey)
            .select((k + 3000000).alias("request_id"),
                    (F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00"))
                     + F.make_dt_interval(F.lit(0), F.lit(0), (k % 100000).cast("int")))
                    .alias("requested_at"),
                    F.concat(F.lit("New "), F.col("c_name")).alias("full_name"),
                    F.date_add(F.lit("1960-01-01").cast("date"), (k % 9000).cast("int"))
                    .alias("date_of_birth"),
                    gender.alias("gender"), F.col("n_name").alias("nationality"),
                    pp.alias("passport_no"),
                    F.concat(F.lit("+2"), _pad(k, 9)).alias("phone"), em.alias("email")))


def passenger_update_requests(raw) -> DataFrame:
    """Passenger updates, one per customer, with e-mail moves that depend on
    order: every 5th takes the e-mail of the next customer (free only if that
    one moved away earlier), every 5th (+1) moves to a fresh address, every
    7th is for an unknown passenger, every 13th has a malformed e-mail, every
    17th an unknown gender, every 19th an explicit NULL name."""
    c = raw["customer"]
    k = F.col("c_custkey")
    email_of = lambda n: F.concat(F.lower(F.concat(F.lit("customer."), F.lpad(n.cast("string"), 9, "0"))),
                                  F.lit("@example.org"))
    fields = (F.when(k % 19 == 0, F.array(F.lit("full_name")))
              .when(k % 5 == 0, F.array(F.lit("email"), F.lit("phone")))
              .when(k % 5 == 1, F.array(F.lit("email")))
              .when(k % 17 == 0, F.array(F.lit("gender")))
              .otherwise(F.array(F.lit("nationality"), F.lit("gender"))))
    email = (F.when(k % 13 == 0, F.lit("broken@"))
             .when(k % 5 == 0, email_of(k + 1))
             .otherwise(F.concat(F.lit("moved."), k.cast("string"), F.lit("@example.org"))))
    gender = F.when(k % 17 == 0, F.lit("Robot")).otherwise(F.lit("Other"))
    minute = (k * 37) % 1000
    return c.select(
        (k + 7000000).alias("request_id"),
        (F.to_timestamp_ntz(F.lit("2024-04-01 00:00:00"))
         + F.make_dt_interval(F.lit(0), F.lit(0), minute.cast("int"))).alias("requested_at"),
        F.when(k % 7 == 0, k + 1000000).otherwise(k).cast("bigint").alias("passenger_id"),
        fields.alias("set_fields"),
        F.when(k % 19 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("Upd "), F.col("c_name")))
        .alias("full_name"),
        F.lit(None).cast("date").alias("date_of_birth"), gender.alias("gender"),
        F.lit("Atlantis").alias("nationality"), F.lit("+3000").alias("phone"), email.alias("email"))


def command_log(raw, bw: DataFrame) -> DataFrame:
    """A mixed log: every order asks for a booking, and every booking is paid,
    boarded and cancelled at some time; bookings that the log itself makes are
    paid (two of three), boarded (half) and cancelled (a third) as well, some
    before they are made."""
    wanted = booking_requests(raw)
    k = F.col("request_id")
    no = {"booking_id": "bigint", "booking_request_id": "bigint", "passenger_id": "bigint", "flight_id": "bigint",
          "seat_id": "bigint", "staff_id": "bigint", "method": "string", "amount": "decimal(12,2)",
          "cancel_reason": "string", "boarding_status": "string"}

    def rows(df: DataFrame, tag: int, command: str, at, **given) -> DataFrame:
        cols = [F.lit(given[c]).alias(c) if isinstance(given.get(c), str) else
                given[c].alias(c) if c in given else F.lit(None).cast(no[c]).alias(c) for c in no]
        return df.select((F.col("_k") * 16 + tag).alias("request_id"), at.alias("requested_at"), F.lit(command).alias("command"), *cols)

    new = wanted.withColumn("_k", k)
    made = {"booking_request_id": k * 16}
    old = bw.withColumn("_k", F.col("booking_id"))
    own = {"booking_id": F.col("booking_id")}
    at, booked = F.col("requested_at"), F.col("booked_at")
    price = F.when(k % 35 == 0, F.lit(0)).otherwise(F.lit(250)).cast("decimal(12,2)")
    parts = [
        rows(new, 0, "book", at, **{c: F.col(c) for c in ("passenger_id", "flight_id", "seat_id", "staff_id")}),
        rows(new.where(k % 3 != 0), 1, "pay", at + _hours(F.when(k % 10 == 1, -1).otherwise(1)), method="Card", amount=price, **made),
        rows(new.where(k % 2 == 0), 2, "board", at + _hours(F.lit(30)), boarding_status="Boarded", **made),
        rows(new.where(k % 3 == 1), 3, "cancel", at + _hours(F.when(k % 4 == 0, 20).otherwise(72)), cancel_reason="ill", **made),
        rows(old, 4, "pay", booked + _hours(F.lit(1)), method="Cash", amount=F.col("amount"), **own),
        rows(old, 5, "board", booked + _hours(F.lit(30)), boarding_status="Boarded", **own),
        rows(old.where(F.col("o_orderstatus") == "F"), 6, "board", booked + _hours(F.lit(31)), boarding_status="No_Show", **own),
        rows(old, 7, "cancel", booked + _hours(F.lit(48)),
             cancel_reason=F.when(F.col("_k") % 22 != 0, F.lit("schedule change")), **own),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
