"""Request batches for the reference-data commands, derived from the test
tables (the reservation system ships no seed data). One request per row of
the source table, with planted conflicts: duplicate keys inside the batch,
keys that already exist, unknown references, constraint breaks, texts longer
than their columns, fares out of range and e-mail domains in upper case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_TS = "2024-03-01 00:00:00"


def _ts(k: Column) -> Column:
    return (F.to_timestamp_ntz(F.lit(BASE_TS))
            + F.make_dt_interval(F.lit(0), F.lit(0), (k % 100000).cast("int")))


def _letter(n: Column) -> Column:
    return F.char(F.lit(65) + n % 26)


def _of(raw, table: str, times: int = 1, over: int = 1, more: int = 0) -> Column:
    """``times / over`` of the rows of a raw table, and ``more``: the range that the keys
    of a batch are drawn from, so that they grow with the tables they refer to."""
    n = raw[table].select(F.count(F.lit(1))).scalar()
    return F.greatest((n * times / over).cast("bigint") + more, F.lit(1))


def _padding(cond: Column, n: int) -> Column:
    """A planted text that is too long: ``n`` further characters."""
    return F.when(cond, F.lit("x" * n)).otherwise(F.lit(""))


def _fare(cond: Column) -> Column:
    """The customer's balance as a fare, or a planted one beyond the column's range."""
    return F.when(cond, F.lit("99999999999.99").cast("decimal(13,2)")).otherwise(
        F.col("c_acctbal").cast("decimal(12,2)"))


def airport_create_requests(raw) -> DataFrame:
    s = raw["supplier"]
    k = F.col("s_suppkey")
    code = (F.when(k % 10 == 0, F.lower(F.concat(F.lit("aa"), _letter(k % 25))))
            .when(k % 15 == 1, F.lit("A1B"))
            .when(k % 9 == 0, F.concat(_letter(k - 1), _letter(F.floor((k - 1) / 26)), F.lit("Z")))
            .otherwise(F.concat(F.lit(" "), _letter(k), _letter(F.floor(k / 26)), F.lit("Z "))))
    return s.select((k + 4000000).alias("request_id"), _ts(k).alias("requested_at"),
                    F.concat(F.lit("Airport of "), F.col("s_name"), _padding(k % 18 == 7, 200)).alias("airport_name"),
                    code.alias("iata_code"), F.lit("City").alias("city"),
                    F.lit("Country").alias("country"),
                    F.when(k % 12 == 5, F.lit(0)).otherwise((k % 3 + 1).cast("int"))
                    .alias("terminals"))


def airport_update_requests(raw) -> DataFrame:
    k = F.col("s_suppkey")
    fields = (F.when(k % 3 == 0, F.array(F.lit("city")))
              .when(k % 3 == 1, F.array(F.lit("terminals"), F.lit("is_active")))
              .otherwise(F.array(F.lit("airport_name"), F.lit("country"))))
    return raw["supplier"].select(
        (k + 4100000).alias("request_id"), _ts(k).alias("requested_at"),
        (k % 30).cast("bigint").alias("airport_id"), fields.alias("set_fields"),
        F.concat(F.lit("Renamed "), F.col("s_name")).alias("airport_name"),
        F.concat(F.lit("City "), (k % 7).cast("string"), _padding(k % 21 == 3, 100)).alias("city"),
        F.lit("Country X").alias("country"),
        F.when(k % 20 == 1, F.lit(0)).otherwise((k % 4 + 1).cast("int")).alias("terminals"),
        (k % 2 == 0).alias("is_active"))


def airport_deactivate_requests(raw) -> DataFrame:
    k = F.col("s_suppkey")
    return raw["supplier"].select((k + 4200000).alias("request_id"), _ts(k).alias("requested_at"),
                                  (k % 28).cast("bigint").alias("airport_id"))


def aircraft_create_requests(raw) -> DataFrame:
    k = F.col("p_partkey")
    return raw["part"].select(
        (k + 4300000).alias("request_id"), _ts(k).alias("requested_at"),
        F.concat(F.lit("REG-"), F.lpad((k % _of(raw, "supplier", 3, 2)).cast("string"), 6, "0")).alias("registration_no"),
        F.concat(F.col("p_brand"), _padding(k % 13 == 5, 100)).alias("model"),
        F.when(k % 17 == 3, F.lit(0)).otherwise((20 + k % 50).cast("int")).alias("seat_capacity"),
        F.when(k % 23 == 0, F.lit("Grounded")).when(k % 4 == 0, F.lit("Maintenance"))
        .otherwise(F.lit(None)).alias("status"))


def aircraft_update_requests(raw) -> DataFrame:
    k = F.col("p_partkey")
    fields = (F.when(k % 3 == 0, F.array(F.lit("model")))
              .when(k % 3 == 1, F.array(F.lit("seat_capacity"), F.lit("status")))
              .otherwise(F.array(F.lit("status"))))
    return raw["part"].select(
        (k + 4400000).alias("request_id"), _ts(k).alias("requested_at"),
        (k % _of(raw, "supplier", 6, 5)).cast("bigint").alias("aircraft_id"), fields.alias("set_fields"),
        F.concat(F.col("p_brand"), _padding(k % 21 == 0, 100)).alias("model"),
        F.when(k % 19 == 1, F.lit(0)).otherwise((30 + k % 40).cast("int")).alias("seat_capacity"),
        F.when(k % 29 == 2, F.lit("Flying")).when(k % 2 == 0, F.lit("Active"))
        .otherwise(F.lit("Maintenance")).alias("status"))


def flight_create_requests(raw) -> DataFrame:
    k = F.col("c_custkey")
    fno = (F.when(k % 50 == 0, F.concat(F.lit("FL"), F.lpad(k.cast("string"), 6, "0")))
           .otherwise(F.concat(F.lit("FN"), F.lpad((k % _of(raw, "part", 1, 2)).cast("string"), 6, "0"),
                                _padding(k % 41 == 7, 20))))
    return raw["customer"].select(
        (k + 4500000).alias("request_id"), _ts(k).alias("requested_at"), fno.alias("flight_no"),
        (k % 27).cast("bigint").alias("origin_airport_id"),
        ((k * 7) % 26).cast("bigint").alias("dest_airport_id"),
        (k % _of(raw, "supplier", more=5)).cast("bigint").alias("aircraft_id"), _fare(k % 43 == 8).alias("base_fare"))


def flight_update_requests(raw) -> DataFrame:
    k = F.col("c_custkey")
    fields = (F.when(k % 4 == 0, F.array(F.lit("aircraft_id")))
              .when(k % 4 == 1, F.array(F.lit("base_fare")))
              .when(k % 4 == 2, F.array(F.lit("status"), F.lit("base_fare")))
              .otherwise(F.array(F.lit("status"))))
    return raw["customer"].select(
        (k + 4600000).alias("request_id"), _ts(k).alias("requested_at"),
        (k % _of(raw, "part", more=100)).cast("bigint").alias("flight_id"), fields.alias("set_fields"),
        (k % _of(raw, "supplier", more=10)).cast("bigint").alias("aircraft_id"), _fare(k % 44 == 1).alias("base_fare"),
        F.when(k % 37 == 2, F.lit("Delayed")).when(k % 2 == 0, F.lit("Boarding"))
        .otherwise(F.lit("Departed")).alias("status"))


def schedule_create_requests(raw) -> DataFrame:
    k = F.col("p_partkey")
    dep = F.to_timestamp_ntz(F.lit("2024-05-01 00:00:00")) + F.make_dt_interval(
        F.lit(0), (k % 1000).cast("int"))
    arr = dep + F.make_dt_interval(F.lit(0), (k % 7 - 1).cast("int"))
    fid = F.when(k % 97 == 0, k + 1000000).otherwise(k % _of(raw, "part", 3, 4))
    return raw["part"].select(
        (k + 4700000).alias("request_id"), _ts(k).alias("requested_at"),
        fid.cast("bigint").alias("flight_id"), dep.alias("dep_datetime"), arr.alias("arr_datetime"),
        F.concat(F.lit("T"), (k % 3 + 1).cast("string")).alias("terminal"),
        F.concat(F.lit("G"), (k % 40).cast("string"), _padding(k % 53 == 2, 20)).alias("gate"))


def staff_create_requests(raw) -> DataFrame:
    k = F.col("c_custkey")
    email = (F.when(k % 31 == 0, F.lit("not an email"))
             .when(k % 25 == 0, F.concat(F.lit("supplier."), F.lpad((k % _of(raw, "supplier")).cast("string"), 9, "0"),
                                         F.lit("@example.org")))
             .when(k % 10 == 0, F.concat(F.lit("agent"), (k - 1).cast("string"), F.lit("@Example.COM")))
             .otherwise(F.concat(F.lit("agent"), k.cast("string"), F.lit("@example.com"))))
    role = (F.when(k % 6 == 0, "Super_Admin").when(k % 6 == 1, "Operations_Manager")
            .when(k % 6 == 2, "Reservation_Agent").when(k % 6 == 3, "Ground_Staff")
            .when(k % 6 == 4, "Finance_Officer").otherwise("Pilot"))
    return raw["customer"].select((k + 4800000).alias("request_id"), _ts(k).alias("requested_at"),
                                  F.concat(F.col("c_name"), _padding(k % 47 == 3, 150)).alias("full_name"), email.alias("email"),
                                  role.alias("role"))


def staff_update_requests(raw) -> DataFrame:
    k = F.col("c_custkey")
    fields = (F.when(k % 3 == 0, F.array(F.lit("full_name")))
              .when(k % 3 == 1, F.array(F.lit("role"), F.lit("is_active")))
              .otherwise(F.array(F.lit("is_active"))))
    role = F.when(k % 11 == 1, F.lit("Pilot")).otherwise(F.lit("Ground_Staff"))
    return raw["customer"].select(
        (k + 4900000).alias("request_id"), _ts(k).alias("requested_at"),
        (k % _of(raw, "supplier", more=10)).cast("bigint").alias("staff_id"), fields.alias("set_fields"),
        F.concat(F.lit("Staff "), F.col("c_name"), _padding(k % 51 == 0, 150)).alias("full_name"), role.alias("role"),
        (k % 2 == 0).alias("is_active"))


BUILDERS = {
    "airport_create_requests": airport_create_requests,
    "airport_update_requests": airport_update_requests,
    "airport_deactivate_requests": airport_deactivate_requests,
    "aircraft_create_requests": aircraft_create_requests,
    "aircraft_update_requests": aircraft_update_requests,
    "flight_create_requests": flight_create_requests,
    "flight_update_requests": flight_update_requests,
    "schedule_create_requests": schedule_create_requests,
    "staff_create_requests": staff_create_requests,
    "staff_update_requests": staff_update_requests,
}


def passenger_delete_requests(raw) -> DataFrame:
    """One delete per customer: every 7th targets the previous customer (a
    second delete of one passenger), every 13th an unknown id; customers
    with orders hold bookings (409)."""
    k = F.col("c_custkey")
    pid = F.when(k % 13 == 0, k + 1000000).when(k % 7 == 0, k - 1).otherwise(k)
    return raw["customer"].select((k + 5000000).alias("request_id"), _ts(k).alias("requested_at"),
                                  pid.cast("bigint").alias("passenger_id"))


BUILDERS["passenger_delete_requests"] = passenger_delete_requests


def schedule_update_requests(raw) -> DataFrame:
    """Schedule updates, one per order, on the flights of their customers, so that
    each is checked against the row left by the earlier ones (a departure moved
    past the arrival, then fixed); every 17th goes to one hot flight, every 11th targets a flight without a schedule,
    every 23rd sets an explicit NULL arrival."""
    k = F.col("o_orderkey")
    base = F.to_timestamp_ntz(F.lit("2024-06-01 00:00:00"))
    fields = (F.when(k % 23 == 0, F.array(F.lit("arr_datetime")))
              .when(k % 4 == 0, F.array(F.lit("dep_datetime")))
              .when(k % 4 == 1, F.array(F.lit("arr_datetime")))
              .when(k % 4 == 2, F.array(F.lit("dep_datetime"), F.lit("arr_datetime"), F.lit("gate")))
              .otherwise(F.array(F.lit("gate"), F.lit("actual_dep"))))
    dep = base + F.make_dt_interval(F.lit(0), (k % 48).cast("int"))
    arr = F.when(k % 23 == 0, F.lit(None).cast("timestamp_ntz")).otherwise(
        base + F.make_dt_interval(F.lit(0), (k % 50 - 2).cast("int")))
    return raw["orders"].select(
        (k + 6000000).alias("request_id"), _ts(k).alias("requested_at"),
        F.when(k % 11 == 0, F.lit(0)).when(k % 17 == 5, F.lit(1))
        .otherwise(F.col("o_custkey") % _of(raw, "part") + 1).cast("bigint")
        .alias("flight_id"),
        fields.alias("set_fields"), dep.alias("dep_datetime"), arr.alias("arr_datetime"),
        F.lit(None).cast("timestamp_ntz").alias("actual_dep"),
        F.lit(None).cast("timestamp_ntz").alias("actual_arr"),
        F.lit(None).cast("string").alias("terminal"),
        F.concat(F.lit("G"), (k % 9).cast("string"), _padding(k % 58 == 6, 20)).alias("gate"))


BUILDERS["schedule_update_requests"] = schedule_update_requests
