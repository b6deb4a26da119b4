"""Searchable, paged listings and bulk lookups.

A page is ``filter -> orderBy(sort key, primary key) -> offset -> limit``;
Spark plans it as a TakeOrderedAndProject (a top-(skip+limit) per partition,
then a merge), so a page never sorts the whole table; a deep page is first
located by counts of ranges of the order, and only its range is sorted, so that
no task holds ``skip`` rows. The sort key of each
listing is not unique; the primary key is added as a tie-break so that pages
are stable. Totals are a separate one-row count over the same filter.

Bulk lookups replace the single-row GET endpoints and their 404s: a DataFrame
of keys is left-joined to the table and each key gets ``found``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airops.functions.predicates import all_of, ilike_any

DEFAULT_LIMIT, MAX_LIMIT = 50, 200  # fixed values: page size default and cap
#: Rows that one task may hold for a page, and bounds of a round that locates a deeper one.
DEEP_ROWS, BOUNDS = 10_000, 31


def _check_page(skip: int, limit: int) -> None:
    if skip < 0 or not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"skip must be >= 0 and limit in 1..{MAX_LIMIT}")


def _order(key: str, pk: str, desc: bool) -> list[Column]:
    return [F.desc(key) if desc else F.asc(key), F.asc(pk)]


def _precedes(df: DataFrame, key: str, pk: str, desc: bool, bound: Row) -> Column:
    """The row comes before ``bound`` (nulls first when rising, last when falling)."""
    k = F.col(key)
    if bound[0] is None:
        less, same = k.isNotNull() if desc else F.lit(False), k.isNull()
    else:  # as text and cast back: exact for every type of key
        at = F.lit(bound[0]).cast(df.schema[key].dataType)
        less, same = (k > at) if desc else k.isNull() | (k < at), k == at
    return F.coalesce(less | (same & (F.col(pk) < F.lit(bound[1]))), F.lit(False))


def _near(df: DataFrame, key: str, bound: Row, upper: bool) -> Column:
    """What the key alone tells of a row beyond a bound, for the scan to prune by."""
    if bound[0] is None:
        return F.lit(True)
    k, at = F.col(key), F.lit(bound[0]).cast(df.schema[key].dataType)
    return ((k >= at) if upper else (k <= at)) | k.isNull()


def _located(df: DataFrame, key: str, pk: str, desc: bool, skip: int, limit: int) -> tuple[DataFrame, int]:
    """(the rows of a range of the order that holds the page, how many of them to skip).

    Each round counts, in one aggregate, the rows before each of ``BOUNDS`` rows of
    least key hash, and goes on with the rows between the two around the page, until
    they are few. Rows are read, never sorted or shuffled; the driver sees bounds."""
    part, left, rows = df, skip, None
    while rows is None or rows > DEEP_ROWS:
        sample = part.select(key, pk).orderBy(F.xxhash64(pk), pk).limit(BOUNDS).orderBy(*_order(key, pk, desc))
        bounds = sample.select(F.col(key).cast("string"), pk).collect()
        counts = part.agg(F.count(F.lit(1)), *[F.count_if(_precedes(df, key, pk, desc, b)) for b in bounds]).first()
        every, before = counts[0], list(counts[1:])
        low = max((i for i, n in enumerate(before) if n <= left), default=None)
        high = min((i for i, n in enumerate(before) if n >= left + limit), default=None)
        first, last = before[low] if low is not None else 0, before[high] if high is not None else every
        if last - first == every:  # the bounds cut nothing off
            break
        if low is not None:
            part = part.where(~_precedes(df, key, pk, desc, bounds[low]) & _near(df, key, bounds[low], not desc))
        if high is not None:
            part = part.where(_precedes(df, key, pk, desc, bounds[high]) & _near(df, key, bounds[high], desc))
        left, rows = left - first, last - first
    return part, left


def page(df: DataFrame, key: str, pk: str, desc: bool = False, skip: int = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Rows ``skip`` to ``skip + limit`` by ``key``, then the unique ``pk``. A page
    that ends beyond ``DEEP_ROWS`` is located by counts first (jobs that run here)."""
    _check_page(skip, limit)
    if skip + limit > DEEP_ROWS:
        df, skip = _located(df, key, pk, desc, skip, limit)
    ordered = df.orderBy(*_order(key, pk, desc))
    return (ordered.offset(skip) if skip else ordered).limit(limit)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


# --- filters (shared by page and total) ---------------------------------------

def passengers_matching(t, search: str | None = None) -> DataFrame:
    return t["passengers"].filter(ilike_any(search, "full_name", "passport_no", "email", "phone"))


def airports_matching(t, search=None, country=None, is_active=None) -> DataFrame:
    return t["airports"].filter(all_of(
        ilike_any(search, "airport_name", "iata_code", "city"),
        ilike_any(country, "country") if country else None,
        (F.col("is_active") == F.lit(is_active)) if is_active is not None else None))


def aircraft_matching(t, status=None) -> DataFrame:
    a = t["aircraft"]
    return a.filter(F.col("status") == status) if status else a


def _resolved_airport(t, code: str | None):
    """airport_id of an IATA code (upper-cased) as a scalar subquery; NULL if unknown."""
    return (t["airports"].filter(F.col("iata_code") == F.lit(code.upper()))
            .agg(F.min("airport_id")).scalar())


def flights_matching(t, status=None, origin=None, destination=None) -> DataFrame:
    """Status filter; origin/destination by IATA code. An unknown code drops
    that filter (the code is resolved first, as the reservation system does)."""
    f = t["flights"]
    preds = []
    if status:
        preds.append(F.col("status") == status)
    for code, col in ((origin, "origin_airport_id"), (destination, "dest_airport_id")):
        if code:
            rid = _resolved_airport(t, code)
            preds.append(rid.isNull() | (F.col(col) == rid))
    return f.filter(all_of(*preds))


def _with_flight_names(t, f: DataFrame) -> DataFrame:
    oa = t.dim("airports").select(F.col("airport_id").alias("origin_airport_id"),
                                  F.col("iata_code").alias("origin_iata"))
    da = t.dim("airports").select(F.col("airport_id").alias("dest_airport_id"),
                                  F.col("iata_code").alias("dest_iata"))
    ac = t["aircraft"].select("aircraft_id", F.col("model").alias("aircraft_model"))
    return (f.join(oa, "origin_airport_id").join(da, "dest_airport_id").join(ac, "aircraft_id")
            .select(*t["flights"].columns, "origin_iata", "dest_iata", "aircraft_model")
            .withColumn("base_fare", F.col("base_fare").cast("double")))


# --- listings -------------------------------------------------------------------

def list_passengers(t, search=None, skip=0, limit=DEFAULT_LIMIT) -> DataFrame:
    return page(passengers_matching(t, search), "created_at", "passenger_id", True, skip, limit)


def list_passengers_total(t, search=None) -> DataFrame:
    return total(passengers_matching(t, search))


def list_airports(t, search=None, country=None, is_active=None, skip=0,
                  limit=DEFAULT_LIMIT) -> DataFrame:
    return page(airports_matching(t, search, country, is_active), "iata_code", "airport_id", False,
                skip, limit)


def list_airports_total(t, search=None, country=None, is_active=None) -> DataFrame:
    return total(airports_matching(t, search, country, is_active))


def list_aircraft(t, status=None, skip=0, limit=DEFAULT_LIMIT) -> DataFrame:
    return page(aircraft_matching(t, status), "registration_no", "aircraft_id", False, skip, limit)


def list_aircraft_total(t, status=None) -> DataFrame:
    return total(aircraft_matching(t, status))


def list_fare_classes(t) -> DataFrame:
    """All fare classes by multiplier (unpaged)."""
    return (t["fare_classes"].withColumn("multiplier", F.col("multiplier").cast("double"))
            .orderBy("multiplier", "fare_class_id"))


def list_staff(t) -> DataFrame:
    """The staff directory by name (unpaged; no credentials)."""
    return (t["staff"].select("staff_id", "full_name", "email", "role", "is_active", "created_at")
            .orderBy("full_name", "staff_id"))


def list_flights(t, status=None, origin=None, destination=None, skip=0,
                 limit=DEFAULT_LIMIT) -> DataFrame:
    f = flights_matching(t, status, origin, destination)
    # page first (top-k on the flights table), then decorate only the page
    p = page(f, "created_at", "flight_id", True, skip, limit)
    return _with_flight_names(t, p)


def list_flights_total(t, status=None, origin=None, destination=None) -> DataFrame:
    return total(flights_matching(t, status, origin, destination))


def list_bookings(t, flight_id=None, passenger_id=None, status=None, skip=0,
                  limit=DEFAULT_LIMIT) -> DataFrame:
    """Bookings, newest first. A flight or passenger id of 0 means no filter."""
    b = t["bookings"]
    if flight_id:
        b = b.filter(F.col("flight_id") == F.lit(flight_id))
    if passenger_id:
        b = b.filter(F.col("passenger_id") == F.lit(passenger_id))
    if status:
        b = b.filter(F.col("status") == status)
    return page(b, "booked_at", "booking_id", True, skip, limit)


# --- bulk lookups ---------------------------------------------------------------

LOOKUPS = {  # name -> (table, key column)
    "passenger": ("passengers", "passenger_id"), "airport": ("airports", "airport_id"),
    "aircraft": ("aircraft", "aircraft_id"), "fare_class": ("fare_classes", "fare_class_id"),
    "staff": ("staff", "staff_id"), "flight": ("flights", "flight_id"),
    "schedule": ("flight_schedules", "flight_id"), "booking": ("bookings", "booking_id"),
    "payment": ("payments", "booking_id"), "ticket": ("tickets", "booking_id"),
}


def bulk_lookup(t, kind: str, keys: DataFrame) -> DataFrame:
    """For each distinct key (column ``key``): ``found`` and the row's columns."""
    table, col = LOOKUPS[kind]
    df = t[table]
    k = keys.select(F.col("key").cast(df.schema[col].dataType).alias("key")).distinct()
    hit = df.withColumn("_found", F.lit(True))
    j = k.join(hit, k.key == hit[col], "left")
    cols = [F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType)
            else F.col(f.name) for f in df.schema.fields if f.name != col]
    return j.select("key", F.coalesce(F.col("_found"), F.lit(False)).alias("found"), *cols)


def _lookup_by_code(df: DataFrame, col: str, keys: DataFrame) -> DataFrame:
    k = keys.select(F.col("key").cast("string").alias("key")).distinct()
    k = k.withColumn("_code", F.upper(F.col("key")))
    hit = df.withColumn("_found", F.lit(True))
    j = k.join(hit, k._code == hit[col], "left")
    return j.select("key", F.coalesce(F.col("_found"), F.lit(False)).alias("found"), *df.columns)


def bulk_lookup_pnr(t, keys: DataFrame) -> DataFrame:
    """Bookings by PNR; the key is upper-cased first."""
    return _lookup_by_code(t["bookings"], "pnr", keys)


def bulk_lookup_ticket_no(t, keys: DataFrame) -> DataFrame:
    """Tickets by ticket number; the key is upper-cased first."""
    tk = t["tickets"].withColumn("base_fare", F.col("base_fare").cast("double")) \
        .withColumn("final_fare", F.col("final_fare").cast("double")) \
        .withColumn("multiplier_snapshot", F.col("multiplier_snapshot").cast("double"))
    return _lookup_by_code(tk, "ticket_no", keys)
