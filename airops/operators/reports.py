"""Revenue and operational reports.

Scale notes (checked with ``explain``):

* Facts are aggregated to one row per flight *before* joining flights and
  airports (``_per_flight``): the big join is payments x bookings on
  booking_id (co-partitioned, one shuffle each), and a hot flight is reduced
  to one partial-aggregate row per map task before any flight-keyed shuffle.
* Joins on a primary or unique key of the other side that only test
  existence are semi joins (no fan-out, no payload columns).
* every join is the planner's choice: airports and fare_classes are small
  enough to be broadcast by their bytes, flights and aircraft grow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airops.functions.numeric import (avg_money, minutes_between, money, pct_half_up)
from airops.functions.predicates import payment_window

ARROW = " → "  # fixed value: route label separator


def _route(t, df: DataFrame) -> DataFrame:
    """Add origin_iata / dest_iata / route to a frame with the airport ids."""
    oa = t.dim("airports").select(F.col("airport_id").alias("origin_airport_id"),
                                  F.col("iata_code").alias("origin_iata"))
    da = t.dim("airports").select(F.col("airport_id").alias("dest_airport_id"),
                                  F.col("iata_code").alias("dest_iata"))
    return (df.join(oa, "origin_airport_id").join(da, "dest_airport_id")
            .withColumn("route", F.concat(F.col("origin_iata"), F.lit(ARROW), F.col("dest_iata"))))


def completed_payments(t, date_from=None, date_to=None) -> DataFrame:
    return (t["payments"].filter((F.col("status") == "Completed")
                                 & payment_window(date_from, date_to))
            .select("booking_id", "amount"))


def _per_flight(t, date_from=None, date_to=None) -> DataFrame:
    """Completed payments of existing bookings, aggregated per flight."""
    p = completed_payments(t, date_from, date_to)
    b = t["bookings"].select("booking_id", "flight_id")
    return (p.join(b, "booking_id")
            .groupBy("flight_id")
            .agg(F.count("booking_id").alias("n"), F.sum("amount").alias("revenue")))


def revenue_summary(t, date_from=None, date_to=None) -> DataFrame:
    """Count, sum, average, refunds and net over Completed + Refunded payments."""
    p = t["payments"].filter(F.col("status").isin("Completed", "Refunded")
                             & payment_window(date_from, date_to))
    total, refunds = F.sum("amount"), F.sum("refund_amount")
    return p.agg(F.count("payment_id").alias("total_transactions"),
                 money(total).alias("total_revenue"),
                 avg_money(total, F.count("amount")).alias("average_fare"),
                 money(refunds).alias("total_refunds"),
                 money(total - refunds).alias("net_revenue"))


def revenue_summary_dated(t, date_from, date_to) -> DataFrame:
    """The summary with its window shown (``'All time'`` for an open bound)."""
    s = revenue_summary(t, date_from, date_to)
    return s.select(F.lit(str(date_from) if date_from else "All time").alias("date_from"),
                    F.lit(str(date_to) if date_to else "All time").alias("date_to"), "*")


def _by_class(t, date_from=None, date_to=None) -> DataFrame:
    tk = t["tickets"].filter(~F.col("is_cancelled")).select("booking_id", "fare_class_id",
                                                            "ticket_id", "final_fare")
    tk = (tk.join(t["bookings"].select("booking_id"), "booking_id", "left_semi")
          .join(completed_payments(t, date_from, date_to).select("booking_id"), "booking_id",
                "left_semi"))
    fc = t.dim("fare_classes").select("fare_class_id", "class_name", "multiplier")
    return (tk.join(fc, "fare_class_id")
            .groupBy("class_name", "multiplier")
            .agg(F.count("ticket_id").alias("tickets_sold"),
                 F.sum("final_fare").alias("_rev"), F.count("final_fare").alias("_n"))
            .select("class_name", F.col("tickets_sold"), money(F.col("_rev")).alias("class_revenue"),
                    avg_money(F.col("_rev"), F.col("_n")).alias("avg_fare"),
                    F.col("multiplier").cast("double").alias("multiplier")))


def revenue_by_class(t, date_from=None, date_to=None) -> DataFrame:
    return _by_class(t, date_from, date_to).orderBy(F.desc_nulls_last("class_revenue"), "class_name")


def _by_route(t, date_from=None, date_to=None) -> DataFrame:
    pf = _per_flight(t, date_from, date_to)
    f = t["flights"].select("flight_id", "origin_airport_id", "dest_airport_id")
    r = _route(t, pf.join(f, "flight_id"))
    return (r.groupBy("origin_iata", "dest_iata", "route")
            .agg(F.sum("n").alias("bookings"), F.sum("revenue").alias("_rev"))
            .select("route", "bookings", money(F.col("_rev")).alias("route_revenue"),
                    avg_money(F.col("_rev"), F.col("bookings")).alias("avg_fare")))


def revenue_by_route(t, date_from=None, date_to=None) -> DataFrame:
    return _by_route(t, date_from, date_to).orderBy(F.desc_nulls_last("route_revenue"), "route")


def _by_method(t, date_from=None, date_to=None) -> DataFrame:
    p = t["payments"].filter((F.col("status") == "Completed") & payment_window(date_from, date_to))
    return (p.groupBy(F.col("method").alias("payment_method"))
            .agg(F.count("payment_id").alias("transaction_count"),
                 money(F.sum("amount")).alias("method_revenue")))


def revenue_by_method(t, date_from=None, date_to=None) -> DataFrame:
    return _by_method(t, date_from, date_to).orderBy(F.desc_nulls_last("method_revenue"), "payment_method")


def top_flights(t, date_from=None, date_to=None, n: int = 10) -> DataFrame:
    """Top ``n`` flights by Completed revenue (tie-break: flight_no)."""
    pf = _per_flight(t, date_from, date_to)
    f = t["flights"].select("flight_id", "flight_no", "origin_airport_id", "dest_airport_id")
    r = _route(t, pf.join(f, "flight_id"))
    # flight_no is unique (uq_flight_no): one row per flight already
    return (r.select("flight_no", "route", F.col("n").alias("passengers"),
                     money(F.col("revenue")).alias("flight_revenue"))
            .orderBy(F.desc_nulls_last("flight_revenue"), "flight_no").limit(n))


def flights_by_status(t) -> DataFrame:
    return (t["flights"].groupBy("status").agg(F.count(F.lit(1)).alias("flight_count"))
            .orderBy(F.desc("flight_count"), "status"))


def seat_occupancy(t) -> DataFrame:
    """Confirmed bookings per flight over aircraft capacity (flights without any: 0)."""
    conf = (t["bookings"].filter(F.col("status") == "Confirmed")
            .groupBy("flight_id").agg(F.count("booking_id").alias("confirmed_bookings")))
    f = (t["flights"].select("flight_id", "flight_no", "aircraft_id", "origin_airport_id",
                             "dest_airport_id")
         .join(t["aircraft"].select("aircraft_id", "seat_capacity"), "aircraft_id"))
    r = _route(t, f).join(conf, "flight_id", "left")
    cnt = F.coalesce(F.col("confirmed_bookings"), F.lit(0)).cast("bigint")
    return (r.select("flight_no", "route", "seat_capacity", cnt.alias("confirmed_bookings"),
                     pct_half_up(cnt, F.col("seat_capacity")).alias("occupancy_percent"))
            .orderBy(F.desc_nulls_last("occupancy_percent"), "flight_no"))


def noshow_rates(t) -> DataFrame:
    br = (t["boarding_records"].groupBy("flight_id")
          .agg(F.count("boarding_id").alias("total_boarded"),
               F.count(F.when(F.col("status") == "No_Show", 1)).alias("no_shows"),
               F.count(F.when(F.col("status") == "Boarded", 1)).alias("boarded")))
    return (br.join(t["flights"].select("flight_id", "flight_no"), "flight_id")
            .select("flight_no", "total_boarded", "no_shows", "boarded",
                    pct_half_up(F.col("no_shows"), F.col("total_boarded")).alias("noshow_percent"))
            .orderBy(F.desc_nulls_last("noshow_percent"), "flight_no"))


def ontime_performance(t) -> DataFrame:
    s = t["flight_schedules"].select("flight_id", "dep_datetime", "actual_dep")
    j = s.join(t["flights"].select("flight_id", "flight_no"), "flight_id")
    dep, act = F.col("dep_datetime"), F.col("actual_dep")
    status = (F.when(act.isNull(), "Not Departed").when(act <= dep, "On Time")
              .otherwise("Delayed"))
    delay = F.when(act.isNotNull() & (act > dep), minutes_between(dep, act)).otherwise(F.lit(0.0))
    return (j.select("flight_no", dep.alias("scheduled_dep"), act.alias("actual_dep"),
                     status.alias("departure_status"), delay.alias("delay_minutes"))
            .orderBy(F.desc_nulls_last("scheduled_dep"), "flight_no"))


def overall_stats(t) -> DataFrame:
    """Distinct flights, bookings, passengers and cancelled bookings.

    Same as flights LEFT JOIN bookings LEFT JOIN passengers with four count
    distincts, without the joins' fan-out: bookings are semi-joined to
    flights, their distinct passengers to passengers, and all meet in one union
    that is counted by one aggregate."""
    fl = t["flights"].select("flight_id")
    b = t["bookings"].select("booking_id", "passenger_id", "flight_id", "status")
    b = b.join(fl, "flight_id", "left_semi")
    # ids are primary keys: only passengers repeat among bookings
    known = b.select("passenger_id").distinct().join(t["passengers"].select("passenger_id"),
                                                     "passenger_id", "left_semi")
    rows = (fl.select(F.lit("f").alias("kind"), F.lit(False).alias("gone"))
            .unionByName(b.select(F.lit("b").alias("kind"),
                                  F.coalesce(F.col("status") == "Cancelled", F.lit(False)).alias("gone")))
            .unionByName(known.select(F.lit("p").alias("kind"), F.lit(False).alias("gone"))))
    count = lambda k: F.count_if(F.col("kind") == k)
    return rows.agg(count("f").alias("total_flights"), count("b").alias("total_bookings"),
                    count("p").alias("total_passengers"), F.count_if("gone").alias("cancelled_bookings"))


# --- the two documents ------------------------------------------------------

def _nest(df: DataFrame, name: str, order: list, key: str) -> DataFrame:
    """One row ``(key, name: array<struct>)`` ordered by ``order`` (bounded sections only)."""
    fields = [c for c in df.columns]
    # a section's amounts fall with nulls last, as in the section itself
    sort_struct = F.struct(*[F.struct(o.isNull(), o).alias(f"_o{i}") for i, o in enumerate(order)],
                           F.struct(*fields).alias("v"))
    arr = F.sort_array(F.collect_list(sort_struct))
    return (df.groupBy(F.lit(key).alias("report_type"))
            .agg(F.transform(arr, lambda x: x["v"]).alias(name)))


def revenue_report(t, date_from=None, date_to=None) -> DataFrame:
    """The revenue document as one nested row.

    Every list is bounded by dimension sizes (classes, airport pairs, methods,
    top 10), not by the number of bookings."""
    key = "Revenue Report"
    summ = revenue_summary(t, date_from, date_to)
    summary = summ.select(F.lit(key).alias("report_type"),
                          F.lit(str(date_from) if date_from else "All time").alias("date_from"),
                          F.lit(str(date_to) if date_to else "All time").alias("date_to"),
                          F.struct(*summ.columns).alias("summary"))
    # unsorted: each section is ordered once, where it is nested
    c = _by_class(t, date_from, date_to)
    r = _by_route(t, date_from, date_to)
    m = _by_method(t, date_from, date_to)
    tf = top_flights(t, date_from, date_to)
    parts = [
        _nest(c, "by_class", [-F.col("class_revenue"), F.col("class_name")], key),
        _nest(r, "by_route", [-F.col("route_revenue"), F.col("route")], key),
        _nest(m, "by_method", [-F.col("method_revenue"), F.col("payment_method")], key),
        _nest(tf, "top_flights", [-F.col("flight_revenue"), F.col("flight_no")], key),
    ]
    out = _assemble(key, [summary] + parts)
    return out.select("report_type", "date_from", "date_to", "summary",
                      *[F.coalesce(F.col(n), F.array().cast(out.schema[n].dataType)).alias(n)
                        for n in ("by_class", "by_route", "by_method", "top_flights")])


def _assemble(key: str, sections: list[DataFrame]) -> DataFrame:
    """One document row from one-row sections, without joining them: the
    sections are stacked (each row fills its own columns, NULL elsewhere) and
    folded by a single aggregate over the document key."""
    fields = {}
    for sec in sections:
        for f in sec.schema.fields:
            if f.name != "report_type":
                fields[f.name] = f.dataType
    rows = [sec.select("report_type", *[(F.col(n) if n in sec.columns
                                         else F.lit(None).cast(dt)).alias(n)
                                        for n, dt in fields.items()]) for sec in sections]
    stacked = rows[0]
    for r in rows[1:]:
        stacked = stacked.unionByName(r)
    return (stacked.groupBy("report_type")
            .agg(*[F.first(n, ignorenulls=True).alias(n) for n in fields])
            .filter(F.col("report_type") == F.lit(key)))


def _rows(df: DataFrame, section: str, label: str, n: str, amount, average) -> DataFrame:
    """A section's entries in their order, in the columns that all sections share."""
    order = Window.partitionBy("section").orderBy(F.desc_nulls_last("amount"), "entry")
    return df.select(F.lit(section).alias("section"), F.col(label).alias("entry"),
                     F.col(n).cast("bigint").alias("entries"), amount.cast("double").alias("amount"),
                     average.cast("double").alias("average")).withColumn(
        "position", F.row_number().over(order).cast("bigint")).select(
        "section", "position", "entry", "entries", "amount", "average")


def revenue_report_rows(t, date_from=None, date_to=None) -> DataFrame:
    """The revenue document as rows (section, position, entry, entries, amount,
    average); sections are bounded by the dimensions."""
    none, c = F.lit(None), F.col
    summary = revenue_summary(t, date_from, date_to).withColumn("window", F.lit(
        "All time" if not (date_from or date_to) else f"{date_from or ''}..{date_to or ''}"))
    parts = [
        _rows(_by_class(t, date_from, date_to), "by_class", "class_name", "tickets_sold",
              c("class_revenue"), c("avg_fare")),
        _rows(_by_route(t, date_from, date_to), "by_route", "route", "bookings", c("route_revenue"),
              c("avg_fare")),
        _rows(_by_method(t, date_from, date_to), "by_method", "payment_method", "transaction_count",
              c("method_revenue"), none),
        _rows(top_flights(t, date_from, date_to), "top_flights", "flight_no", "passengers",
              c("flight_revenue"), none),
        _rows(summary, "summary", "window", "total_transactions", c("net_revenue"), c("average_fare")),
    ]
    return reduce(DataFrame.unionByName, parts)


def operational_report_rows(t) -> DataFrame:
    """The bounded sections of the operational document as rows; the per-flight
    sections are the queries ``seat_occupancy``, ``noshow_rates`` and
    ``ontime_performance``."""
    c = F.col
    stats = overall_stats(t)
    line = F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("position"), F.lit(n).alias("entry"),
                                        c(n).alias("entries")) for k, n in enumerate(stats.columns, start=1)]))
    flat = stats.select(line.alias("x")).select(
        F.lit("overall_stats").alias("section"), "x.position", "x.entry", "x.entries",
        c("x.entries").cast("double").alias("amount"), F.lit(None).cast("double").alias("average"))
    return flat.unionByName(_rows(flights_by_status(t), "flights_by_status", "status", "flight_count",
                                  c("flight_count"), F.lit(None)))


def operational_report(t) -> dict[str, DataFrame]:
    """The operational document.

    overall_stats and flights_by_status are bounded and nested into one row
    (key ``summary``); the per-flight sections grow with the number of flights
    and are returned as their own DataFrames instead of being packed into a
    single row (which would pull every flight through one task)."""
    key = "Operational Report"
    stats = overall_stats(t)
    head = stats.select(F.lit(key).alias("report_type"), F.struct(*stats.columns)
                        .alias("overall_stats"))
    st = _nest(flights_by_status(t), "flights_by_status",
               [-F.col("flight_count"), F.col("status")], key)
    summary = _assemble(key, [head, st])
    return {"summary": summary, "seat_occupancy": seat_occupancy(t),
            "noshow_rates": noshow_rates(t), "ontime_performance": ontime_performance(t)}
