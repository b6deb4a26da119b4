"""Build small hand-made table snapshots for edge-case tests."""

import datetime as dt
from decimal import Decimal

from airops.schema import TABLE_SCHEMAS
from airops.sources.tables import Tables

T0 = dt.datetime(2024, 1, 1)


def make_tables(spark, **rows):
    frames = {}
    for name, schema in TABLE_SCHEMAS.items():
        frames[name] = spark.createDataFrame(rows.get(name, []), schema)
    return Tables(spark, frames)


def passenger(pid, passport=None, email=None, gender="Male"):
    return (pid, f"P {pid}", dt.date(1990, 1, 1), gender, "X", passport or f"PP{pid}", "1",
            email or f"p{pid}@x.org", T0)


def airport(aid, code):
    return (aid, f"A {code}", code, "C", "K", 1, True, T0)


def aircraft(aid, cap, status="Active"):
    return (aid, f"REG{aid}", "M", cap, status, T0)


def fare_class(fid, name="Economy", mult="1.00"):
    return (fid, name, Decimal(mult), 20, None, T0)


def flight(fid, origin=1, dest=2, aircraft_id=1, status="Scheduled", fare="100.00"):
    return (fid, f"FL{fid}", origin, dest, aircraft_id, Decimal(fare), status, T0)


def seat(sid, fid, status="Available", fc=1):
    return (sid, fid, fc, f"{sid:03d}A", status, T0)


def booking(bid, pid, fid, sid, status="Confirmed", booked=T0):
    reason = "r" if status == "Cancelled" else None
    return (bid, pid, fid, sid, 1, f"PNR{bid}", status, reason, None, booked)


def payment(bid, amount, status="Completed", at=T0, refund="0.00"):
    return (bid, bid, "Card", Decimal(amount), status, Decimal(refund), at, at)


def staff(sid):
    return (sid, "S", f"s{sid}@x.org", "Super_Admin", True, T0)
