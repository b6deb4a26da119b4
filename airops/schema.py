"""Target schema of the twelve airline tables and their enumerations.

Fixed values (must equal the reservation system's definitions for the
results to agree): the enum value lists below, in declaration order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: enumerations of the reservation data model --------------
AIRCRAFT_STATUS = ("Active", "Maintenance", "Retired")
FLIGHT_STATUS = ("Scheduled", "Boarding", "Departed", "Arrived", "Cancelled")
SEAT_STATUS = ("Available", "Reserved", "Occupied")
BOOKING_STATUS = ("Pending", "Confirmed", "Cancelled")
PAYMENT_STATUS = ("Pending", "Completed", "Refunded")
PAYMENT_METHOD = ("Cash", "Card", "Bank_Transfer")
BOARDING_STATUS = ("Boarded", "No_Show")
STAFF_ROLE = ("Super_Admin", "Operations_Manager", "Reservation_Agent",
              "Ground_Staff", "Finance_Officer")
GENDERS = ("Male", "Female", "Other")
# flight states in which no booking is taken
CLOSED_FLIGHT_STATUS = ("Departed", "Arrived", "Cancelled")
# flight states in which boarding records exist
BOARDED_FLIGHT_STATUS = ("Boarding", "Departed", "Arrived")
# --- end of fixed values ----------------------------------------------------

LONG, INT, STR, BOOL = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType()
DATE, TS = T.DateType(), T.TimestampNTZType()
MONEY = T.DecimalType(12, 2)
MULT = T.DecimalType(4, 2)


def _s(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


TABLE_SCHEMAS: dict[str, T.StructType] = {
    "passengers": _s(("passenger_id", LONG, False), ("full_name", STR, False),
                     ("date_of_birth", DATE, False), ("gender", STR, False),
                     ("nationality", STR, False), ("passport_no", STR, False),
                     ("phone", STR, False), ("email", STR, False), ("created_at", TS, False)),
    "airports": _s(("airport_id", LONG, False), ("airport_name", STR, False),
                   ("iata_code", STR, False), ("city", STR, False), ("country", STR, False),
                   ("terminals", INT, False), ("is_active", BOOL, False), ("created_at", TS, False)),
    "aircraft": _s(("aircraft_id", LONG, False), ("registration_no", STR, False),
                   ("model", STR, False), ("seat_capacity", INT, False), ("status", STR, False),
                   ("created_at", TS, False)),
    "fare_classes": _s(("fare_class_id", LONG, False), ("class_name", STR, False),
                       ("multiplier", MULT, False), ("baggage_allowance_kg", INT, False),
                       ("description", STR, True), ("created_at", TS, False)),
    "staff": _s(("staff_id", LONG, False), ("full_name", STR, False), ("email", STR, False),
                ("role", STR, False), ("is_active", BOOL, False), ("created_at", TS, False)),
    "flights": _s(("flight_id", LONG, False), ("flight_no", STR, False),
                  ("origin_airport_id", LONG, False), ("dest_airport_id", LONG, False),
                  ("aircraft_id", LONG, False), ("base_fare", MONEY, False), ("status", STR, False),
                  ("created_at", TS, False)),
    "flight_schedules": _s(("schedule_id", LONG, False), ("flight_id", LONG, False),
                           ("dep_datetime", TS, False), ("arr_datetime", TS, False),
                           ("actual_dep", TS, True), ("actual_arr", TS, True),
                           ("terminal", STR, True), ("gate", STR, True), ("created_at", TS, False)),
    "seats": _s(("seat_id", LONG, False), ("flight_id", LONG, False), ("fare_class_id", LONG, False),
                ("seat_number", STR, False), ("status", STR, False), ("created_at", TS, False)),
    "bookings": _s(("booking_id", LONG, False), ("passenger_id", LONG, False),
                   ("flight_id", LONG, False), ("seat_id", LONG, False), ("staff_id", LONG, False),
                   ("pnr", STR, False), ("status", STR, False), ("cancel_reason", STR, True),
                   ("cancelled_at", TS, True), ("booked_at", TS, False)),
    "tickets": _s(("ticket_id", LONG, False), ("booking_id", LONG, False),
                  ("fare_class_id", LONG, False), ("ticket_no", STR, False),
                  ("base_fare", MONEY, False), ("multiplier_snapshot", MULT, False),
                  ("final_fare", MONEY, False), ("issue_date", TS, False),
                  ("is_cancelled", BOOL, False)),
    "payments": _s(("payment_id", LONG, False), ("booking_id", LONG, False), ("method", STR, False),
                   ("amount", MONEY, False), ("status", STR, False),
                   ("refund_amount", MONEY, False), ("payment_date", TS, False),
                   ("updated_at", TS, False)),
    "boarding_records": _s(("boarding_id", LONG, False), ("booking_id", LONG, False),
                           ("passenger_id", LONG, False), ("flight_id", LONG, False),
                           ("status", STR, False), ("boarded_at", TS, False)),
}

TABLES = tuple(TABLE_SCHEMAS)

# Declared string lengths (String(n) columns); used by audit_domain.
STRING_LENGTHS: dict[str, dict[str, int]] = {
    "passengers": {"full_name": 150, "gender": 20, "nationality": 100, "passport_no": 50,
                   "phone": 20, "email": 150},
    "airports": {"airport_name": 200, "iata_code": 3, "city": 100, "country": 100},
    "aircraft": {"registration_no": 20, "model": 100},
    "fare_classes": {"class_name": 50},
    "staff": {"full_name": 150, "email": 150},
    "flights": {"flight_no": 20},
    "flight_schedules": {"terminal": 20, "gate": 20},
    "seats": {"seat_number": 10},
    "bookings": {"pnr": 20},
    "tickets": {"ticket_no": 30},
}

ENUM_COLUMNS: dict[str, dict[str, tuple[str, ...]]] = {
    "aircraft": {"status": AIRCRAFT_STATUS},
    "flights": {"status": FLIGHT_STATUS},
    "seats": {"status": SEAT_STATUS},
    "bookings": {"status": BOOKING_STATUS},
    "payments": {"status": PAYMENT_STATUS, "method": PAYMENT_METHOD},
    "boarding_records": {"status": BOARDING_STATUS},
    "staff": {"role": STAFF_ROLE},
}

PRIMARY_KEYS = {
    "passengers": "passenger_id", "airports": "airport_id", "aircraft": "aircraft_id",
    "fare_classes": "fare_class_id", "staff": "staff_id", "flights": "flight_id",
    "flight_schedules": "schedule_id", "seats": "seat_id", "bookings": "booking_id",
    "tickets": "ticket_id", "payments": "payment_id", "boarding_records": "boarding_id",
}
