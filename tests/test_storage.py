"""Tables on any URI, changed files, repeated epochs, and money that does not fit."""

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from airops.operators.commands.booking_flow import cancel_bookings, process_payments
from airops.operators.commands.reference_data import create_airports
from airops.sources.tables import airline_tables, read_marker, write_snapshot
from airops.streaming import command_sink

SF001 = "/root/testdata/sf0.001"


def test_bind_write_and_bind_again_by_uri(spark, tables, tmp_path):
    raw = airline_tables(spark, f"file://{SF001}")
    assert raw["bookings"].count() == tables["bookings"].count()
    out = write_snapshot(tables, f"file://{tmp_path}", 1)
    again = airline_tables(spark, out)
    for name in ("bookings", "seats", "airports"):
        assert sorted(map(str, again[name].collect())) == sorted(map(str, tables[name].collect()))


def test_missing_tables_say_so(spark, tmp_path):
    with pytest.raises(Exception):
        airline_tables(spark, f"file://{tmp_path}/nothing")


def copied(source, target):
    """The files of a folder and its folders in new ones, without their modes (the test data is read-only)."""
    target.mkdir()
    for at in Path(source).iterdir():
        if at.is_dir():
            copied(at, target / at.name)
        else:
            shutil.copyfile(at, target / at.name)


def test_changed_raw_files_are_seen(spark, tmp_path):
    copied(SF001, tmp_path / "d")
    before = airline_tables(spark, str(tmp_path / "d"))["passengers"].count()
    part = spark.read.parquet(f"{SF001}/customer.parquet").limit(7)
    part.write.parquet(str(tmp_path / "c"))
    (tmp_path / "d/customer.parquet").unlink()
    copied(tmp_path / "c", tmp_path / "d/customer.parquet")
    assert airline_tables(spark, str(tmp_path / "d"))["passengers"].count() == 7 != before


def test_an_epoch_tried_again_changes_nothing(spark, tables, tmp_path):
    batch = tables.extra("cancel_requests")
    sink = command_sink(cancel_bookings, lambda: tables, f"{tmp_path}/out", f"{tmp_path}/snap")
    sink(batch, 0)
    first = sorted(map(str, spark.read.parquet(f"{tmp_path}/out").collect()))
    sink(batch, 0)
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out").collect())) == first
    assert read_marker(spark, f"{tmp_path}/snap/v0/_DONE") == "0"
    assert airline_tables(spark, f"{tmp_path}/snap/v0")["bookings"].count() == tables["bookings"].count()


def test_fares_that_do_not_fit_fail_alone(spark, tables):
    b = (tables["bookings"].filter("status = 'Pending'")
         .join(tables["payments"].select("booking_id"), "booking_id", "left_anti").orderBy("booking_id").limit(3)
         .select("booking_id", "flight_id").collect())
    assert len({r.flight_id for r in b}) == 3
    fare = (F.when(F.col("flight_id") == b[0].flight_id, F.lit("0.00"))
            .when(F.col("flight_id") == b[1].flight_id, F.lit("9999999999.99")).otherwise(F.lit("100.00")))
    double = tables["fare_classes"].withColumn("multiplier", F.lit("2.00").cast("decimal(4,2)"))
    t = tables.replace(flights=tables["flights"].withColumn("base_fare", fare.cast("decimal(12,2)")),
                       fare_classes=double)
    rows = [(k, r.booking_id, "Card", a) for k, (r, a) in enumerate(
        [(b[0], "10"), (b[1], "10"), (b[2], "0.004"), (b[2], "99999999999"), (b[2], "10")])]
    req = spark.createDataFrame(rows, "request_id bigint, booking_id bigint, method string, amount string").select(
        "request_id", "booking_id", "method", F.col("amount").cast("decimal(20,3)").alias("amount"),
        F.lit("2024-05-01 00:00:00").cast("timestamp_ntz").alias("requested_at"))
    out, changed = process_payments(t, req)
    assert {r.request_id: r.code for r in out.collect()} == {0: 500, 1: 500, 2: 500, 3: 500, 4: 201}
    assert changed["tickets"].filter("ticket_no = 'TKT-R4'").first().final_fare == 200


def test_codes_of_any_letters_in_any_white_space(spark, tables):
    rows = [(1, "\tabc\n"), (2, "ÄÖÜ"), (3, "a1c"), (4, "ab")]
    req = spark.createDataFrame(rows, "request_id bigint, iata_code string").select(
        "*", F.lit("N").alias("airport_name"), F.lit("C").alias("city"), F.lit("X").alias("country"),
        F.lit(1).alias("terminals"), F.lit("2024-05-01 00:00:00").cast("timestamp_ntz").alias("requested_at"))
    out, _ = create_airports(tables, req)
    assert {r.request_id: r.code for r in out.collect()} == {1: 201, 2: 201, 3: 422, 4: 422}
