"""The derived tables: seats of odd rows, and what a query pays for."""

import shutil
from pathlib import Path

from pyspark.sql import functions as F

from airops import plans
from airops.sources import fixtures
from airops.sources.tables import airline_tables

SF001 = "/root/testdata/sf0.001"


def _frames(spark):
    flights = spark.createDataFrame([(1, 1), (2, 2), (2, 2), (3, 9), (4, 3), (None, 1)], "flight_id bigint, aircraft_id bigint")
    aircraft = spark.createDataFrame([(1, 3), (2, 2), (3, 0)], "aircraft_id bigint, seat_capacity int")
    bw = spark.createDataFrame(
        [(10, 1, 1, "Confirmed"), (11, 1, 2, "Pending"), (12, 1, 3, "Cancelled"), (13, 2, 1, "Confirmed"),
         (13, 2, 1, "Confirmed"), (14, 1, 9, "Confirmed"), (15, 4, 1, "Confirmed"), (16, 1, None, "Pending")],
        "booking_id bigint, flight_id bigint, seat_idx bigint, status string")
    boarding = spark.createDataFrame([(10, "Boarded"), (13, "No_Show"), (13, "Boarded")], "booking_id bigint, status string")
    return flights, aircraft, bw, boarding


def test_seats_of_repeated_and_odd_rows(spark):
    """Against a join of every seat with its bookings and their boardings."""
    flights, aircraft, bw, boarding = _frames(spark)
    got = fixtures.seats({}, flights, aircraft, bw, boarding)
    for name, df in (("f", flights), ("a", aircraft), ("b", bw), ("r", boarding)):
        df.createOrReplaceTempView(f"derivation_{name}")
    want = spark.sql("""
        select f.flight_id * 100 + n seat_id, case when r.status = 'Boarded' then 'Occupied'
               when b.booking_id is not null then 'Reserved' else 'Available' end status
        from (select flight_id, explode(case when seat_capacity > 0 then sequence(1, seat_capacity) else array() end) n
              from derivation_f join derivation_a using (aircraft_id)) f
        left join derivation_b b on b.flight_id = f.flight_id and b.seat_idx = n and b.status <> 'Cancelled'
        left join derivation_r r on r.booking_id = b.booking_id""")
    rows = lambda df: sorted(map(str, df.select("seat_id", "status").collect()))
    assert rows(got) == rows(want) and got.count() == 16


def test_seat_rows_are_not_shuffled(spark):
    text = plans.formatted(fixtures.seats({}, *_frames(spark)), "simple")
    lines = text.splitlines()
    laid_out = next(i for i, line in enumerate(lines) if "Generate" in line)
    assert not any("Exchange" in line or "Join" in line for line in lines[:laid_out])


def test_a_query_derives_the_tables_that_it_reads(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for t in fixtures.RAW_TABLES:
        shutil.copyfile(f"{SF001}/{t}.parquet", tmp_path / f"d/{t}.parquet")
    t = airline_tables(spark, str(tmp_path / "d"))
    (tmp_path / "d/lineitem.parquet").unlink()  # the bookings could not be derived any more
    assert t["passengers"].count() == spark.read.parquet(f"{SF001}/customer.parquet").count()
    assert "seats" in t and len(t) == 12
    assert Path(f"{SF001}/lineitem.parquet").exists()
    assert t.replace(passengers=t["passengers"].where(F.lit(False)))["passengers"].count() == 0
