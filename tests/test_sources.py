"""The DataFrame-built airline tables equal the fixture SQL (DuckDB) row for row."""

import pytest

from oracles.fixture_sql import with_prefix

NAMES = ["passengers", "airports", "aircraft", "fare_classes", "staff", "flights",
         "flight_schedules", "seats", "bookings", "tickets", "payments", "boarding_records",
         "booking_requests", "cancel_requests", "payment_requests", "boarding_events"]


def _norm(rows):
    return sorted(tuple(str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_table_matches_fixture_sql(tables, duck, name):
    df = tables[name] if name in tables else tables.extra(name)
    a = _norm(df.collect())
    b = _norm(duck.sql(with_prefix(f"select * from {name}", {name})).fetchall())
    assert a == b


def test_schema_is_target(tables):
    from airops.schema import TABLE_SCHEMAS
    for name, schema in TABLE_SCHEMAS.items():
        got = [(f.name, f.dataType) for f in tables[name].schema.fields]
        assert got == [(f.name, f.dataType) for f in schema.fields], name


def test_write_snapshot_new_version(spark, tables, tmp_path):
    from airops.sources.tables import write_snapshot
    out = write_snapshot(tables, str(tmp_path), 1, only=["airports"])
    assert spark.read.parquet(f"{out}/airports").count() == tables["airports"].count()
    with pytest.raises(Exception):
        write_snapshot(tables, str(tmp_path), 1, only=["airports"])
