"""Results do not depend on the session time zone (timestamps are NTZ throughout)."""

import datetime as dt

import pytest

from oracles.fixture_sql import with_prefix

SF = "/root/testdata/sf0.001"


@pytest.fixture
def other_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/St_Johns")  # -03:30, with DST
    yield spark
    spark.conf.set("spark.sql.session.timeZone", old)


def _norm(rows):
    return sorted(tuple(str(v) for v in r) for r in rows)


def test_schedules_derivation_is_zone_free(other_zone, duck):
    from airops.sources.tables import airline_tables
    t = airline_tables(other_zone, SF, materialize=False)
    a = _norm(t["flight_schedules"].collect())
    b = _norm(duck.sql(with_prefix("select * from flight_schedules", {"flight_schedules"})).fetchall())
    assert a == b


def test_manifest_header_generated_at_is_zone_free(other_zone, tables):
    from airops.operators.views import manifest_header
    when = dt.datetime(2024, 6, 1, 12, 30)
    rows = manifest_header(tables, when).select("generated_at").distinct().collect()
    assert [r.generated_at for r in rows] == [when]
