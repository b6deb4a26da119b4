"""The physical plans have the shape the scale design relies on."""

from airops import plans
from airops.operators import listings as L
from airops.operators import reports as R
from airops.sources import fixtures


def test_route_report_aggregates_per_flight_before_joining_flights(tables):
    text = plans.formatted(R.revenue_by_route(tables, "1995-01-01", "1995-12-31"), "simple")
    # a partial aggregate keyed by flight_id precedes the join with flights
    assert "partial_sum(amount" in text and "keys=[flight_id" in text
    # the status and date filters reach the payments scan
    pushed = " ".join(plans.pushed_filters(R.revenue_by_route(tables, "1995-01-01", "1995-12-31")))
    assert "EqualTo(status,Completed)" in pushed and "payment_date" in pushed


def test_page_is_top_k(tables):
    text = plans.formatted(L.list_passengers(tables, "x", 50, 50), "simple")
    assert "TakeOrderedAndProject(limit=100, offset=50" in text


def test_seat_order_window_is_limited_before_the_shuffle(spark):
    raw = fixtures.read_raw(spark, "/root/testdata/sf0.001")
    bw = fixtures.bookings_wide(raw, fixtures.flights(raw), fixtures.aircraft(raw))
    text = plans.formatted(bw, "simple")
    assert "WindowGroupLimit" in text and "Partial" in text


def test_scans_are_pruned(tables):
    text = plans.formatted(R.revenue_by_method(tables), "formatted")
    schemas = [line for line in text.splitlines() if "ReadSchema" in line]
    assert schemas and all("passenger" not in s for s in schemas)
    assert any("struct<booking_id" in s or "struct<payment_id" in s for s in schemas)
