"""Pages far down a listing against the plain sorted page."""

import random
import re

import pytest
from pyspark.sql import functions as F

from airops import plans
from airops.operators import listings as L


@pytest.fixture()
def shallow(monkeypatch):
    monkeypatch.setattr(L, "DEEP_ROWS", 100)


@pytest.mark.parametrize("desc", [True, False])
@pytest.mark.parametrize("kind", ["string", "timestamp_ntz", "decimal(12,3)"])
def test_pages_with_ties_and_nulls_equal_the_sorted_rows(spark, shallow, desc, kind):
    rng = random.Random(5)
    make = {"string": lambda: rng.choice(("é", "Zed", "ab", "a", "", "ab c")) + str(rng.randint(0, 30)),
            "timestamp_ntz": lambda: f"2024-03-{rng.choice((10, 31))} 02:{rng.randint(10, 59)}:00.{rng.randint(1, 3)}",
            "decimal(12,3)": lambda: str(rng.randint(-50, 50) / 8)}[kind]
    rows = [(make() if rng.random() < 0.8 else None, i) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, id bigint").withColumn("k", F.col("k").cast(kind)).repartition(5).cache()
    want = df.orderBy(F.desc("k") if desc else F.asc("k"), "id").collect()
    for skip in (0, 95, 700, 1490, 1500, 5000):
        got = L.page(df, "k", "id", desc, skip, 20).collect()
        assert got == want[skip:skip + 20], skip


def test_one_key_for_all_rows(spark, shallow):
    df = spark.range(3000).withColumn("k", F.lit("same"))
    assert [r.id for r in L.page(df, "k", "id", True, 2345, 50).collect()] == list(range(2345, 2395))


def test_a_deep_page_holds_few_rows(spark, tables, shallow):
    skip = tables["bookings"].count() - 200
    deep = L.list_bookings(tables, skip=skip)
    held = [int(n) for n in re.findall(r"TakeOrderedAndProject\(limit=(\d+)", plans.formatted(deep, "simple"))]
    assert held and max(held) <= L.DEEP_ROWS + L.DEFAULT_LIMIT < skip
    want = tables["bookings"].orderBy(F.desc("booked_at"), "booking_id").offset(skip).limit(50)
    assert deep.collect() == want.collect()


def test_no_rows(spark, shallow):
    df = spark.createDataFrame([], "k string, id bigint")
    assert L.page(df, "k", "id", False, 1000, 50).count() == 0
