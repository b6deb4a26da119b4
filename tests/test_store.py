"""Bucketed snapshots: touched buckets only, stale bases, emptied buckets, streams."""

import os

import pytest
from helpers import make_tables, passenger
from pyspark.sql import functions as F

from airops.operators.commands import booking_flow as BF
from airops.operators.commands import passengers as PC
from airops.schema import TABLES
from airops.sources import store
from airops.streaming import store_sink


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture()
def stored(tables, tmp_path):
    return store.create_store(tables, str(tmp_path / "store"), 8)


def commits(s, name):
    return {k: c for k, (c, _, _) in s.entries[name].items()}


def test_a_one_booking_batch_writes_one_bucket_a_table(spark, tables, stored):
    for name in TABLES:
        assert rows(stored.tables[name]) == rows(tables[name]), name
    batch = tables.extra("cancel_requests").join(
        tables["bookings"].where("status = 'Confirmed'").select("booking_id"), "booking_id", "left_semi").select(
        tables.extra("cancel_requests").columns).where("cancel_reason is not null").orderBy("request_id").limit(1)
    out, changed = BF.cancel_bookings(stored.tables, batch)
    assert out.first().accepted
    after = store.commit_batch(stored, changed)
    assert after.version == 1
    for name in TABLES:
        old, new = commits(stored, name), commits(after, name)
        written = [k for k in new if new[k] != old.get(k)]
        assert len(written) <= 1, name
        if name in changed:
            assert rows(after.tables[name]) == rows(changed[name])
            if written:
                folder = f"{stored.path}/{name}/{new[written[0]]}"
                assert [d for d in os.listdir(folder) if d.startswith("bucket=")] == [f"bucket={written[0]}"]
        else:
            assert not written
    assert [k for k, c in commits(after, "bookings").items() if c != commits(stored, "bookings")[k]]
    # the base is still there to be read
    assert rows(store.open_store(spark, stored.path, 0).tables["bookings"]) == rows(tables["bookings"])


def test_a_stale_base_is_refused(spark, tables, stored, monkeypatch):
    changed = {"airports": stored.tables["airports"].withColumn("city", F.lit("X"))}
    store.commit_batch(stored, changed)
    with pytest.raises(store.StaleSnapshot):
        store.commit_batch(stored, {"airports": stored.tables["airports"].withColumn("city", F.lit("Y"))})
    # a rival that is published while a batch is being written wins as well
    base = store.open_store(spark, stored.path)
    monkeypatch.setattr(store, "latest_version", lambda *_: base.version)
    store.commit_batch(base, {"airports": base.tables["airports"].withColumn("city", F.lit("Z"))})
    with pytest.raises(store.StaleSnapshot):
        store.commit_batch(base, {"airports": base.tables["airports"].withColumn("city", F.lit("W"))})
    monkeypatch.undo()
    assert {r.city for r in store.open_store(spark, stored.path).tables["airports"].collect()} == {"Z"}


def test_emptied_buckets_nulls_and_no_rows(spark, tmp_path):
    t = make_tables(spark, passengers=[passenger(k) for k in range(5)])
    s = store.create_store(t, str(tmp_path / "s"), 4)
    assert s.tables["bookings"].count() == 0
    _, changed = PC.delete_passengers(s.tables, spark.createDataFrame(
        [(k, None, k) for k in range(5)], "request_id bigint, requested_at timestamp_ntz, passenger_id bigint"))
    gone = store.commit_batch(s, changed)
    assert gone.tables["passengers"].count() == 0 and gone.entries["passengers"] == {}
    # a value that moves between columns beside a null is a change
    a = t["passengers"].withColumns({"nationality": F.lit("a"), "phone": F.lit(None).cast("string")})
    b = t["passengers"].withColumns({"nationality": F.lit(None).cast("string"), "phone": F.lit("a")})
    first = store.commit_batch(gone, {"passengers": a})
    second = store.commit_batch(first, {"passengers": b})
    assert rows(second.tables["passengers"]) == rows(b)
    same = store.commit_batch(second, {"passengers": b})
    assert same.version == second.version + 1 and same.entries == second.entries


def test_a_stream_publishes_epochs_once(spark, tables, stored, tmp_path):
    requests = tables.extra("cancel_requests")
    sink = store_sink(BF.cancel_bookings, stored.path, str(tmp_path / "outcomes"))
    sink(requests, 0)
    sink(requests, 0)
    now = store.open_store(spark, stored.path)
    assert (now.version, now.tag) == (1, "0")
    _, changed = BF.cancel_bookings(tables, requests)
    assert rows(now.tables["bookings"]) == rows(changed["bookings"])
