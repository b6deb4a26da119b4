"""Plans and helpers that must not grow with the square of a key, or shuffle twice."""

import datetime as dt

from pyspark.sql import functions as F

from helpers import T0, make_tables, passenger

from airops import plans
from airops.operators import audits, reports, views
from airops.operators.commands.admission import greedy_admission
from airops.operators.commands.passengers import update_passengers
from airops.session import ship_code


def test_foreign_keys_are_shuffled_once(tables):
    text = plans.formatted(audits.audit_foreign_keys(tables), "simple")
    assert "hashpartitioning(parent" in text
    assert "hashpartitioning(fid" not in text.split("LeftAnti")[1]


def test_histories_and_documents_have_no_global_sort(tables):
    for df in (views.travel_history(tables), views.flight_manifest(tables), reports.revenue_report(tables),
               reports.revenue_report_rows(tables)):
        assert "rangepartitioning" not in plans.formatted(df, "simple")


def test_unique_keys_cross_the_shuffle_as_hashes(tables):
    text = plans.formatted(audits.audit_unique(tables), "simple")
    assert "keys=[cid" in text and "LeftSemi" in text


def test_whole_keys_are_not_shuffled_to_find_repeats(spark, tables):
    text = plans.formatted(audits.audit_unique(tables), "simple")
    assert all("BroadcastHashJoin" in line for line in text.splitlines() if "LeftSemi" in line)
    assert "Aggregate" not in text.split("LeftSemi", 1)[1]


def test_address_holder_before_each_request(spark):
    """Against a walk of all requests: a hot address, ties in time, own addresses set again."""
    at = lambda i: T0 + dt.timedelta(minutes=i % 7)
    reqs = [(i, at(i), i % 10, ["email"], "hot@x.org" if i % 3 else f"k{i % 20}@x.org") for i in range(60)]
    t = make_tables(spark, passengers=[passenger(k) for k in range(10)])
    r = spark.createDataFrame(reqs, "request_id long, requested_at timestamp_ntz, passenger_id long, "
                              "set_fields array<string>, email string")
    for c, kind in (("full_name", "string"), ("date_of_birth", "date"), ("gender", "string"),
                    ("nationality", "string"), ("phone", "string")):
        r = r.withColumn(c, F.lit(None).cast(kind))
    out, changed = update_passengers(t, r)
    holds, want = {k: f"p{k}@x.org" for k in range(10)}, {}
    for rid, _, pid, _, email in sorted(reqs, key=lambda x: (x[1], x[0])):
        taken = any(p != pid and e == email for p, e in holds.items())
        want[rid] = 409 if taken else 200
        holds[pid] = holds[pid] if taken else email
    assert {x.request_id: x.code for x in out.collect()} == want and {200, 409} <= set(want.values())
    assert {x.passenger_id: x.email for x in changed["passengers"].collect()} == holds


def test_admission_of_a_chain_and_of_nothing(spark):
    """Request i holds the keys (i // 2, (i + 1) // 2): every other one is admitted."""
    spark_rows = spark.range(24).select(
        F.col("id").alias("request_id"), F.col("id").alias("_ord"), F.floor(F.col("id") / 2).alias("a"),
        F.floor((F.col("id") + 1) / 2).alias("b"))
    got = sorted(x.request_id for x in greedy_admission(spark_rows, ["a"], ["b"]).collect())
    assert got == list(range(0, 24, 2))
    assert greedy_admission(spark_rows.where("a < 0"), ["a"], ["b"]).count() == 0


def test_code_is_shipped_once(spark):
    ship_code(spark)
    ship_code(spark)
    assert sum(f.startswith("airops-code-") for f in spark.sparkContext._python_includes) == 1


def test_lookups_of_a_batch_are_done_once(spark, tables):
    """The requests are looked up in the snapshot once, not again for the first of each booking."""
    from airops.operators.commands import booking_flow as flow
    for batch, run in (("payment_requests", flow.process_payments), ("cancel_requests", flow.cancel_bookings),
                       ("boarding_events", flow.record_boarding)):
        out, _ = run(tables, tables.extra(batch))
        text = plans.formatted(out, "simple")
        assert text.count("Join") == 1 and "LeftSemi" not in text, batch
