"""Passenger updates whose e-mail moves depend on one another, against a serial replay."""

import datetime as dt
import random

import pytest
from helpers import T0, make_tables, passenger
from replay import replay_update_passengers

from airops.operators.audits import EMAIL_PATTERN
from airops.operators.commands import admission, fold
from airops.operators.commands.passengers import update_passengers

REQUEST = ("request_id bigint, requested_at timestamp_ntz, passenger_id bigint, set_fields array<string>, "
           "full_name string, date_of_birth date, gender string, nationality string, phone string, email string")


def request(rid, second, pid, email, gender=None):
    fields = ["email"] + (["gender"] if gender is not None else [])
    return (rid, T0 + dt.timedelta(seconds=second), pid, fields, None, None, gender, None, None, email)


def compare(spark, emails, rows):
    t = make_tables(spark, passengers=[passenger(p, email=e) for p, e in emails.items()])
    req = spark.createDataFrame(rows, REQUEST)
    out, changed = update_passengers(t, req)
    got = {r.request_id: r.code for r in out.collect()}
    want = replay_update_passengers(emails, [r.asDict() for r in req.collect()], EMAIL_PATTERN)
    assert got == want
    after = dict(emails)
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        if want[r[0]] == 200 and r[9] is not None:
            after[r[2]] = r[9]
    assert {r.passenger_id: r.email for r in changed["passengers"].collect()} == after
    assert len(set(after.values())) == len(after)
    return want


def test_a_chain_of_a_thousand_moves_takes_few_rounds(spark, monkeypatch):
    # passenger k takes the address that passenger k + 1 leaves a second earlier
    n, rounds = 1000, []
    emails = {k: f"e{k}@x.org" for k in range(n)}
    rows = [request(k, n - k, k, f"e{k + 1}@x.org" if k + 1 < n else "free@x.org") for k in range(n)]
    star = admission._star
    monkeypatch.setattr(admission, "_star", lambda edges, larger: rounds.append(larger) or star(edges, larger))
    want = compare(spark, emails, rows)
    assert set(want.values()) == {200}
    assert len(rounds) <= 2 * 12


def test_the_reverse_order_rejects_all_but_the_last(spark):
    n = 300
    emails = {k: f"e{k}@x.org" for k in range(n)}
    rows = [request(k, k, k, f"e{k + 1}@x.org" if k + 1 < n else "free@x.org") for k in range(n)]
    want = compare(spark, emails, rows)
    assert [k for k, code in want.items() if code == 200] == [n - 1]


@pytest.mark.parametrize("seed,block", [(1, 50_000), (2, 60)])
def test_random_moves_equal_a_serial_replay(spark, monkeypatch, seed, block):
    monkeypatch.setattr(fold, "BLOCK_ROWS", block)
    rng = random.Random(seed)
    emails = {k: f"e{k}@x.org" for k in range(60)}
    rows = [request(k, rng.randint(0, 80), rng.choice((0, 0, rng.randint(0, 64))),
                    rng.choice((f"e{rng.randint(0, 40)}@x.org", f"n{rng.randint(0, 12)}@x.org", "hot@x.org", "bad", None)),
                    rng.choice((None, None, "Male", "Robot", ""))) for k in range(250)]
    want = compare(spark, emails, rows)
    assert {200, 404, 409, 422, 500} == set(want.values())


def test_requests_that_share_nothing_are_decided_by_the_snapshot(spark):
    emails = {1: "a@x.org", 2: "b@x.org", 3: "c@x.org"}
    want = compare(spark, emails, [request(1, 0, 1, "b@x.org"), request(2, 0, 3, "c@x.org"), request(3, 0, 9, "z@x.org")])
    assert want == {1: 409, 2: 200, 3: 404}


def test_a_batch_without_requests(spark):
    assert compare(spark, {1: "a@x.org"}, []) == {}
