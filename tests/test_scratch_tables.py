"""Command batches leave only the scratch tables that their results read."""

import os
import re

from airops.operators.commands.bookings_admit import admit_bookings
from airops.operators.commands.log import apply_commands
from airops.session import scratch_path


def tables_left(spark, run):
    folder = re.sub("^file:/*", "/", scratch_path(spark, ""))
    before = set(os.listdir(folder))
    out = run()
    left = {x for x in set(os.listdir(folder)) - before if re.search("-[0-9a-f]{32}$", x)}  # not the derived snapshot
    return out, sorted(re.sub("-[0-9a-f]{32}$", "", x) for x in left)


def test_a_log_keeps_no_tables_of_its_way(spark, tables):
    log = tables.extra("command_log")
    (out, changed), left = tables_left(spark, lambda: apply_commands(tables, log))
    assert left == ["airops-decided", "airops-known", "airops-targets"]
    assert out.count() == log.count()
    assert changed["seats"].count() == tables["seats"].count()


def test_admission_keeps_its_decisions_only(spark, tables):
    requests = tables.extra("booking_requests")
    (out, _), left = tables_left(spark, lambda: admit_bookings(tables, requests))
    assert left == ["airops-decided"]
    assert out.count() == requests.count()
