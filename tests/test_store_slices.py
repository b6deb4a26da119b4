"""Large buckets are written by several tasks; logs keep no checkpoints and number rows across batches."""

import os

import pyarrow as pa
import pytest
from helpers import make_tables, passenger

from airops.operators.commands import fold
from airops.sources import store


def test_a_large_bucket_is_dealt_to_several_files(spark, tmp_path):
    t = make_tables(spark, passengers=[passenger(k) for k in range(200)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        s = store.create_store({"passengers": t["passengers"]}, str(tmp_path / "s"), 1)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    commit = s.entries["passengers"][0][0]
    files = [f for f in os.listdir(tmp_path / "s" / "passengers" / commit / "bucket=0") if f.endswith(".parquet")]
    assert len(files) > 1
    assert sorted(map(str, s.tables["passengers"].collect())) == sorted(map(str, t["passengers"].collect()))


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_blocks_are_numbered_across_arrow_batches(monkeypatch, size):
    import pyspark

    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return 2

    monkeypatch.setattr(pyspark, "TaskContext", Context)
    keys = ["a"] * 11 + ["b"] + ["c"] * 4 + ["d"] * 9
    batches = [pa.RecordBatch.from_pydict({"k": keys[i:i + size]}) for i in range(0, len(keys), size)]
    got = [n for b in fold._numbered("k", 4)(iter(batches)) for n in b.column(1).to_pylist()]
    want, block, last, held = [], (2 << 32) - 1, None, 0
    for k in keys:
        if k != last or held == 4:
            block, last, held = block + 1, k, 0
        held += 1
        want.append(block)
    assert got == want


def test_a_log_is_answered_without_checkpoints(spark, tables, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from airops.operators.commands.log import apply_commands

    def refused(*_):
        raise AssertionError("rows are written whole")

    monkeypatch.setattr(DataFrame, "checkpoint", refused)
    out, _ = apply_commands(tables, tables.extra("command_log").limit(20))
    assert out.count() == 20
