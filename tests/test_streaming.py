"""A command batch applied per micro-batch of a request stream (foreachBatch)."""

import os

from airops.operators.commands import booking_flow as BF
from airops.streaming import command_sink


def test_cancel_requests_stream(spark, tables, tmp_path):
    reqs = tables.extra("cancel_requests")
    src = str(tmp_path / "requests")
    reqs.write.parquet(src)
    outcomes, snaps = str(tmp_path / "outcomes"), str(tmp_path / "snapshots")
    stream = spark.readStream.schema(reqs.schema).parquet(src)
    q = (stream.writeStream.foreachBatch(command_sink(BF.cancel_bookings, lambda: tables,
                                                      outcomes, snaps))
         .option("checkpointLocation", str(tmp_path / "ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.read.parquet(outcomes).drop("epoch")  # outcomes are kept by epoch
    assert got.count() == reqs.count()
    batch, _ = BF.cancel_bookings(tables, reqs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    assert any(d.startswith("v") for d in os.listdir(snaps))
