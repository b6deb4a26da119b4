"""Command batches over a stream of requests.

The command operators are plain DataFrame functions, so a Structured
Streaming query can apply them per micro-batch with ``foreachBatch``: each
micro-batch is one batch of requests against the current snapshot; its
outcomes and the tables after it are written per epoch, so that an epoch that
is tried again gives the same files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from airops.sources.store import commit_batch, open_store
from airops.sources.tables import Tables, read_marker, write_marker, write_snapshot


def command_sink(command: Callable, snapshot: Callable[[], Tables], outcomes_path: str,
                 snapshot_path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function applying ``command(tables, batch)``.

    ``snapshot()`` returns the tables to apply the batch to (the latest complete
    version before this epoch). Outcomes go to ``<outcomes_path>/epoch=<id>``,
    the whole new snapshot to ``<snapshot_path>/v<epoch>``, both overwritten
    when an epoch is tried again; ``<snapshot_path>/v<epoch>/_DONE`` is written
    last, and an epoch that has it is not applied again."""
    def run(batch: DataFrame, epoch_id: int) -> None:
        done = f"{snapshot_path.rstrip('/')}/v{epoch_id}/_DONE"
        if read_marker(batch.sparkSession, done) is not None:
            return
        t = snapshot()
        out, changed = command(t, batch)
        out.write.mode("overwrite").parquet(f"{outcomes_path.rstrip('/')}/epoch={epoch_id}")
        write_snapshot(t.replace(**changed), snapshot_path, epoch_id, mode="overwrite")
        write_marker(batch.sparkSession, done, str(epoch_id))
    return run


def store_sink(command: Callable, store_path: str, outcomes_path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function applying ``command(tables, batch)`` to the newest
    version of a store (``sources.store``) and publishing only the buckets that
    the batch changed. The version carries the epoch, so that an epoch that was
    published is not applied again; outcomes are overwritten when one is retried."""
    def run(batch: DataFrame, epoch_id: int) -> None:
        base = open_store(batch.sparkSession, store_path)
        if base.tag is not None and int(base.tag) >= epoch_id:
            return
        out, changed = command(base.tables, batch)
        out.write.mode("overwrite").parquet(f"{outcomes_path.rstrip('/')}/epoch={epoch_id}")
        commit_batch(base, changed, str(epoch_id))
    return run
