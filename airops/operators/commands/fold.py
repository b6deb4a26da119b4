"""Ordered folds over hot keys: blocks of a key are walked by many tasks.

A fold decides the rows of a key one after the other, each against the state
that the earlier ones left. Rows are range-partitioned by key and order and cut
into blocks of bounded size, so that a key with a third of all rows is many
blocks, not one task. In the first round every block is folded from the state
before the batch; where a block's predecessor left another state than the one
that it was folded from, it is folded again in the next round. A decision depends
on earlier rows only, so that after ``r`` rounds the first ``r`` blocks of each key
are right, and nothing is left when no state has changed: keys of one block
take one round, and a key of many blocks as many as its states need to settle
(in most logs two or three, as states forget or saturate).

Blocks are numbered once and written to the shared scratch folder; so are the
results of a round (tables that are read again have the sizes of their files,
where checkpoints would carry estimates that multiply from round to round), and
dropped when the next round has been written. A lost executor repeats single blocks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airops.session import drop_tables, scratch_table, temporary

#: Rows of a block, at most.
BLOCK_ROWS = 50_000


def _kept(df: DataFrame, name: str) -> DataFrame:
    return scratch_table(df, f"airops-{name}", compression="zstd")


def _numbered(key: str, block_rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        block, last, held = (TaskContext.get().partitionId() << 32) - 1, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            starts = np.append(keys[0] != last, keys[1:] != keys[:-1])
            at = np.arange(len(keys))
            first = np.maximum.accumulate(np.where(starts, at, -1))
            # the place in its run of the key; a run may have begun in an earlier batch
            place = np.where(first < 0, at + held, at - first)
            numbers = block + np.cumsum(place % block_rows == 0)
            block, last, held = int(numbers[-1]), keys[-1], int(place[-1]) % block_rows + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())],
                                             names=[*batch.schema.names, "_block"])
    return run


def _folded(key: str, fold: Callable, out: list[str]) -> Callable:
    names = [key, "_block", "_out", *out]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        done: dict[str, list] = {c: [] for c in names}

        def finish() -> None:
            g = held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
            held.clear()
            before = g["_in"].iat[0]
            got, state = fold(json.loads(before) if before else None, g)
            got = {c: got[c] if isinstance(got[c], list) else got[c].tolist() for c in out}
            n = len(got[out[0]])
            # the rows of results, then the row of the state
            done[key] += [g[key].iat[0]] * (n + 1)
            done["_block"] += [g["_block"].iat[0]] * (n + 1)
            done["_out"] += [None] * n + [json.dumps(state, sort_keys=True)]
            for c in out:
                done[c] += [*got[c], None]

        def taken() -> pd.DataFrame:
            # plain objects: rows of results and the row of the state go to one Arrow batch type
            pdf = pd.DataFrame(done, dtype=object)
            done.update({c: [] for c in names})
            return pdf

        for pdf in batches:
            starts = (pdf["_block"] != pdf["_block"].shift()).to_numpy().nonzero()[0].tolist() + [len(pdf)]
            for a, b in zip(starts[:-1], starts[1:]):
                if held and held[0]["_block"].iat[0] != pdf["_block"].iat[a]:
                    finish()
                held.append(pdf.iloc[a:b])
            yield taken()
        if held:
            finish()
            yield taken()
    return run


def fold_in_blocks(rows: DataFrame, key: str, order: list[str], fold: Callable, out: T.StructType,
                   block_rows: int | None = None) -> DataFrame:
    """``fold(state, block) -> (rows of out, state)`` over the rows of each ``key``
    in ``order`` (unique within a key); the rows are a frame or lists by column.

    ``state`` is what JSON holds, None before the first row of a key; a block is a
    pandas frame. ``key`` must not be null. Returns the columns of ``out``."""
    with temporary() as keep:
        return keep(_rounds(rows, key, order, fold, out, block_rows)).where("_out is null").select(out.names)


def _rounds(rows: DataFrame, key: str, order: list[str], fold: Callable, out: T.StructType, block_rows: int | None) -> DataFrame:
    """The results of the blocks, and the states they leave (``_out``), as a written table."""
    types = T.StructType([T.StructField("_block", T.LongType()), *rows.schema.fields])
    dealt = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    names = rows.columns
    blocks = _kept(dealt.mapInArrow(_numbered(key, block_rows or BLOCK_ROWS),
                                     T.StructType([*types.fields[1:], types.fields[0]])), "blocks")
    ahead = Window.partitionBy(key).orderBy("_block")
    # one row for each block of a key that has several
    chain = _kept(blocks.select(key, "_block").distinct().withColumn("_prev", F.lag("_block").over(ahead)).where(
        "_prev is not null"), "chain")
    result_type = T.StructType([rows.schema[key], T.StructField("_block", T.LongType()),
                                T.StructField("_out", T.StringType()), *out.fields])
    step = _folded(key, fold, out.names)

    def folded(todo: DataFrame) -> DataFrame:
        return _kept(todo.repartition(key, "_block").sortWithinPartitions("_block", *order).select(
            "_in", "_block", *names).mapInPandas(step, result_type), "folded")

    result = folded(blocks.withColumn("_in", F.lit(None).cast("string")))
    used = chain.select("_block", F.lit(None).cast("string").alias("_in"))
    while True:
        ends = result.where("_out is not null").select(F.col("_block").alias("_prev"), F.col("_out").alias("_in"))
        now = _kept(chain.join(ends, "_prev").select("_block", "_in"), "states")
        changed = _kept(now.join(used.withColumnRenamed("_in", "_was"), "_block").where("not (_in <=> _was)").select(
            "_block", "_in"), "changed")
        if changed.isEmpty():
            break
        again = folded(blocks.join(changed, "_block"))
        before, result = result, _kept(result.join(changed.select("_block"), "_block", "left_anti").select(
            again.columns).unionByName(again), "folded")
        drop_tables(before, again)
        used = now
    return result
