"""Connected components of large graphs, and sorted groups inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airops.llm.common import written
from airops.session import drop_tables, temporary

_EDGES = "a bigint, b bigint"


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows with equal ``keys``, from batches sorted by them."""
    left: pd.DataFrame | None = None
    for pdf in batches:
        if left is not None:
            pdf = pd.concat([left, pdf], ignore_index=True)
        new = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
        starts = new.nonzero()[0]
        for a, b in zip(starts[:-1], starts[1:]):
            yield pdf.iloc[a:b]
        left = pdf.iloc[starts[-1]:] if len(starts) else None
    if left is not None and len(left):
        yield left


def _contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges replaced by stars to the least node of what this task connects."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    rows = [(n, r) for n in parent if (r := root(n)) != n]
    yield pd.DataFrame(rows, columns=["a", "b"]).astype("int64")


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Links the larger (or the smaller) neighbours of each node, and the node
    itself, to its least neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if larger:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # written first: then the planner can split the rows of a node with many neighbours
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
    joined = both.join(least, "u")
    if larger:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b) that is not the least of its
    component; ``root`` is that least node. Alternates contraction inside tasks
    with large and small stars over the shuffle, which ends in a number of
    rounds that grows with the logarithm of the longest path; each round is
    written, and the edges never leave the executors."""
    def stamp(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    with temporary() as keep:
        now = written(edges.mapInPandas(_contracted, _EDGES), "edges")
        was, is_ = None, stamp(now)
        while is_ != was:
            now, before = written(_star(_star(now, True), False).mapInPandas(_contracted, _EDGES), "edges"), now
            drop_tables(before)
            was, is_ = is_, stamp(now)
        keep(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
