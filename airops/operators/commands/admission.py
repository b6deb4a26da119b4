"""First-come admission under two unique keys, distributed.

Requests are processed in order; a request is admitted unless an earlier
admitted request holds one of its two keys (a passport or an e-mail). A rejected
request holds nothing, so a request rejected on one key must not block a later
request on the other: the result is the greedy matching in request order, not
two independent "first per key" tests.

Requests whose keys nobody else names are admitted at once. The others form
components: requests that share a key, directly or through others, decide one
another, and components do not. Components are found by large and small stars
(rounds grow with the logarithm of a chain), and each is decided in order inside
a task, by a fold in blocks (``fold.py``), so that a chain of a thousand requests
takes as many rounds as a chain of two, and a component with most of the requests
is walked by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airops.operators.commands.fold import _kept, fold_in_blocks


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Edges (a, b), a > b, after linking the larger (or the smaller) neighbours of
    each node, and the node itself, to its least neighbour."""
    near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if larger:
        near = near.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = _kept(near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
    out = near.join(least, "u").where("v > u" if larger else "v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not larger:
        out = out.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of a task as stars to the least node of what they connect."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    stars = [(n, root(n)) for n in list(up)]
    yield pd.DataFrame([(n, r) for n, r in stars if n != r], columns=["a", "b"]).astype("int64")


def key_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b) but the least of each component."""
    def print_of(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    now = _kept(edges.mapInPandas(_contracted, "a bigint, b bigint"), "edges")
    was, is_ = None, print_of(now)
    while is_ != was:  # until a round changes nothing: then each node points to its root
        now = _kept(_star(_star(now, True), False).mapInPandas(_contracted, "a bigint, b bigint"), "edges")
        was, is_ = is_, print_of(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _walk(state: list | None, g: pd.DataFrame):
    taken, admitted = set(state or []), []
    for rid, k1, k2 in zip(g["_rid"].tolist(), g["_k1"].tolist(), g["_k2"].tolist()):
        if k1 not in taken and k2 not in taken:
            taken.update((k1, k2))
            admitted.append(rid)
    return pd.DataFrame({"_rid": admitted}), sorted(taken)


def greedy_admission(cands: DataFrame, key1: list[str], key2: list[str],
                     order: str = "_ord", rid: str = "request_id") -> DataFrame:
    """Return ``(rid,)`` of the admitted candidates.

    ``cands`` has one row per request with ``rid``, ``order`` (a struct of time ``ts``
    and id, or a plain sortable column; ties by ``rid``) and the key columns;
    requests failing static checks must already be removed."""
    at = f"{order}.ts" if isinstance(cands.schema[order].dataType, T.StructType) else order
    keyed = _kept(cands.select(
        F.col(rid).alias("_rid"), F.col(at).alias("_ts"),
        F.concat(F.lit("1"), F.to_json(F.struct(*key1))).alias("_k1"),
        F.concat(F.lit("2"), F.to_json(F.struct(*key2))).alias("_k2")), "candidates")
    names = keyed.select(F.col("_k1").alias("k")).union(keyed.select("_k2"))
    shared = _kept(names.groupBy("k").count().where("count > 1").select("k"), "shared-keys")
    on1, on2 = (shared.select(F.col("k").alias(c), F.lit(True).alias(f"_s{c}")) for c in ("_k1", "_k2"))
    marked = _kept(keyed.join(on1, "_k1", "left").join(on2, "_k2", "left").select(
        "_rid", "_ts", "_k1", "_k2", F.coalesce(F.col("_s_k1") | F.col("_s_k2"), F.col("_s_k1"), F.col("_s_k2"),
                                                F.lit(False)).alias("_shared")), "marked")
    open_ = marked.where("_shared").withColumn("_a", F.xxhash64("_k1"))
    root = _kept(key_components(open_.select(F.col("_a").alias("a"), F.xxhash64("_k2").alias("b"))), "components")
    placed = open_.join(root.withColumnRenamed("node", "_a"), "_a", "left").select(
        "_rid", "_ts", "_k1", "_k2", F.coalesce("root", "_a").alias("_component"))
    out = T.StructType([T.StructField("_rid", keyed.schema["_rid"].dataType)])
    walked = fold_in_blocks(placed, "_component", ["_ts", "_rid"], _walk, out)
    return marked.where("not _shared").select(F.col("_rid").alias(rid)).union(walked.select(F.col("_rid").alias(rid)))
