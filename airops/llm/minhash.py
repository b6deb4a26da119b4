"""Near-duplicate documents by bottom-k sketches from one hash function.

Each document's set of word shingles keeps its ``SKETCH`` least hash values.
Documents with equal sets are one class. Inverted lists of retained values
bring classes together: two sketches that agree in ``LEAST`` values must share
one of the first ``SKETCH - LEAST + 1`` values of either, by rising frequency
(ties by value), so only those are listed, and a value of a common passage is
listed last. Inside a list the sketch of the union of two sets (the least
values of both sketches) estimates their Jaccard similarity; pairs that reach
``LEAST`` of ``SKETCH`` connect classes to candidate groups. A pair of
similarity 0.85 misses that with a probability below 0.0001, a closer one with
less. Inside a group exact similarities on the full sets decide.

Nothing grows with the square of a group in rows: lists and groups are cut into
blocks, each pair of blocks is compared in numpy by one task, and a task sends
on a spanning forest of the links that it found, not the links.

Defined cases: a null or empty text has an empty set and is linked with nothing;
a text with fewer words than a shingle is one shingle of all; rows with the
same id and text are the same document and both stay in ``drop_near_duplicates``;
a null id comes after all others when a group's first is taken; an empty table
gives no rows; ``near_duplicates`` ignores other columns and
``drop_near_duplicates`` keeps them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airops.llm import textops
from airops.llm.common import bound_batches, fresh_names, read_table, schema, written
from airops.llm.graphs import components, runs

SHINGLE, SKETCH, LEAST = 5, 32, 18
#: Classes of one block of an inverted list, and of a candidate group.
LIST_BLOCK, GROUP_BLOCK = 1024, 512
_END = np.uint64(2 ** 64 - 1)


def least_common(size: np.ndarray, percent: int) -> np.ndarray:
    """Values that two similar sketches share at least, given the smaller size
    (or the size of their union). Up to the first bound the sketch of any similar
    set is the whole set, and the number is exact."""
    return np.where(size > SKETCH * percent // 100, LEAST * percent // 85, -(-percent * size // 100))


def sketch_texts(texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(set size, class, the least values as sorted 64-bit integers) of each text."""
    for lo, hi in textops.steps(texts):
        w = textops.Words(texts[lo:hi])
        every = textops.windows_hash(w.hash, SHINGLE)
        for i in range(hi - lo):
            s = np.unique(textops.shingles(w, i, SHINGLE, every))
            # the class: a hash of the whole set
            both = textops.mix(s + np.arange(1, len(s) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            yield len(s), int(textops.mix(np.array([both.sum() + np.uint64(len(s))]))[0].astype(np.int64)), \
                s[:SKETCH].tobytes()


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(textops.shingles(textops.Words([text]), 0, SHINGLE))


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        got = list(sketch_texts(textops.as_bytes(pdf["text"], fold=True)))
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "text_key": pdf["text_key"], "n_shingles": [g[0] for g in got],
                            "node": [g[1] for g in got], "low": [np.frombuffer(g[2], dtype=np.int64) for g in got]})


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: set size, class and sketch."""
    bound_batches(docs.sparkSession)
    picked = docs.select(docs[id_col].alias("doc_id"),
                         F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("text_key"),
                         docs[text_col].alias("text"))
    return picked.mapInPandas(_sketches, schema(
        ("doc_id", picked.schema["doc_id"].dataType), ("text_key", "bigint"), ("n_shingles", "bigint"),
        ("node", "bigint"), ("low", "array<bigint>")))


def inverted_lists(classes: DataFrame, percent: int) -> DataFrame:
    """(value, node): the classes under each value that two of them share, among
    each sketch's first values by rising frequency."""
    every = classes.select("node", F.size("low").alias("s"), F.explode("low").alias("value"))
    shared = every.groupBy("value").agg(F.count("*").alias("f")).where("f > 1")
    held = every.join(shared, "value")
    by_node = Window.partitionBy("node")
    placed = held.withColumn("alone", F.col("s") - F.count("*").over(by_node)).withColumn(
        "place", F.row_number().over(by_node.orderBy("f", "value")) + F.col("alone"))
    least = F.when(F.col("s") > SKETCH * percent // 100, F.lit(LEAST * percent // 85)).otherwise(
        F.ceil(F.col("s") * percent / 100))  # least_common
    return placed.where(F.col("place") <= F.col("s") - least + 1).select("value", "node")


def _blocked(df: DataFrame, key: str, block: int) -> DataFrame:
    """Rows of each key dealt to pairs of blocks ``i <= j`` of about ``block``
    rows; ``side`` is a row's own block. A key of one block stays as it is."""
    sizes = df.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1")
    cut = df.join(sizes, key).withColumn("__s", F.ceil(F.col("__n") / block).cast("int"))
    cut = cut.withColumn("side", F.pmod(F.xxhash64("node"), F.col("__s")).cast("int"))
    cut = cut.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__s") - 1)))
    return cut.withColumn("i", F.least("side", "__o")).withColumn("j", F.greatest("side", "__o")).drop(
        "__n", "__s", "__o")


def _by_block(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def spanning(n: int, near: Callable[[int], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the graph whose node ``v`` has the neighbours ``near(v)`` (a mask)."""
    free, out = np.ones(n, dtype=bool), []
    for first in range(n):
        if not free[first]:
            continue
        free[first] = False
        todo = [first]
        while todo and free.any():
            v = todo.pop()
            new = np.flatnonzero(near(v) & free).tolist()
            free[new] = False
            out += [(v, x) for x in new]
            todo += new
    return out


def estimated_near(low: np.ndarray, sizes: np.ndarray, side: np.ndarray, same_block: bool,
                   percent: int) -> Callable[[int], np.ndarray]:
    """Which classes' union sketches reach the least agreement with class ``v``."""
    n, k = low.shape
    values, ids = np.unique(low, return_inverse=True)
    ids = ids.reshape(n, k)
    full = low != _END
    count = full.sum(axis=1)
    at = np.full(len(values), -1, dtype=np.int16)
    order = np.arange(k, dtype=np.int16)

    def near(v: int) -> np.ndarray:
        mine = ids[v, :count[v]]
        at[mine] = order[:count[v]]
        place = at[ids]
        at[mine] = -1
        shared = (place >= 0) & full
        # the rank of a shared value in the union: its places less the shared ones before it
        rank = place + order - (np.cumsum(shared, axis=1, dtype=np.int16) - 1)
        union = np.minimum(k, count[v] + count - shared.sum(axis=1))
        close = (shared & (rank < k)).sum(axis=1) >= least_common(union, percent)
        close &= np.minimum(sizes, sizes[v]) * 100 >= percent * np.maximum(sizes, sizes[v])
        return close if same_block else close & (side != side[v])

    return near


def exact_near(sets: list[np.ndarray], side: np.ndarray, same_block: bool, percent: int,
               columns: int = 4096) -> Callable[[int], np.ndarray]:
    """Which sets are linked with set ``v``: exact similarities of all pairs of a
    block, from products of slices of the incidence matrix."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=n)
    row = np.repeat(np.arange(n), sizes)
    values, ids, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    keep = shared[ids]
    row, ids = row[keep], column[ids[keep]]
    common = np.zeros((n, n), dtype=np.float32)
    order = np.argsort(ids, kind="stable")
    row, ids = row[order], ids[order]
    for first in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(ids, (first, first + columns))
        part = np.zeros((n, columns), dtype=np.float32)
        part[row[a:b], ids[a:b] - first] = 1
        common += part @ part.T
    both = common.astype(np.int64)
    link = 100 * both >= percent * (sizes[:, None] + sizes - both)
    if not same_block:
        link &= side[:, None] != side
    return lambda v: link[v]


def _forest(key: str, near: Callable, percent: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in runs(batches, [key, "i", "j"]):
            if len(g) < 2:
                continue
            nodes = g["node"].to_numpy()
            found = spanning(len(g), near(g, g["side"].to_numpy(), bool(g["i"].iat[0] == g["j"].iat[0]), percent))
            if found:
                pairs = nodes[np.asarray(found)]
                yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})
    return run


def _near_sketches(g: pd.DataFrame, side: np.ndarray, same: bool, percent: int) -> Callable:
    low = np.full((len(g), SKETCH), _END, dtype=np.uint64)
    for r, x in enumerate(g["low"]):
        low[r, :len(x)] = np.asarray(x, dtype=np.int64).view(np.uint64)
    return estimated_near(low, g["n_shingles"].to_numpy(), side, same, percent)


def _near_sets(g: pd.DataFrame, side: np.ndarray, same: bool, percent: int) -> Callable:
    return exact_near([np.frombuffer(x, dtype=np.uint64) for x in g["shingles"]], side, same, percent)


_PAIR = "a bigint, b bigint"


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = textops.as_bytes(pdf.pop("text"), fold=True)
        yield pdf.assign(shingles=[shingle_set(t).tobytes() for t in texts])


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), n_shingles and component_id of
    every row, linking sets with 100 * intersection >= percent * union."""
    rows = written(sketches(docs, id_col, text_col), "sketches")
    first = F.min_by(F.struct("doc_id", "text_key"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    classes = written(rows.where("n_shingles > 0").groupBy("node").agg(
        first.alias("of"), F.first("n_shingles").alias("n_shingles"), F.first("low").alias("low")), "classes")
    lists = written(inverted_lists(classes, percent), "lists")
    listed = _blocked(lists, "value", LIST_BLOCK).join(classes.select("node", "n_shingles", "low"), "node")
    maybe = _by_block(listed, "value").mapInPandas(_forest("value", _near_sketches, percent), _PAIR)
    grouped = components(maybe)
    grouped = grouped.union(grouped.select("root", "root").distinct())  # the least node of a group is of it too
    # the texts of the groups' classes, one document each
    wanted = grouped.join(classes.select("node", "of.doc_id", "of.text_key"), "node").select(
        "node", "root", F.col("doc_id").alias("w_id"), F.col("text_key").alias("w_key"))
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).withColumn(
        "text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    held = texts.join(wanted, (F.col("text_key") == F.col("w_key")) & F.col("doc_id").eqNullSafe(F.col("w_id")))
    sets = held.select("node", "root", "text").mapInPandas(
        _sets, schema(("node", "bigint"), ("root", "bigint"), ("shingles", "binary")))
    sets = written(sets, "sets")
    linked = _by_block(_blocked(sets, "root", GROUP_BLOCK), "root").mapInPandas(
        _forest("root", _near_sets, percent), _PAIR)
    joined = components(linked)
    # the first document of each class, then of each component
    tops = classes.select("node", F.col("of.doc_id").alias("top")).join(joined, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    of_root = tops.groupBy("root").agg(F.min("top").alias("component_id"))
    of_node = tops.join(of_root, "root").select("node", "component_id")
    full = rows.select("doc_id", "text_key", "n_shingles", "node")
    return full.join(of_node, "node", "left").select(
        "doc_id", "text_key", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """One document of each group (the one with the least id), with all its columns."""
    names = docs.columns
    key, gone_id, gone_key = fresh_names(docs, "text_key", "gone_id", "gone_key")
    found = near_duplicates(docs, percent, id_col, text_col)
    gone = written(found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key)).distinct(), "duplicates")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(docs[text_col], F.lit(""))))
    left = keyed.join(gone, (F.col(key) == F.col(gone_key)) & F.col(f"`{id_col}`").eqNullSafe(F.col(gone_id)),
                      "left_anti")
    return left.select(*[F.col(f"`{n}`") for n in names])


def op5_minhash_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of ``documents`` at Jaccard 0.85 on five-word shingles."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id",
                        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
