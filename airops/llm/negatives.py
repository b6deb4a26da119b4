"""Hard negatives by an inverted multi-index over exact integer inner products.

Vectors become integers (``floor(256 * x)``). Each half of a vector has a
codebook of its own; a pair of codewords is a cell, and a cell's rows lie in
packed chunks. A row of cell (i, j) scores at most ``q1.c1[i] + |q1| r1[i] +
q2.c2[j] + |q2| r2[j]`` with a query, ``r`` being the greatest distance of any row
of the table to its half codeword, so the sums of two sorted lists of half-score
bounds, taken off a heap in descending order, order the cells (multi-sequence
search). A query is a set of windows: the ``k`` best rows of its own (or of any
other) label with scores from ``low`` to ``high``. It stops when the next cell's
bound lies under the k-th score found in each window, or under its lower end: then
the windows are certified, and the result is that of comparing all rows.

Positives are the one window of own label; each positive then opens a window
of other labels at a share of its score. Queries visit cells in rounds of growing
numbers; a round joins the packed cells with the queries that visit them, and
scores a chunk with all of them by one matrix product. Only the codebooks are
fitted on a bounded sample (``SAMPLE`` rows of least hash); every row is
indexed, and recall is 1 by construction.

Defined cases: rows with a null id, label or vector, or with a null or
non-finite component, take no part; shorter vectors are filled up with zeros;
equal rows (id, label, vector) count once, different rows of one id are rows of
their own, and none is a positive or negative of its own id; ties go to the
smaller id; scores beyond 64 bits are cut to them; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airops.llm.common import bound_batches, read_table, schema, smallest_hashes, written
from airops.llm.graphs import runs

#: Rows of a cell on average, rows of a chunk at most (about), codewords of a half at most.
CELL_ROWS, CHUNK_ROWS, CODEWORDS = 1024, 2048, 256
#: Rows that the codebooks are fitted on, and rounds of fitting.
SAMPLE, ROUNDS = 8192, 8
#: Cells that a query visits in the first round, and how the number grows.
FIRST_CELLS, GROWTH = 4, 8
_LOWEST, _HIGHEST = -(1 << 62), 1 << 62


# --- vectors as integers ----------------------------------------------------------

def usable(table: DataFrame, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
           ) -> DataFrame:
    """vec_id, label and vec (doubles) of the rows that take part."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull()
                       & finite).select(F.col(id_col).cast("bigint").alias("vec_id"),
                                        F.col(label_col).cast("bigint").alias("label"),
                                        F.col(vec_col).cast("array<double>").alias("vec"))


@dataclass
class Numbers:
    """How the table's vectors are held: components, and the types that hold
    them and the products of two vectors exactly."""
    dim: int
    held: str
    product: str

    @staticmethod
    def of(rows: DataFrame) -> "Numbers":
        dim, most = rows.agg(F.max(F.size("vec")), F.max(F.array_max(F.transform("vec", F.abs)))).first()
        dim, most = max(2, dim or 0), int(min(256.0 * (most or 0.0), 2.0 ** 62)) + 1
        exact = dim * most * most
        product = "float32" if exact < 1 << 24 else "float64" if exact < 1 << 53 else "int64" if exact < 1 << 63 else "object"
        return Numbers(dim, "int16" if most < 1 << 15 else "int64", product)

    def matrix(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(packed, dtype=self.held).reshape(-1, self.dim).astype(self.product)

    def scores(self, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
        out = rows @ queries.T
        return np.clip(out, -(1 << 63), (1 << 63) - 1).astype(np.int64) if self.product == "object" else out

    def limit(self, bounds: np.ndarray, like: np.ndarray) -> np.ndarray:
        """Integer bounds in the type of the scores; those beyond any score stay beyond."""
        beyond = {"float32": 1 << 24, "float64": 1 << 53}.get(self.product, _HIGHEST)
        return np.clip(bounds, -beyond, beyond).astype(like.dtype)


def _packed(numbers: Numbers) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            q = []
            for v in pdf.pop("vec"):
                x = np.zeros(numbers.dim)
                x[:len(v)] = np.clip(np.floor(256.0 * np.asarray(v, dtype=np.float64)), -2.0 ** 62, 2.0 ** 62)
                q.append(x.astype(numbers.held).tobytes())
            yield pdf.assign(q=q)
    return run


# --- the index --------------------------------------------------------------------

@dataclass
class MultiIndex:
    """Codebooks of both halves with their radii, and the non-empty cells."""
    numbers: Numbers
    centers: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    cells: np.ndarray


def codebook(points: np.ndarray, size: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Centers of k-means, started from points drawn far from those drawn before."""
    rng = np.random.default_rng(seed)
    if not len(points):
        return np.zeros((1, points.shape[1]))
    centers = points[rng.integers(len(points))][None]
    far = ((points - centers[0]) ** 2).sum(axis=1)
    while len(centers) < min(size, len(points)) and far.sum() > 0:
        new = points[rng.choice(len(points), p=far / far.sum())]
        centers = np.vstack([centers, new])
        far = np.minimum(far, ((points - new) ** 2).sum(axis=1))
    for _ in range(rounds):
        near = nearest(points, centers)[0]
        total = np.zeros_like(centers)
        np.add.at(total, near, points)
        many = np.bincount(near, minlength=len(centers))
        centers = np.where(many[:, None] > 0, total / np.maximum(many, 1)[:, None], centers)
    return centers


def nearest(points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest center of each point, and its distance."""
    at = ((centers ** 2).sum(axis=1) - 2.0 * (points @ centers.T)).argmin(axis=1)
    return at, np.sqrt(((points - centers[at]) ** 2).sum(axis=1))


def _celled(numbers: Numbers, centers: tuple[np.ndarray, np.ndarray]) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half = numbers.dim // 2
        for pdf in batches:
            x = np.frombuffer(b"".join(pdf["q"]), dtype=numbers.held).reshape(-1, numbers.dim).astype(np.float64)
            (i, r1), (j, r2) = nearest(x[:, :half], centers[0]), nearest(x[:, half:], centers[1])
            yield pdf.assign(i=i, j=j, r1=r1, r2=r2)
    return run


def _chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for g in runs(batches, ["cell", "chunk"]):
        yield pd.DataFrame({"cell": [int(g["cell"].iat[0])], "ids": [g["vec_id"].to_numpy(np.int64).tobytes()],
                            "labels": [g["label"].to_numpy(np.int64).tobytes()], "rows": [b"".join(g["q"])]})


def pack(rows: DataFrame) -> tuple[Numbers, DataFrame]:
    """The rows that take part (``usable``), each once, with integer vectors ``q``."""
    bound_batches(rows.sparkSession)
    numbers = Numbers.of(rows)
    packed = rows.mapInPandas(_packed(numbers), "vec_id bigint, label bigint, q binary")
    return numbers, written(packed.dropDuplicates(), "vectors")


def build(numbers: Numbers, packed: DataFrame) -> tuple[MultiIndex, DataFrame]:
    """Codebooks from a sample, and all rows filed under their cells, in chunks."""
    many = packed.count()
    size = min(CODEWORDS, max(2, int(np.ceil(np.sqrt(many / CELL_ROWS)))))
    sample = smallest_hashes(packed, SAMPLE, "vec_id", "q").select("q").toPandas()["q"]
    x = np.frombuffer(b"".join(sample), dtype=numbers.held).reshape(-1, numbers.dim).astype(np.float64)
    half = numbers.dim // 2
    centers = (codebook(x[:, :half], size), codebook(x[:, half:], size))
    columns = len(centers[1])
    filed = written(packed.mapInPandas(_celled(numbers, centers), schema(
        ("vec_id", "bigint"), ("label", "bigint"), ("q", "binary"), ("i", "int"), ("j", "int"), ("r1", "double"),
        ("r2", "double"))).withColumn("cell", F.col("i") * columns + F.col("j")), "cells")
    # a row for each cell: bounded by the codebooks
    sizes = written(filed.groupBy("cell", "i", "j").agg(
        F.count("*").alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")), "cell-sizes")
    found = sizes.toPandas()
    radii = []
    for center, at, r in ((centers[0], "i", "r1"), (centers[1], "j", "r2")):
        out = np.zeros(len(center))
        np.maximum.at(out, found[at].to_numpy(), found[r].to_numpy())
        radii.append(out)
    cells = np.zeros((len(centers[0]), columns), dtype=bool)
    cells[found["i"], found["j"]] = True
    dealt = filed.join(sizes.select("cell", "n"), "cell").withColumn(
        "chunk", F.pmod(F.xxhash64("vec_id", "q"), F.ceil(F.col("n") / CHUNK_ROWS)).cast("int"))
    chunks = dealt.select("cell", "chunk", "vec_id", "label", "q").repartition("cell", "chunk").sortWithinPartitions(
        "cell", "chunk", "vec_id").mapInPandas(_chunked, "cell int, ids binary, labels binary, rows binary")
    return MultiIndex(numbers, centers, tuple(radii), cells), written(chunks, "chunks")


# --- multi-sequence search ----------------------------------------------------------

def cells_by_bound(first: np.ndarray, second: np.ndarray, cells: np.ndarray) -> Iterator[tuple[float, int]]:
    """(bound, cell) of the non-empty cells by descending sums of the halves' bounds."""
    a, b = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    x, y, columns = first[a].tolist(), second[b].tolist(), len(b)
    heap, seen = [(-x[0] - y[0], 0, 0)], {(0, 0)}
    while heap:
        bound, i, j = heapq.heappop(heap)
        if cells[a[i], b[j]]:
            yield -bound, a[i] * columns + b[j]
        for i2, j2 in ((i + 1, j), (i, j + 1)):
            if i2 < len(x) and j2 < len(y) and (i2, j2) not in seen:
                seen.add((i2, j2))
                heapq.heappush(heap, (-x[i2] - y[j2], i2, j2))


def half_bounds(q: np.ndarray, centers: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """The most that a row of each codeword can add to the score, rounded up a little."""
    bound = centers @ q + np.sqrt((q ** 2).sum()) * radii
    return bound + 1e-9 * np.abs(bound) + 1e-6


def _visits(index: MultiIndex, seen: int, many: int) -> Callable:
    """The cells that queries visit next: a row for each cell and block of queries."""
    numbers, half = index.numbers, index.numbers.dim // 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            visits: dict[int, list[tuple[int, int, int]]] = {}
            vectors = [np.frombuffer(q, dtype=numbers.held).astype(np.float64) for q in pdf["q"]]
            ends = []
            for at, (q, lows, highs, floors) in enumerate(zip(vectors, pdf["low"], pdf["high"], pdf["floors"])):
                found = dict(floors) if floors is not None else {}
                lows = [max(low, found.get(w, low)) for w, low in enumerate(lows)]
                ends.append((lows, highs))
                order = cells_by_bound(half_bounds(q[:half], index.centers[0], index.radii[0]),
                                       half_bounds(q[half:], index.centers[1], index.radii[1]), index.cells)
                for bound, cell in itertools.islice(order, seen, seen + many):
                    windows = [w for w, low in enumerate(lows) if bound >= low]
                    if not windows:  # certified: no later cell reaches a window
                        break
                    visits.setdefault(cell, []).extend((at, w) for w in windows)
            rows = []
            for cell, who in visits.items():
                use = sorted({at for at, _ in who})
                place = {at: k for k, at in enumerate(use)}
                rows.append((cell, pdf["a"].iloc[use].tolist(), pdf["vec_id"].iloc[use].tolist(),
                             pdf["label"].iloc[use].tolist(), b"".join(pdf["q"].iloc[use]),
                             [place[at] for at, _ in who], [w for _, w in who],
                             [int(ends[at][0][w]) for at, w in who], [int(ends[at][1][w]) for at, w in who]))
            yield pd.DataFrame(rows, columns=["cell", "a", "vec_id", "label", "q", "at", "w", "low", "high"])
    return run


_VISIT = ("cell int, a array<bigint>, vec_id array<bigint>, label array<bigint>, q binary, at array<int>, w array<int>, "
          "low array<bigint>, high array<bigint>")
_FOUND = "a bigint, w int, score bigint, vec_id bigint"


def _scored(numbers: Numbers, same: bool, k: int) -> Callable:
    """The ``k`` best rows of a chunk for each window that visits it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                ids, labels = np.frombuffer(r.ids, dtype=np.int64), np.frombuffer(r.labels, dtype=np.int64)
                score = numbers.scores(numbers.matrix(r.rows), numbers.matrix(r.q))
                own = labels[:, None] == np.asarray(r.label)[None, :]
                use = (own if same else ~own) & (ids[:, None] != np.asarray(r.vec_id)[None, :])
                low, high = (numbers.limit(np.asarray(x, dtype=np.int64), score) for x in (r.low, r.high))
                at = np.asarray(r.at)
                for first in range(0, len(at), 256):
                    cut = at[first:first + 256]
                    part = score[:, cut]
                    fits = use[:, cut] & (part >= low[first:first + 256]) & (part <= high[first:first + 256])
                    for column in np.flatnonzero(fits.any(axis=0)):
                        rows = np.flatnonzero(fits[:, column])
                        best = rows[np.lexsort((ids[rows], -part[rows, column]))[:k]]
                        a, w = r.a[cut[column]], r.w[first + column]
                        out += [(a, w, int(s), int(i)) for s, i in zip(part[best, column], ids[best])]
            yield pd.DataFrame(out, columns=["a", "w", "score", "vec_id"])
    return run


def search(index: MultiIndex, chunks: DataFrame, queries: DataFrame, same: bool, k: int) -> DataFrame:
    """a, w, rank, score, vec_id: the ``k`` best rows in each window of the queries.

    ``queries`` has a (a number of its own), vec_id, label, q and the windows'
    ends ``low`` and ``high``, as arrays; ``same``: rows of the query's label,
    else of the others."""
    place = Window.partitionBy("a", "w").orderBy(F.desc("score"), "vec_id")
    found = queries.sparkSession.createDataFrame([], _FOUND + ", rank int")
    seen, many = 0, FIRST_CELLS
    open_ = queries.withColumn("floors", F.lit(None).cast("map<int,bigint>"))
    while seen < index.cells.sum():
        visits = written(open_.mapInPandas(_visits(index, seen, many), _VISIT), "visits")
        if visits.isEmpty():
            break
        new = visits.join(chunks, "cell").mapInPandas(_scored(index.numbers, same, k), _FOUND)
        found = written(found.drop("rank").union(new).withColumn("rank", F.row_number().over(place)).where(
            F.col("rank") <= k), "found")
        full = found.where(F.col("rank") == k).groupBy("a").agg(
            F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("floors"))
        open_ = queries.join(full, "a", "left")
        seen, many = seen + many, many * GROWTH
    return found


# --- hard negatives -------------------------------------------------------------------

def hard_negatives(rows: DataFrame, is_anchor: F.Column, positives: int = 5, negatives: int = 5, low: int = 80,
                   high: int = 100) -> DataFrame:
    """For each anchor and positive (its best rows of the same label) the best
    rows of other labels that score ``low`` to ``high`` percent of the positive.

    ``rows`` as ``usable`` gives them; ``is_anchor`` is a condition on them."""
    numbers, packed = pack(rows)
    index, chunks = build(numbers, packed)
    anchors = written(packed.where(is_anchor).withColumn("a", F.monotonically_increasing_id()), "anchors")
    ends = (F.array(F.lit(_LOWEST).cast("bigint")).alias("low"), F.array(F.lit(_HIGHEST).cast("bigint")).alias("high"))
    found = search(index, chunks, anchors.select("a", "vec_id", "label", "q", *ends), True, positives).select(
        "a", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # a window for each score of a positive; below zero none can be open
    score = F.col("positive_score")
    ends = written(found.where(score >= 0).select(
        "a", "positive_score", F.ceil(score * low / F.lit(100).cast("decimal(3,0)")).cast("bigint").alias("low"),
        F.floor(score * high / F.lit(100).cast("decimal(3,0)")).cast("bigint").alias("high")).distinct().withColumn(
        "w", F.row_number().over(Window.partitionBy("a").orderBy("positive_score")) - 1), "windows")
    arrays = ends.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("w", "low", "high"))).alias("ends")).select(
        "a", "ends.low", "ends.high")
    hard = search(index, chunks, anchors.join(arrays, "a"), False, negatives)
    return found.join(ends.select("a", "w", "positive_score"), ["a", "positive_score"]).join(hard, ["a", "w"]).join(
        anchors.select("a", F.col("vec_id").alias("anchor_id")), "a").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


def op11_multi_index_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of ``embeddings``; every hundredth vector is an anchor."""
    rows = usable(read_table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


#: The same rows by comparing every anchor with every row.
ORACLE_SQL = """
with e as (select vec_id, cast(if(vec_id % 7 = 0, (label + 1) % 10, label) as bigint) label,
  list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) q
  from embeddings where vec_id is not null and label is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select a.vec_id anchor_id, b.vec_id, a.label = b.label same,
  cast(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) as bigint) score
  from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, vec_id positive_id, score positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id,
 cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as integer) rank,
 vec_id negative_id, positive_score, score negative_score
from p join s using (anchor_id)
where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 5
"""
