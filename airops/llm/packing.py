"""Packing token pieces into fixed windows by non-negative least squares.

A document's ids are cut into whole windows and a rest. The histogram of piece
lengths (at most ``window`` numbers, however many documents) is all that the
plan needs: shallow combinations of up to three lengths that fill a window
exactly are enumerated, repeat counts are solved against the histogram by
non-negative least squares and rounded, and what is left over is packed
greedily. Each piece then finds its place from its rank among the pieces of its
length. Ranks are counted in salted groups, so that a length that a third of
all pieces share is ranked by many tasks.

Defined cases: a null text is empty and gives the separator alone; repeated
rows are packed as separate pieces; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airops.llm.common import bound_batches, read_table, schema, written

WINDOW = 1024
SEPARATOR = 0
#: Pieces that one ranking group holds, about.
RANK_GROUP = 10_000
#: Weight of the shortest lengths in the least squares: their rest costs little padding.
SHORT_WEIGHT = 0.05
SOLVER_ROUNDS = 400
#: Texts of these characters only are split alike by either implementation of the vocabulary.
_PLAIN = re.compile(r"[\x00-ɏ]*")


def vocabulary_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import tokenizers

    return tokenizers.Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _fast_encoder(path: str):
    """(a faster encoder of the file's vocabulary, its special tokens)."""
    import json

    import tiktoken
    from public_tokenizers import PATTERN

    # the byte-level alphabet: printable bytes stand for themselves, the others
    # for the characters from U+0100 on, in order
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("same", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sorted(special)


def token_ids(texts: list[str], path: str) -> Iterator[np.ndarray]:
    """The ids of each text as ``tokenizers`` gives them. Texts of Latin
    characters without a special token go through a faster encoder that gives
    the same ids; all others through ``tokenizers`` itself."""
    fast, special = _fast_encoder(path)
    for t in texts:
        if _PLAIN.fullmatch(t) and not any(s in t for s in special):
            yield np.asarray(fast.encode_ordinary(t), dtype="<u4")
        else:
            yield np.asarray(_tokenizer(path).encode(t, add_special_tokens=False).ids, dtype="<u4")


def cut_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                  window: int = WINDOW, separator: int = SEPARATOR, id_bytes: int = 4) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens and the ids as
    unsigned little-endian integers of ``id_bytes`` bytes (2 or 4)."""
    bound_batches(docs.sparkSession)
    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            for k, ids in enumerate(token_ids(texts, tokenizer)):
                ids = np.append(ids, np.uint32(separator)).astype(f"<u{id_bytes}")
                n = len(ids)
                rows += [(k, at, min(window, n - at), n, ids[at:at + window].tobytes())
                         for at in range(0, n, window)]
            out = pd.DataFrame(rows, columns=["k", "start", "length", "doc_tokens", "ids"])
            out.insert(0, "doc_id", pdf["doc_id"].take(out.pop("k")).array)
            yield out

    return picked.mapInPandas(run, schema(
        ("doc_id", picked.schema["doc_id"].dataType), ("start", "bigint"), ("length", "bigint"),
        ("doc_tokens", "bigint"), ("ids", "binary")))


def combinations(window: int) -> np.ndarray:
    """Every way to fill ``window`` with one, two or three lengths, falling;
    rows of three, 0 where a place is unused."""
    out = [np.array([[window, 0, 0]])]
    b = np.arange(1, window // 2 + 1)
    out.append(np.stack([window - b, b, 0 * b], axis=1))
    for c in range(1, window // 3 + 1):
        b = np.arange(c, (window - c) // 2 + 1)
        out.append(np.stack([window - c - b, b, 0 * b + c], axis=1))
    return np.concatenate(out)


def solve_counts(combos: np.ndarray, histogram: np.ndarray, rounds: int = SOLVER_ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 that make the combinations use each length about as
    often as it occurs: accelerated projected gradient on weighted least squares
    (the matrix has at most three entries a column and is never formed)."""
    n = len(histogram)
    weight = np.clip(np.arange(n) / (n / 4), SHORT_WEIGHT, 1.0)
    weight[0] = 0  # an unused place
    scale = max(1.0, float(histogram.max()))
    target = histogram / scale
    flat = combos.ravel()

    def used(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, weights=np.repeat(x, combos.shape[1]), minlength=n)

    def back(r: np.ndarray) -> np.ndarray:
        return r[combos].sum(axis=1)

    w2 = weight ** 2
    # the largest eigenvalue of the normal matrix, for the step length
    v = np.ones(len(combos))
    for _ in range(20):
        v = back(w2 * used(v))
        top = np.linalg.norm(v)
        v /= top or 1.0
    step = 1.0 / max(top, 1e-9) / 1.05
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * back(w2 * (used(y) - target)))
        if ((y - new) * (new - x)).sum() > 0:  # restart where the momentum points uphill
            t, y = 1.0, new
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / s * (new - x)
        x, t = new, s
    return x * scale


def packing_plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[list[int], int]]:
    """[(lengths of one sequence, how often)]: uses each length exactly as often
    as it occurs. Its size depends on ``window`` alone, not on the counts."""
    left = np.zeros(window + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] += n
    plan: list[tuple[list[int], int]] = []

    def take(lengths: list[int], times: int) -> None:
        plan.append((lengths, times))
        for x in lengths:
            left[x] -= times

    if left[window]:
        take([window], int(left[window]))
    present = left > 0
    combos = combinations(window)
    combos = combos[(present[combos] | (combos == 0)).all(axis=1)]
    if len(combos):
        counts = np.rint(solve_counts(combos, left.astype(float))).astype(np.int64)
        for k in np.argsort(-counts, kind="stable"):
            if counts[k] <= 0:
                break
            lengths = [int(x) for x in combos[k] if x]
            times = min(int(counts[k]), *(int(left[x]) // lengths.count(x) for x in set(lengths)))
            if times > 0:
                take(lengths, times)
    # the residuals, greedily: the longest length left, filled with the longest
    # that fit; a pattern is repeated until one of its lengths runs out
    while (rest := np.flatnonzero(left)).size:
        lengths, room = [int(rest[-1])], window - int(rest[-1])
        need = {lengths[0]: 1}
        for x in map(int, rest[::-1]):
            fit = min(room // x, int(left[x]) - need.get(x, 0))
            if fit > 0:
                lengths += [x] * fit
                need[x] = need.get(x, 0) + fit
                room -= fit * x
        take(lengths, min(int(left[x]) // n for x, n in need.items()))
    return plan


def _places(plan: list[tuple[list[int], int]]) -> pd.DataFrame:
    """Per plan entry and length: the ranks that it takes, and where they go."""
    rows, used, base = [], {}, 0
    for lengths, times in plan:
        offset = 0
        for x in dict.fromkeys(lengths):
            m = lengths.count(x)
            first = used.get(x, 0)
            rows.append((x, first, first + m * times, m, base, offset))
            used[x] = first + m * times
            offset += m * x
        base += times
    return pd.DataFrame(rows, columns=["p_length", "first_rank", "past_rank", "a_sequence", "base", "at"])


def pack_pieces(pieces: DataFrame, window: int = WINDOW, keys: tuple[str, ...] = ()) -> DataFrame:
    """``pieces`` (with an integer column ``length``, 1 to ``window``, and any
    others) with ``sequence_id`` and ``offset``; ``keys`` (else all columns) order
    pieces of a length. Reads its input three times: pass a written table."""
    spark = pieces.sparkSession
    by_length = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _places(packing_plan(by_length, window))
    # a rank within the length: groups of a salt are numbered one after another
    salts = max(1, -(-max(by_length.values(), default=1) // RANK_GROUP))
    keys = keys or tuple(pieces.columns)
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*keys), F.lit(salts)))
    sizes = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    ahead = sizes.withColumn("__ahead", F.sum("__n").over(
        Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)))
    ahead = ahead.select("length", "__salt", F.coalesce("__ahead", F.lit(0)).alias("__ahead"))
    inner = Window.partitionBy("length", "__salt").orderBy(*keys)
    ranked = salted.withColumn("__rank", F.row_number().over(inner) - 1).join(ahead, ["length", "__salt"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__ahead"))
    # at most a few thousand rows, whatever the input: bounded by ``window``
    table = spark.createDataFrame(places if len(places) else places.astype("int64"), schema(
        *[(c, "bigint") for c in places.columns]))
    chunk = table.groupBy("p_length").agg(F.array_sort(F.collect_list(F.struct(
        "first_rank", "past_rank", "a_sequence", "base", "at"))).alias("__places"))
    hit = ranked.join(F.broadcast(chunk), ranked["length"] == F.col("p_length"))
    found = hit.withColumn("__p", F.element_at(F.filter("__places", lambda p: F.col("__rank") < p["past_rank"]), 1))
    k = F.col("__rank") - F.col("__p.first_rank")
    return found.select(
        *[F.col(f"`{c}`") for c in pieces.columns],
        (F.col("__p.base") + F.floor(k / F.col("__p.a_sequence"))).cast("bigint").alias("sequence_id"),
        (F.col("__p.at") + F.pmod(k, F.col("__p.a_sequence")) * F.col("length")).cast("bigint").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW,
                   digest_only: bool = False, **columns: str) -> DataFrame:
    """The pieces of all documents with their places and their ids (16-bit: the
    vocabulary has fewer). ``digest_only`` keeps the crc32 of a piece's 32-bit
    ids in place of the ids."""
    pieces = cut_documents(docs, tokenizer or vocabulary_path("byte_bpe_50k.json"), window=window,
                           id_bytes=4 if digest_only else 2, **columns)
    if digest_only:
        pieces = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack_pieces(written(pieces, "pieces"), window, ("doc_id", "start", "doc_tokens"))


def op3_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 1024 tokens."""
    return pack_documents(read_table(spark, sf_dir, "documents"), digest_only=True)
