"""Benchmark decontamination by SimHash over item-sized windows.

A benchmark item and every window of as many words in a document are
fingerprinted: 64 sign bits of the sum of the hashes of their word shingles.
Fingerprints are cut into blocks; an item's block is filed under every value
within ``RADIUS // BLOCKS`` bits of it, so that each window within ``RADIUS``
bits of an item meets it in some block (if all blocks differed by more, the
fingerprints would by more than the radius). Candidates are verified by the
exact weighted similarity of the two bags of shingles (sum of the smaller
counts by the sum of the larger ones).

A window that shares too few shingles with all items together cannot be as
similar as ``SIMILARITY`` to any, so only the others are fingerprinted; this
loses nothing. Items are a stated query set: they are handled in blocks of
``ITEM_BLOCK``, each broadcast in turn, however many there are.

Defined cases: null or empty texts and items have no words and match nothing;
an item of fewer words than a shingle is one shingle of all its words; equal
items give a match each; repeated rows are matched alike; empty tables give no
matches; other columns are ignored by ``find_leaks`` and kept by
``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airops.llm import textops
from airops.llm.common import bound_batches, keep_rows, read_table, schema

SHINGLE, SIMILARITY = 5, 0.8
#: Bits that fingerprints of similar windows may differ in, and blocks of the index.
RADIUS, BLOCKS = 19, 4
#: Items whose index is broadcast at a time.
ITEM_BLOCK = 500
_WIDTH = 64 // BLOCKS
#: Filter bits for the shingles of the items.
_FILTER_BITS = 22
_SHIFTS = np.arange(64, dtype=np.uint64)


@dataclass
class ItemIndex:
    """Items by fingerprint blocks; ``lists[b]`` and ``first[b]``: the items filed under each block value."""

    ids: list
    words: np.ndarray
    bags: list[tuple[np.ndarray, np.ndarray]]
    prints: np.ndarray
    known: np.ndarray
    first: list[np.ndarray] = field(default_factory=list)
    lists: list[np.ndarray] = field(default_factory=list)


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """64 sign bits of (n, 64) sums as one integer each."""
    return ((sums > 0).astype(np.uint64) << _SHIFTS).sum(axis=1, dtype=np.uint64)


def _signs(h: np.ndarray) -> np.ndarray:
    """(n, 64) of +1 and -1: the bits of shingle hashes."""
    return (((h[:, None] >> _SHIFTS) & np.uint64(1)).astype(np.int16) << 1) - 1


def _near(radius: int) -> np.ndarray:
    """All block values of at most ``radius`` set bits."""
    masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(_WIDTH), r)]
    return np.asarray(masks, dtype=np.int64)


def _clean(column) -> list[bytes]:
    return textops.as_bytes(column, fold=True)


def build_index(ids: list, texts: list[bytes]) -> ItemIndex:
    w = textops.Words(texts)
    kept, sizes, bags, prints = [], [], [], []
    for i, item in enumerate(ids):
        n = int(w.first[i + 1] - w.first[i])
        if n:
            sh = textops.shingles(w, i, SHINGLE)
            kept.append(item)
            sizes.append(n)
            bags.append(np.unique(sh, return_counts=True))
            prints.append(fingerprints(_signs(sh).sum(axis=0, keepdims=True))[0])
    known = np.zeros(1 << _FILTER_BITS, dtype=bool)
    for values, _ in bags:
        known[values >> np.uint64(64 - _FILTER_BITS)] = True
    index = ItemIndex(kept, np.asarray(sizes, dtype=np.int64), bags, np.asarray(prints, dtype=np.uint64), known)
    near = _near(RADIUS // BLOCKS)
    for b in range(BLOCKS):
        own = ((index.prints >> np.uint64(b * _WIDTH)) & np.uint64((1 << _WIDTH) - 1)).astype(np.int64)
        filed = (own[:, None] ^ near).ravel()
        order = np.argsort(filed, kind="stable")
        index.lists.append((order // len(near)).astype(np.int32))
        index.first.append(np.searchsorted(filed[order], np.arange((1 << _WIDTH) + 1)).astype(np.int64))
    return index


def candidates(index: ItemIndex, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(print, item) pairs within the radius, found through the blocks."""
    pairs = []
    for b in range(BLOCKS):
        value = ((prints >> np.uint64(b * _WIDTH)) & np.uint64((1 << _WIDTH) - 1)).astype(np.int64)
        lo, hi = index.first[b][value], index.first[b][value + 1]
        n = hi - lo
        who = np.repeat(np.arange(len(prints)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        item = index.lists[b][at].astype(np.int64)
        close = np.bitwise_count(prints[who] ^ index.prints[item]) <= RADIUS
        pairs.append(who[close] * len(index.ids) + item[close])
    both = np.unique(np.concatenate(pairs))
    return both // max(1, len(index.ids)), both % max(1, len(index.ids))


def weighted_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller counts by the sum of the larger ones, of two bags."""
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][x], b[1][y]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least))


def text_matches(index: ItemIndex, w: textops.Words, i: int, every: np.ndarray | None = None) -> list[tuple]:
    """(item, first word, past last word, similarity): the best window of each item in text ``i``."""
    n = int(w.first[i + 1] - w.first[i])
    best: dict[int, tuple] = {}
    if not n or not index.ids:
        return []
    words = w.hash[w.first[i]:w.first[i + 1]]
    for width in range(1, SHINGLE + 1):
        # items of fewer words than a shingle are one shingle of all their words
        sizes = np.unique(index.words[index.words >= SHINGLE] if width == SHINGLE
                          else index.words[index.words == width])
        if not len(sizes) or (n < width and width < SHINGLE):
            continue
        if width == SHINGLE:
            sh = textops.shingles(w, i, SHINGLE, every)
        else:
            sh = textops.windows_hash(words, width)
        hits = np.concatenate([[0], np.cumsum(index.known[sh >> np.uint64(64 - _FILTER_BITS)])])
        if not hits[-1]:
            continue
        for size in map(int, sizes):
            m = max(1, min(size, n) - width + 1)  # shingles of a window
            starts = np.arange(max(1, len(sh) - m + 1))
            ends = np.minimum(starts + m, len(sh))
            need = max(1, int(np.ceil(SIMILARITY * max(1, size - width + 1) - 1e-9)))
            starts = starts[hits[ends] - hits[starts] >= need]
            if not len(starts):
                continue
            lo, hi = int(starts[0]), int(min(starts[-1] + m, len(sh)))
            sums = np.zeros((hi - lo + 1, 64), dtype=np.int32)
            np.cumsum(_signs(sh[lo:hi]), axis=0, out=sums[1:])
            a = starts - lo
            prints = fingerprints(sums[np.minimum(a + m, hi - lo)] - sums[a])
            who, item = candidates(index, prints)
            for k, j in zip(who.tolist(), item.tolist()):
                if index.words[j] != size:
                    continue
                at = int(starts[k])
                sim = weighted_similarity(index.bags[j], np.unique(sh[at:at + m], return_counts=True))
                if sim >= SIMILARITY and (j not in best or (-sim, at) < (-best[j][3], best[j][1])):
                    best[j] = (index.ids[j], at, min(n, at + size), sim)
    return [best[j] for j in sorted(best)]


def _matcher(shared, keys: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for pdf in batches:
            texts = _clean(pdf["text"])
            rows = []
            for lo, hi in textops.steps(texts):
                w = textops.Words(texts[lo:hi])
                every = textops.windows_hash(w.hash, SHINGLE)
                rows += [(lo + i, *m) for i in range(hi - lo)
                         for m in text_matches(index, w, i, every)]
            out = pd.DataFrame(rows, columns=["k", "item_id", "start_word", "end_word", "similarity"])
            at = out.pop("k").to_numpy(dtype=np.int64)
            for c in reversed(keys):
                out.insert(0, c, pdf[c].take(at).array)
            yield out
    return run


def _clear(shared) -> Callable[[list], list[bool]]:
    """Which texts match no item of the broadcast index."""
    def clear(column: list) -> list[bool]:
        texts, found = _clean(column), []
        for lo, hi in textops.steps(texts):
            w = textops.Words(texts[lo:hi])
            every = textops.windows_hash(w.hash, SHINGLE)
            found += [not text_matches(shared.value, w, i, every) for i in range(hi - lo)]
        return found

    return clear


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[ItemIndex]:
    """The indexes of the items, ``ITEM_BLOCK`` at a time, in id order."""
    rows = items.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("i"), F.col(text_col).alias("t")).orderBy("i", "t").toLocalIterator()
    block: list = []
    for r in rows:
        block.append(r)
        if len(block) == ITEM_BLOCK:
            yield build_index([x["i"] for x in block], _clean([x["t"] for x in block]))
            block = []
    if block:
        yield build_index([x["i"] for x in block], _clean([x["t"] for x in block]))


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document row and matching item: the best window and its similarity."""
    spark = docs.sparkSession
    bound_batches(spark)
    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    out = schema(("doc_id", picked.schema["doc_id"].dataType), ("item_id", items.schema[item_id_col].dataType),
                 ("start_word", "bigint"), ("end_word", "bigint"), ("similarity", "double"))
    parts = [picked.mapInPandas(_matcher(spark.sparkContext.broadcast(index), ["doc_id"]), out)
             for index in item_blocks(items, item_id_col, item_text_col)]
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], out)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                      item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that match no item, with all their columns. One
    pass per block of items over what the earlier blocks kept."""
    spark = docs.sparkSession
    bound_batches(spark)
    left = docs
    for index in item_blocks(items, item_id_col, item_text_col):
        left = keep_rows(left, text_col, _clear(spark.sparkContext.broadcast(index)))
    return left


def op7_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ``documents`` that repeat a ``benchmark`` item."""
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
