"""What each quality filter removes, alone and after the others, in every order.

Filters over documents (words are runs of characters other than space and
x09-x0D): A under 200 words, B under half of the words distinct, C over 2 % of
the characters in A-Z, D a character of ``#$%&*|``, E a text that a smaller id
has as well. The method is that of an inverted index: the documents of a part
(``source``) in id order are cut to ranges, and each range keeps, per filter,
the posting list of the documents that fail it - their places in the range,
ascending - and those of the labelled documents. Unions and differences of the
lists are galloping merges: a list is skipped by doubling steps to where the
others stand, and only what lies between is compared. A range gives sizes only,
which are summed over the ranges of a part, so that a part of any size is dealt
to as many tasks as it has ranges.

Defined cases: a null text is empty, a null source is the part ``""``; every row
is a document, also one that repeats an id; a null id comes first, fails E never
and makes no other document fail it; rows of the same id and text don't fail E
by each other; several labels of one id count as their largest values, a null
label as 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airops.llm.common import read_table, schema, written

FILTERS = "ABCDE"
#: Documents of one range, and places of a list that one step of a merge compares.
RANGE, BLOCK = 1 << 15, 512
_WORD_GAP = r"[\x20\x09-\x0D]+"
_SYMBOL = r"[#$%&*|]"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


# --- merges of posting lists ----------------------------------------------------

def gallop(ids: np.ndarray, start: int, bound: int) -> int:
    """The first place from ``start`` on whose id is at least ``bound``."""
    step, lo, hi = 1, start, start
    while hi < len(ids) and ids[hi] < bound:
        lo, hi = hi + 1, hi + step
        step *= 2
    return lo + int(np.searchsorted(ids[lo:min(hi, len(ids))], bound))


def union(lists: list[np.ndarray], block: int = BLOCK) -> np.ndarray:
    """The ids of any of some ascending lists, by a k-way merge over id ranges:
    the next range ends at the least of the ids that lie ``block`` places on."""
    at, out = [0] * len(lists), []
    while True:
        open_ = [k for k, ids in enumerate(lists) if at[k] < len(ids)]
        if len(open_) < 2:
            out += [lists[k][at[k]:] for k in open_]
            break
        bound = min(int(lists[k][min(at[k] + block, len(lists[k])) - 1]) for k in open_) + 1
        cut = {k: gallop(lists[k], at[k], bound) for k in open_}
        held = [lists[k][at[k]:c] for k, c in cut.items() if c > at[k]]
        out.append(held[0] if len(held) == 1 else np.unique(np.concatenate(held)))
        for k, c in cut.items():
            at[k] = c
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int32)


def difference(ids: np.ndarray, less: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The ids of one ascending list that another doesn't have: the other is
    galloped to each block of the first."""
    out, at = [], 0
    for first in range(0, len(ids), block):
        part = ids[first:first + block]
        at = gallop(less, at, int(part[0]))
        end = gallop(less, at, int(part[-1]) + 1)
        out.append(part if end == at else np.setdiff1d(part, less[at:end], assume_unique=True))
        at = end
    return np.concatenate(out) if out else ids[:0]


# --- the lists --------------------------------------------------------------------

def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             part_col: str = "source") -> DataFrame:
    """id, part, good, toxic and the failed filters (``fails``, a bit each) of every row."""
    text = F.coalesce(docs[text_col], F.lit(""))
    words = F.array_remove(F.split(text, _WORD_GAP), "")
    n, chars = F.size(words), F.length(text)
    capitals = chars - F.length(F.translate(text, _CAPITALS, ""))
    tests: list[Column] = [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals > 2 * chars,
                           text.rlike(_SYMBOL)]
    bits = sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))
    rows = written(docs.select(docs[id_col].alias("id"), F.coalesce(docs[part_col], F.lit("")).alias("part"),
                               bits.alias("fails"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("text_key")),
                   "filters")
    # written first: then the planner sees its size, and splits the copies of a frequent text
    firsts = written(rows.groupBy("text_key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where(
        "n > 1").drop("n"), "filter-copies")
    marks = written(labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")), "filter-labels")
    copy = F.when(F.col("id") > F.col("first"), 1 << 4).otherwise(0)
    return rows.join(firsts, "text_key", "left").join(marks, "id", "left").select(
        "id", "part", (F.col("fails") + copy).alias("fails"), F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"))


def _ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ranges of rows sorted by part and id, with their posting lists."""
    held: list[pd.DataFrame] = []

    def flush() -> Iterator[pd.DataFrame]:
        if held:
            g = pd.concat(held)
            held.clear()
            fails = g["fails"].to_numpy()
            place = np.arange(len(g), dtype=np.int32)
            yield pd.DataFrame({
                "part": [g["part"].iat[0]], "documents": [len(g)],
                "lists": [[place[fails >> k & 1 == 1].tobytes() for k in range(len(FILTERS))]],
                "good": [place[g["good"].to_numpy()].tobytes()], "toxic": [place[g["toxic"].to_numpy()].tobytes()]})

    for pdf in batches:
        cuts = np.flatnonzero((pdf["part"] != pdf["part"].shift()).to_numpy()).tolist() + [len(pdf)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            while a < b:
                if held and (held[0]["part"].iat[0] != pdf["part"].iat[a] or sum(map(len, held)) >= RANGE):
                    yield from flush()
                take = min(b - a, RANGE - sum(map(len, held)))
                held.append(pdf.iloc[a:a + take])
                a += take
    yield from flush()


def posting_lists(failed: DataFrame) -> DataFrame:
    """A row for each range of a part: its number of documents, and the places in
    it that fail each filter, that are good and that are toxic (32-bit integers)."""
    # a table that was read: the tie is the same whenever a task is repeated
    dealt = failed.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("part", "id", "tie")
    return dealt.sortWithinPartitions("part", "id", "tie").select("part", "fails", "good", "toxic").mapInPandas(
        _ranges, schema(("part", "string"), ("documents", "bigint"), ("lists", "array<binary>"), ("good", "binary"),
                        ("toxic", "binary")))


# --- sizes ------------------------------------------------------------------------

def range_sizes(lists: list[np.ndarray], good: np.ndarray, toxic: np.ndarray) -> Iterator[tuple]:
    """(filter, filters before it, size of their union, documents that the filter
    removes after them, good ones of these, toxic ones of these)."""
    unions = [union([ids for k, ids in enumerate(lists) if before >> k & 1]) for before in range(1 << len(lists))]
    for k, ids in enumerate(lists):
        for before, gone in enumerate(unions):
            if not before >> k & 1:
                new = difference(ids, gone)
                yield (k, before, len(gone), len(new), len(new) - len(difference(new, good)),
                       len(new) - len(difference(new, toxic)))


def _sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for r in pdf.itertuples():
            got = list(range_sizes([np.frombuffer(x, dtype=np.int32) for x in r.lists],
                                   np.frombuffer(r.good, dtype=np.int32), np.frombuffer(r.toxic, dtype=np.int32)))
            out = pd.DataFrame(got, columns=["filter", "before", "gone", "removed", "good_lost", "toxic_lost"])
            yield out.assign(part=r.part, documents=r.documents)


def interactions(lists: DataFrame) -> DataFrame:
    """For each part, filter and set of filters before it: the documents, those
    gone before, and those that the filter removes (good and toxic ones as well)."""
    names = ("filter", "before", "gone", "removed", "good_lost", "toxic_lost")
    one = lists.mapInPandas(_sizes, schema(*[(n, "bigint") for n in names], ("part", "string"), ("documents", "bigint")))
    return one.groupBy("part", "filter", "before").agg(
        *[F.sum(n).alias(n) for n in ("documents", "gone", "removed", "good_lost", "toxic_lost")])


def order_steps(spark: SparkSession) -> DataFrame:
    """The steps of all orders of the filters: a fixed table of 5 x 120 rows."""
    rows = [("".join(FILTERS[k] for k in order), s + 1, order[s], sum(1 << k for k in order[:s]))
            for order in itertools.permutations(range(len(FILTERS))) for s in range(len(FILTERS))]
    return spark.createDataFrame(rows, "filter_order string, step int, filter bigint, before bigint")


def audit(lists: DataFrame) -> DataFrame:
    """Every part, order and step with what its filter removes and what it had to itself."""
    every = (1 << len(FILTERS)) - 1
    sizes = written(interactions(lists), "filter-sizes")
    others = sum((F.when(F.col("filter") == k, every - (1 << k)).otherwise(0) for k in range(len(FILTERS))), F.lit(0))
    size = F.bit_count("before")
    # the orders in which just these filters come before this one
    orders = sum((F.when(size == s, math.factorial(s) * math.factorial(len(FILTERS) - 1 - s)).otherwise(0)
                  for s in range(len(FILTERS))), F.lit(0))
    alone = sizes.groupBy("part", "filter").agg(
        F.max(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.max(F.when(F.col("before") == others, F.col("removed"))).alias("unique_fails"),
        F.sum(orders * F.col("removed")).alias("shapley"))
    return sizes.join(order_steps(lists.sparkSession), ["filter", "before"]).join(alone, ["part", "filter"]).select(
        "part", "filter_order", "step", (F.col("documents") - F.col("gone") - F.col("removed")).alias("kept"), "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost",
        F.col("shapley").cast("bigint").alias("shapley"))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interaction audit of the five filters over ``documents``."""
    failed = failures(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return audit(posting_lists(written(failed, "filter-failures")))


#: The same rows by plain counting: documents grouped by the set of filters that they fail.
ORACLE_SQL = r"""
with l as (select doc_id, max(quality) quality, max(toxic) toxic from labels group by doc_id),
d as (select d.doc_id, coalesce(d.source, '') part, coalesce(d.text, '') body, coalesce(l.quality = 1, false) good,
  coalesce(l.toxic = 1, false) bad, min(d.doc_id) over (partition by coalesce(d.text, '')) first
  from documents d left join l on d.doc_id = l.doc_id),
w as (select *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') words from d),
m as (select part, good, bad, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
  100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body), regexp_matches(body, '[#$%&*|]'),
  coalesce(doc_id > first, false)] fails from w),
g as (select part, list_transform(list_filter([1, 2, 3, 4, 5], lambda k: fails[k]), lambda k: substr('ABCDE', k, 1)) failed,
  count(*) n, count(*) filter (good) good, count(*) filter (bad) bad from m group by all),
letter as (select unnest(['A', 'B', 'C', 'D', 'E']) x),
o as (select a.x || b.x || c.x || d.x || e.x filter_order from letter a, letter b, letter c, letter d, letter e
  where a.x not in (b.x, c.x, d.x, e.x) and b.x not in (c.x, d.x, e.x) and c.x not in (d.x, e.x) and d.x <> e.x),
s as (select filter_order, cast(step as integer) step, substr(filter_order, cast(step as integer), 1) x,
  string_split(substr(filter_order, 1, cast(step as integer) - 1), '') before
  from o, (select unnest([1, 2, 3, 4, 5]) step)),
c as (select part, filter_order, step, x,
  sum(n) filter (not list_has_any(failed, before) and not list_contains(failed, x)) kept,
  sum(n) filter (not list_has_any(failed, before) and list_contains(failed, x)) removed,
  sum(n) filter (list_has_any(failed, before) and list_contains(failed, x)) redundant,
  sum(n) filter (failed = [x]) unique_fails,
  sum(good) filter (not list_has_any(failed, before) and list_contains(failed, x)) good_lost,
  sum(bad) filter (not list_has_any(failed, before) and list_contains(failed, x)) toxic_lost
  from g, s group by all),
z as (select part, filter_order, step, x, cast(coalesce(kept, 0) as bigint) kept, cast(coalesce(removed, 0) as bigint) removed,
  cast(coalesce(redundant, 0) as bigint) redundant, cast(coalesce(unique_fails, 0) as bigint) unique_fails,
  cast(coalesce(good_lost, 0) as bigint) good_lost, cast(coalesce(toxic_lost, 0) as bigint) toxic_lost from c)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
 cast(sum(removed) over (partition by part, x) as bigint) shapley from z
"""
