"""Hard negatives, the Jaccard join and the filter audit against brute force."""

import collections
import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from airops.llm import filters, jaccard, negatives

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def duck(**tables):
    con = duckdb.connect()
    for name, pdf in tables.items():
        con.register(name, pdf)
    return con


def same_rows(spark_df, con, sql):
    got, want = spark_df.toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    rows = lambda pdf: collections.Counter(map(tuple, pdf[columns].astype(object).values.tolist()))
    assert rows(got) == rows(want)
    return len(want)


# --- 11 ------------------------------------------------------------------------

def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, q string, cell int")


def random_vectors(n, dim=8, seed=3, labels=4):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(labels, dim))
    label = rng.integers(labels, size=n)
    x = (0.7 * base[label] + rng.normal(size=(n, dim))).astype(np.float32)
    x[n // 3:n // 2] = x[0]  # a third of a part holds one vector: ties by id
    return [(i, x[i].tolist(), int(label[i]), "x", 0) for i in range(n)]


def mined(rows, anchor=100):
    usable = negatives.usable(rows)
    usable = usable.selectExpr("vec_id", "vec", "if(vec_id % 7 = 0, (label + 1) % 10, label) label")
    return negatives.hard_negatives(usable, F.col("vec_id") % anchor == 0)


def test_hard_negatives_equal_a_comparison_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "CELL_ROWS", 8)
    monkeypatch.setattr(negatives, "CHUNK_ROWS", 16)
    rows = random_vectors(700)
    rows += [(None, rows[1][1], 1, "x", 0), (1001, None, 1, "x", 0), (1002, rows[1][1], None, "x", 0),
             (1003, [float("nan")] + rows[1][1][1:], 1, "x", 0), (1004, [float("inf")] + rows[1][1][1:], 1, "x", 0),
             (1005, [None] + rows[1][1][1:], 1, "x", 0)]
    table = vectors(spark, rows)
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[], label integer)")
    con.executemany("insert into embeddings values (?, ?, ?)", [r[:3] for r in rows])
    assert same_rows(mined(table), con, negatives.ORACLE_SQL) > 50
    # equal rows count once
    assert sorted(mined(table.union(table)).collect()) == sorted(mined(table).collect())


def test_hard_negatives_of_awkward_tables(spark):
    assert mined(vectors(spark, [])).count() == 0
    assert mined(vectors(spark, [(0, [1.0, 2.0], 1, "x", 0)])).count() == 0
    # fewer than five positives and negatives, a shorter vector, a score of zero and one below
    rows = [(0, [1.0, 0.0, 0.0], 9, "x", 0), (1, [1.0], 0, "x", 0), (2, [0.5, 3.0, 0.0], 0, "x", 0),
            (3, [0.9, 0.0, 1.0], 5, "x", 0), (4, [0.0, 1.0, 1.0], 5, "x", 0), (5, [-1.0, 0.0, 0.0], 0, "x", 0)]
    got = sorted(map(tuple, mined(vectors(spark, rows)).collect()))
    # the label of 0 becomes 0: positives 1 (65536), 2 (32768) and 5 (below zero: no window)
    assert got == [(0, 1, 1, 3, 65536, 256 * 230)]


def test_large_components_keep_exact_scores(spark):
    rows = [(0, [3e4, 1.0], 9, "x", 0), (1, [3e4, 2.0], 0, "x", 0), (2, [3e4, 1.5], 1, "x", 0), (3, [3e4, 1.75], 1, "x", 0)]
    got = [tuple(r) for r in mined(vectors(spark, rows)).orderBy("rank").collect()]
    big = (256 * 30000) ** 2
    assert got == [(0, 1, 1, 3, big + 256 * 512, big + 256 * 448), (0, 1, 2, 2, big + 256 * 512, big + 256 * 384)]


def test_cells_come_in_the_order_of_their_bounds():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=9), rng.normal(size=7)
    cells = rng.random((9, 7)) < 0.7
    got = list(negatives.cells_by_bound(a, b, cells))
    want = sorted(((a[i] + b[j], i * 7 + j) for i in range(9) for j in range(7) if cells[i, j]), reverse=True)
    assert [c for _, c in got] == [c for _, c in want]
    assert np.allclose([s for s, _ in got], [s for s, _ in want])


def test_half_bounds_hold():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(300, 16)) * 100, rng.normal(size=16) * 100
    centers = negatives.codebook(x, 9)
    at, far = negatives.nearest(x, centers)
    radii = np.array([far[at == k].max(initial=0) for k in range(len(centers))])
    assert (x @ q <= negatives.half_bounds(q, centers, radii)[at]).all()


# --- 12 ------------------------------------------------------------------------

def shingle_set(text, width=3):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def components_by_pairs(rows, percent=90):
    keys = list(dict.fromkeys(rows))
    sets = [shingle_set(t) for _, t in keys]
    root = list(range(len(keys)))
    for a, b in itertools.combinations(range(len(keys)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
    least = {}
    for k, r in enumerate(root):
        least[r] = min((x for x in (least.get(r), keys[k][0]) if x is not None), default=None)
    at = {key: k for k, key in enumerate(keys)}
    return collections.Counter(
        (i, len(sets[at[i, t]]), least[root[at[i, t]]] if sets[at[i, t]] else i) for i, t in rows)


def families(seed, many=12, copies=9):
    """Texts of many lengths, each with copies a few words from it; short texts share their first half."""
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randint(0, 400))
    texts = []
    for _ in range(many):
        base = [word() for _ in range(rng.choice((1, 2, 3, 8, 11, 14, 19, 25, 60, 200)))]
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 5))):
                at = rng.randrange(len(copy) + 1)
                copy[at:at + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
            texts.append(" ".join(copy))
    half = [word() for _ in range(8)]
    texts += [" ".join(half + [word() for _ in range(7)]) for _ in range(30)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("cost", [0, 4])
def test_jaccard_components_equal_all_pairs(spark, monkeypatch, cost):
    monkeypatch.setattr(jaccard, "DELETION_COST", cost)
    monkeypatch.setattr(jaccard, "GROUP_BLOCK", 8)
    rows = list(enumerate(families(5))) + [(-1, None), (-2, ""), (-3, " \n\t "), (-4, "One"), (-5, "one"), (-6, "ÉCOLE a"),
                                          (-7, "école a"), (3, "of another id"), (-8, " ".join(f"x{k}" for k in range(30000)))]
    rows += rows[:5]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id bigint, text string, node int, text_key string")
    got = collections.Counter(map(tuple, jaccard.jaccard_components(docs).collect()))
    assert got == components_by_pairs(rows)
    assert sum(i != c for i, _, c in got) > 40


def test_jaccard_components_of_awkward_tables(spark):
    docs = "doc_id bigint, text string"
    assert jaccard.jaccard_components(spark.createDataFrame([], docs)).count() == 0
    rows = [(None, "a b c d"), (9, "A b c d"), (None, "e f g"), (None, None)]
    got = {tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, docs)).collect()}
    assert got == {(None, 2, 9), (9, 2, 9), (None, 1, None), (None, 0, None)}


@settings(max_examples=60, deadline=None)
@given(st.integers(9, 200), st.integers(0, 12), st.integers(0, 2 ** 30), st.lists(st.integers(1, 500), min_size=1, max_size=40))
def test_allocations_find_every_similar_pair(size, changes, seed, often):
    """Under any frequencies: a similar pair of sets that both skip meets in a
    segment that one of them reads whole, or in one less an element."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 2 ** 63, size=size, dtype=np.uint64)
    y = np.concatenate([x[rng.permutation(size)[changes // 2:]], rng.integers(0, 2 ** 63, size=changes - changes // 2,
                                                                            dtype=np.uint64)])
    if 100 * len(np.intersect1d(x, y)) < 90 * len(np.union1d(x, y)):
        return
    x, y = sorted((x, y), key=len)
    band = jaccard.bands_of(np.array([len(x)]), 90)[0]
    assert band[0] in [b[0] for b in jaccard.bands_of(np.array([len(y)]), 90)]
    if band[0] < 0:
        assert set(x.tolist()) == set(y.tolist())
        return
    a, b = (jaccard.Segments(s, np.zeros(len(s), dtype=np.int64), band, 90) for s in (x, y))
    many = len(a.keys)
    p = jaccard.allocation(np.resize(np.array(often), many), size / many)
    assert (p + 1).sum() == many
    whole = {k for k, q in zip(a.keys.tolist(), p) if q >= 0}
    one = {k for k, q in zip(a.keys.tolist(), p) if q == 1}
    less_one = set(a.less_one()[p[a.at] == 1].tolist())
    assert whole & set(b.keys.tolist()) or one & set(b.less_one().tolist()) or less_one & set(b.keys.tolist())


# --- 13 ------------------------------------------------------------------------

def audited(docs, labels):
    failed = filters.failures(docs, labels)
    return filters.audit(filters.posting_lists(failed))


def filter_fixture(spark):
    rng = random.Random(9)
    rows = []
    for k in range(160):
        words = [rng.choice(("alpha", "beta", "Gamma", "delta", "EPS", "zeta"))] * rng.choice((0, 1, 150))
        words += [f"w{rng.randint(0, 300)}" for _ in range(rng.choice((0, 3, 60, 230)))] + ["#x"] * rng.choice((0, 0, 1))
        rows.append((k, " ".join(words), rng.choice(("s1", "s1", "s1", "s2"))))
    rows += [(200 + k, rows[k % 40][1], "s3") for k in range(60)]
    rows += [(400, None, None), (401, "", None), (402, " \x0b\n", ""), (403, "É" * 300, "s2"), (404, "A&b " * 20000, "s2"),
             (405, "one word", "s2"), (None, rows[0][1], "s1"), (7, rows[7][1], "s1"), (7, rows[7][1], "s1"),
             (7, "another text", "s1")]
    docs = spark.createDataFrame([(*r, 5, True) for r in rows], "doc_id bigint, text string, source string, fails int, good boolean")
    marks = [(k, rng.choice((0, 1, None)), rng.choice((0, 1))) for k in range(0, 260, 2)] + [(7, 1, 0), (7, 0, 1), (9999, 1, 1)]
    return docs, spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")


def test_filter_audit_equals_plain_counting(spark, monkeypatch):
    monkeypatch.setattr(filters, "RANGE", 16)
    docs, labels = filter_fixture(spark)
    con = duck(documents=docs.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}),
               labels=labels.toPandas().astype({"quality": "Int64"}))
    assert same_rows(audited(docs, labels), con, filters.ORACLE_SQL) == 120 * 5 * 4


def test_filter_audit_of_empty_tables(spark):
    docs, labels = filter_fixture(spark)
    assert audited(docs.limit(0), labels).count() == 0
    rows = audited(docs, labels.limit(0)).collect()
    assert len(rows) == 2400 and not any(r.good_lost or r.toxic_lost for r in rows)
    size = collections.Counter(r.source or "" for r in docs.collect())
    removed = collections.Counter()
    for r in rows:
        removed[r.part, r.filter_order] += r.removed
    assert all(r.kept + removed[r.part, r.filter_order] == size[r.part] for r in rows if r.step == 5)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sets(st.integers(0, 300), max_size=120), min_size=1, max_size=5), st.integers(1, 9))
def test_merges_of_posting_lists(lists, block):
    arrays = [np.array(sorted(x), dtype=np.int32) for x in lists]
    assert filters.union(arrays, block).tolist() == sorted(set().union(*lists))
    for a, x in zip(arrays, lists):
        for b, y in zip(arrays, lists):
            assert filters.difference(a, b, block).tolist() == sorted(x - y)


def test_shapley_weights_add_up():
    n = len(filters.FILTERS)
    assert sum(math.comb(n - 1, s) * math.factorial(s) * math.factorial(n - 1 - s) for s in range(n)) == math.factorial(n)
