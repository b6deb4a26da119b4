"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes
log-count ratios.

An n-gram counts once a text. Its log-count ratio is its smoothed share among
toxic training texts against its share among the others; a logistic regression
is fitted on the n-grams so scaled. The model learns from at most
``TRAIN_TOXIC`` and ``TRAIN_OTHER`` labelled texts (those with the smallest
hashes of their ids) and keeps the ``FEATURES`` n-grams that tell most; every
text is then scored whole.

Defined cases: a null text is empty and gets the score of a text without known
n-grams; null labels are not learned from, and a text labelled twice counts as
toxic if one label says so; without labels of both kinds the score is the share
of toxic labels; repeated rows are scored alike; an empty table gives no rows;
``score_toxicity`` ignores other columns and ``drop_toxic`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airops.llm import ngrams
from airops.llm.common import bound_batches, fold_of, keep_rows, read_table, schema, smallest_hashes

SIZES, BITS = (3, 4, 5, 6), 20
THRESHOLD = 0.7
#: Bounds of the training sample and of the model.
TRAIN_TOXIC, TRAIN_OTHER, FEATURES = 6_000, 14_000, 16_384
SMOOTHING, PENALTY, ROUNDS, TOXIC_WEIGHT = 1.0, 2e-4, 500, 5.0
#: Known n-grams that one step of the fit holds at their full width.
STEP = 1 << 18


@dataclass
class ToxicityModel:
    """``weights[bucket]``: what an n-gram adds to the log odds; ``bias``: of a text without any."""

    weights: np.ndarray
    bias: float


def _texts(column: Iterable) -> list[str]:
    return [t.lower() if isinstance(t, str) else "" for t in column]


def _distinct(texts: list[str], wanted: np.ndarray | None = None) -> list[np.ndarray]:
    """The distinct buckets of each text, of those ``wanted``."""
    out: list[np.ndarray] = []
    for lo, hi, grams in ngrams.buckets(texts, SIZES, BITS):
        cuts, hashes = [], []
        for owner, h in grams:
            if wanted is not None:
                hit = wanted[h]
                owner, h = owner[hit], h[hit]
            cuts.append(np.searchsorted(owner, np.arange(lo, hi + 1)).tolist())
            hashes.append(h)
        for i in range(hi - lo):
            each = np.concatenate([h[c[i]:c[i + 1]] for c, h in zip(cuts, hashes)])
            each.sort()
            first = np.ones(len(each), dtype=bool)
            first[1:] = each[1:] != each[:-1]
            out.append(each[first])
    return out


def _fit(col: np.ndarray, size: np.ndarray, y: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on indicator features scaled by ``ratio``, sparse by
    an L1 penalty: accelerated proximal gradient with restarts. Toxic texts
    weigh up to ``TOXIC_WEIGHT`` times the others, as far as they are rarer.
    ``col``: the features of all texts, ``size[i]`` of text ``i``; they stay
    16-bit indices but for one step of texts at a time."""
    n, d = len(size), len(ratio)
    at = np.concatenate([[0], np.cumsum(size)])
    steps, lo = [], 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + STEP, "right")) - 1)
        steps.append((lo, hi, lo + np.flatnonzero(size[lo:hi])))
        lo = hi
    weight = np.where(y > 0, min(TOXIC_WEIGHT, max(1.0, (n - y.sum()) / y.sum())), 1.0)
    weight /= weight.sum()
    norms = sum(float((ratio[col[at[lo]:at[hi]]] ** 2).sum()) for lo, hi, _ in steps)
    # by the mean squared norm of a row; the restart checks a step that is too long
    step = 4.0 / (1e-9 + norms / max(n, 1))
    w, b = np.zeros(d), 0.0
    vw, vb, pw, pb, t = w, b, w, b, 1.0
    z = np.zeros(n)
    for _ in range(ROUNDS):
        scaled, slope, total = ratio * vw, np.zeros(d), 0.0
        for lo, hi, known in steps:
            part = col[at[lo]:at[hi]].astype(np.intp)
            z[lo:hi] = vb
            if len(known):
                z[known] += np.add.reduceat(scaled[part], at[known] - at[lo])
            g = (1 / (1 + np.exp(-np.clip(z[lo:hi], -40, 40))) - y[lo:hi]) * weight[lo:hi]
            slope += np.bincount(part, weights=np.repeat(g, size[lo:hi]), minlength=d)
            total += g.sum()
        w = vw - step * ratio * slope
        w = np.sign(w) * np.maximum(np.abs(w) - step * PENALTY, 0)
        b = vb - step * total
        if ((vw - w) * (w - pw)).sum() + (vb - b) * (b - pb) > 0:
            t = 1.0
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vw, vb = w + (t - 1) / s * (w - pw), b + (t - 1) / s * (b - pb)
        pw, pb, t = w, b, s
    return w, b


def train(docs: DataFrame, labels: DataFrame, keep: Column | None = None, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on a bounded sample of the labelled rows (of ``labels``, where ``keep`` holds)."""
    bound_batches(docs.sparkSession)
    flat = ToxicityModel(np.zeros(1 << BITS, dtype=np.float32), 0.0)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known if keep is None else known.where(keep)
    known = known.groupBy(F.col(id_col).alias("l_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    picked = [smallest_hashes(known.where(F.col("y") == y), n, "l_id")
              for y, n in ((1, TRAIN_TOXIC), (0, TRAIN_OTHER))]
    sample = F.broadcast(picked[0].union(picked[1]))  # bounded by the two limits
    rows = docs.select(docs[id_col].alias("d_id"), docs[text_col].alias("text")).join(
        sample, F.col("d_id") == F.col("l_id")).select("l_id", "y", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, (1 << BITS) + 1), dtype=np.int64)
        for pdf in batches:
            for y, each in zip(pdf["y"], _distinct(_texts(pdf["text"]))):
                total[y, each] += 1
                total[y, -1] += 1
        at = np.flatnonzero(total.sum(axis=0))
        yield pd.DataFrame({"bucket": at, "clean": total[0, at], "bad": total[1, at]})

    counts = rows.mapInPandas(count, schema(("bucket", "int"), ("clean", "bigint"), ("bad", "bigint")))
    counts = counts.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
    # how far the toxic count is from its share, in standard deviations
    texts = counts.where(F.col("bucket") == 1 << BITS).first()
    if texts is None:
        return flat
    n_clean, n_bad = texts["clean"], texts["bad"]
    flat.bias = float(np.log((n_bad + 0.5) / (n_clean + 0.5)))
    if not n_bad or not n_clean:
        return flat
    share = n_bad / (n_bad + n_clean)
    both = F.col("clean") + F.col("bad")
    told = F.abs(F.col("bad") - both * share) / F.sqrt(both * share * (1 - share) + 1)
    top = counts.where(F.col("bucket") < 1 << BITS).withColumn("told", told).orderBy(
        F.desc("told"), "bucket").limit(FEATURES).toPandas().sort_values("bucket")
    p = (top["bad"].to_numpy() + SMOOTHING) / (n_bad + 2 * SMOOTHING)
    q = (top["clean"].to_numpy() + SMOOTHING) / (n_clean + 2 * SMOOTHING)
    ratio = np.log(p / q)
    buckets = top["bucket"].to_numpy()
    index = np.full(1 << BITS, -1, dtype=np.int32)
    index[buckets] = np.arange(len(buckets))
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = shared.value >= 0
        for pdf in batches:
            yield pd.DataFrame({"l_id": pdf["l_id"], "y": pdf["y"], "f": [
                shared.value[each].astype("<i2").tobytes() for each in _distinct(_texts(pdf["text"]), wanted)]})

    # one row per sampled id, even where a document is repeated
    sampled = rows.mapInPandas(project, schema(("l_id", rows.schema["l_id"].dataType), ("y", "int"), ("f", "binary")))
    got = sampled.groupBy("l_id").agg(F.max("y").alias("y"), F.max("f").alias("f")).toPandas().sort_values("l_id")
    y, size = got["y"].to_numpy(dtype=float), got["f"].map(len).to_numpy(dtype=np.int64) // 2
    col = np.frombuffer(b"".join(got["f"]), dtype="<i2")
    del got
    w, b = _fit(col, size, y, ratio)
    weights = np.zeros(1 << BITS, dtype=np.float32)
    weights[buckets] = w * ratio
    return ToxicityModel(weights, float(b))


def score_texts(model: ToxicityModel, texts: list[str]) -> np.ndarray:
    wanted = model.weights != 0
    odds = [model.bias + float(model.weights[each].sum()) for each in _distinct(texts, wanted)]
    return 1 / (1 + np.exp(-np.clip(np.asarray(odds, dtype=float), -40, 40)))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    bound_batches(docs.sparkSession)
    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": score_texts(shared.value, _texts(pdf["text"]))})

    return picked.mapInPandas(run, schema(("doc_id", picked.schema["doc_id"].dataType), ("score", "double")))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text",
               threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` scored under ``threshold``, with all their columns."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    return keep_rows(docs, text_col, lambda texts: (score_texts(shared.value, _texts(texts)) < threshold).tolist())


def op6_toxicity_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of ``documents``, learned from the labelled
    rows whose crc32 of the id leaves 0 or 2 by 3."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold_of(F.col("doc_id"), 3) == 1
    model = train(docs, read_table(spark, sf_dir, "labels"), ~held_out)
    return score_toxicity(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
        .alias("predicted"))
