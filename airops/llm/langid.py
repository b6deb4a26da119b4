"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of all training texts per language on Spark; the
log-probability matrix (buckets by languages, a few MB) is broadcast, and texts
are scored in numpy, each as the sum of its n-grams' rows.

Defined cases: a null text or one without a letter is ``und`` with score 0; a
null language is not learned from; without any training text every prediction
is ``und``; ties go to the alphabetically first language; repeated rows are
scored alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airops.llm import ngrams
from airops.llm.common import bound_batches, fold_of, read_table, schema

SIZES, BITS, SMOOTHING = (1, 2, 3), 15, 0.5
#: Languages that the model may have; its matrix is that bounded.
MAX_LANGUAGES = 1000
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class LanguageModel:
    """``weights[bucket, language]``: log probability of an n-gram; ``prior``: of a text."""

    languages: list[str]
    weights: np.ndarray
    prior: np.ndarray


def _texts(column: pd.Series) -> list[str]:
    return [t.lower() if isinstance(t, str) else "" for t in column]


def train(docs: DataFrame, keep: Column, lang_col: str = "lang", text_col: str = "text") -> LanguageModel:
    """Counts over every row where ``keep`` holds, its text and language not null."""
    bound_batches(docs.sparkSession)
    rows = docs.where(keep & docs[lang_col].isNotNull() & docs[text_col].isNotNull()).select(
        docs[lang_col].cast("string").alias("lang"), docs[text_col].alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, np.ndarray] = {}
        n_texts: dict[str, int] = {}
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                texts = [t for t in _texts(part["text"]) if _LETTER.search(t)]
                n_texts[lang] = n_texts.get(lang, 0) + len(texts)
                total = seen.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
                for _, _, grams in ngrams.buckets(texts, SIZES, BITS):
                    for _, h in grams:
                        total += np.bincount(h, minlength=1 << BITS)
        for lang, total in seen.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": np.append(at, -1),
                                "n": np.append(total[at], n_texts[lang])})

    counts = rows.mapInPandas(count, schema(("lang", "string"), ("bucket", "int"), ("n", "bigint")))
    # one row per language with its counts packed: at most MAX_LANGUAGES x 2^BITS numbers
    total = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    top = total.where("bucket = -1 and n > 0").orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    found = total.join(F.broadcast(top.select("lang")), "lang").toPandas()
    languages = sorted(found["lang"].unique())
    table = np.zeros((len(languages), (1 << BITS) + 1))
    index = {name: i for i, name in enumerate(languages)}
    if len(found):
        np.add.at(table, (found["lang"].map(index).to_numpy(), found["bucket"].to_numpy()), found["n"].to_numpy())
    texts, grams = table[:, -1], table[:, :-1] + SMOOTHING
    weights = np.log(grams / grams.sum(axis=1, keepdims=True)) if languages else grams
    prior = np.log((texts + 1) / (texts + 1).sum()) if languages else texts
    return LanguageModel(languages, np.ascontiguousarray(weights.T, dtype=np.float32), prior)


def score(model: LanguageModel, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The likeliest language and its probability (of the n-grams taken as a sample) per text."""
    names, probability = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not model.languages:
        return names, probability
    for lo, hi, grams in ngrams.buckets(texts, SIZES, BITS):
        logs = np.tile(model.prior, (hi - lo, 1))
        for owner, h in grams:
            if not len(h):
                continue
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            logs[owner[first] - lo] += np.add.reduceat(model.weights[h], first, axis=0, dtype=np.float64)
        best = logs.argmax(axis=1)
        p = 1.0 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        for i in range(lo, hi):
            if _LETTER.search(texts[i]):
                names[i], probability[i] = model.languages[best[i - lo]], p[i - lo]
    return names, probability


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    bound_batches(docs.sparkSession)
    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names, p = score(shared.value, _texts(pdf["text"]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": names, "score": p})

    return picked.mapInPandas(run, schema(("doc_id", picked.schema["doc_id"].dataType), ("lang_pred", "string"),
                                          ("score", "double")))


def op4_language_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``, learned from the rows
    whose crc32 of the id leaves 0, 1 or 3 by 4."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    model = train(docs, ~held_out)
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
