"""Line-first quality cleaning.

Each line of a text is judged alone: its end punctuation, whether it is a
navigation row, whether it is boilerplate, shouted, or mostly symbols or
repeated words. Failing lines are removed; a document that loses too large a
share of its word characters is rejected, as is one that fails the document
rules (too few words, or mostly repeated three-word windows).

Defined cases: a null or empty text has no words, no lines and is rejected;
repeated rows are judged alike; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from airops.llm import textops
from airops.llm.common import bound_batches, read_table, schema

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
#: A document is rejected if it keeps less than this share of its word characters.
KEPT_SHARE = 0.5
#: Line rules: symbols a word, words of one navigation cell, shares of capitals and of one word.
SYMBOLS_A_WORD, NAV_CELL_WORDS, SHOUT_SHARE, SAME_WORD_SHARE = 0.5, 3, 0.7, 0.4
#: A line of at most so many words without end punctuation is a navigation or button label.
LABEL_WORDS = 4
#: Phrases that make a short line boilerplate.
BOILERPLATE = re.compile(
    rb"all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|accept (?:all )?cookies"
    rb"|enable javascript|lorem ipsum|click here|sign up for|subscribe to our|powered by|back to top"
    rb"|skip to (?:main )?content|share (?:this|on)|log ?in or register|copyright (?:\(c\)|\xc2\xa9)"
    rb"|licensed under|released under the", re.I)
BOILERPLATE_WORDS = 15
_END = re.compile(rb"(?:[.!?:;\"')\]]|\xe2\x80[\xa6\x9d\x99]|\xc2\xbb|\xe3\x80\x82)$")
_CELLS = re.compile(rb"[|>\xc2\xbb\xb7]|\xe2\x80\xba")
RULES = ("label", "navigation", "boilerplate", "shouted", "symbols", "repeated")


def line_fails(words: list[bytes]) -> str | None:
    """The first rule that a line (its words) fails, or None."""
    line = b" ".join(words)
    n = len(words)
    bars = line.count(b"|")
    if bars >= 2 and n / (bars + 1) <= NAV_CELL_WORDS:
        return "navigation"
    if n <= BOILERPLATE_WORDS and BOILERPLATE.search(line):
        return "boilerplate"
    marks = len(line) - len(line.translate(None, SYMBOLS))
    if marks - bars > SYMBOLS_A_WORD * n:
        return "symbols"
    if n >= 5:
        text = line.decode("utf-8", "replace")
        upper = sum(map(str.isupper, text))
        if upper > SHOUT_SHARE * sum(map(str.isalpha, text)) and upper >= 20:
            return "shouted"
        if n >= 10 and max(map(words.count, set(words))) > SAME_WORD_SHARE * n:
            return "repeated"
    if n <= LABEL_WORDS and not _END.search(line):
        return "label"
    return None


def clean_lines(text: bytes) -> tuple[list[bytes], int, int, dict[str, int]]:
    """(lines kept, word bytes kept, word bytes in all, lines removed by rule).
    A line equal to an earlier one is removed as ``repeated``."""
    kept, left, total, by_rule, seen = [], 0, 0, {}, set()
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        size = sum(map(len, words))
        total += size
        rule = "repeated" if line in seen else line_fails(words)
        seen.add(line)
        if rule:
            by_rule[rule] = by_rule.get(rule, 0) + 1
        else:
            kept.append(line)
            left += size
    return kept, left, total, by_rule


def _repeat_words(h: np.ndarray) -> int:
    """Words in three-word windows that occur twice or more."""
    win = textops.windows_hash(h, 3)
    if not len(win):
        return 0
    order = np.argsort(win, kind="stable")
    same = win[order][1:] == win[order][:-1]
    twice = np.zeros(len(win) + 2, dtype=bool)
    hit = np.concatenate([order[1:][same], order[:-1][same]])
    for j in range(3):
        twice[hit + j] = True
    return int(twice.sum())


def judge(texts: list[bytes]) -> dict[str, list]:
    """The base figures and the verdict of each text."""
    out = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                           "base_failed", "kept", "kept_share", "n_lines_removed")}
    for lo, hi in textops.steps(texts):
        w = textops.Words(texts[lo:hi])
        for i, b in enumerate(texts[lo:hi]):
            n = int(w.first[i + 1] - w.first[i])
            repeats = _repeat_words(w.hash[w.first[i]:w.first[i + 1]])
            lines = [x for x in b.split(b"\n") if x.split()]
            solid = b.translate(None, SPACES)
            failed = n < MIN_WORDS or 100 * repeats > 50 * n
            _, left, total, by_rule = clean_lines(b)
            share = left / total if total else 0.0
            for k, v in (("n_words", n), ("word_chars", len(solid.decode("utf-8", "surrogatepass"))),
                         ("n_symbols", len(b) - len(b.translate(None, SYMBOLS))),
                         ("n_dup_lines", len(lines) - len(set(lines))), ("n_repeat_words", repeats),
                         ("base_failed", failed), ("kept", not failed and share >= KEPT_SHARE),
                         ("kept_share", share), ("n_lines_removed", sum(by_rule.values()))):
                out[k].append(v)
    return out


def line_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 with_text: bool = False) -> DataFrame:
    """One row per document with its figures and verdict, and with ``with_text``
    the cleaned text (the kept lines)."""
    bound_batches(docs.sparkSession)
    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = textops.as_bytes(pdf["text"])
            out = pd.DataFrame({"doc_id": pdf["doc_id"], **judge(texts)})
            if with_text:
                out["clean_text"] = [b"\n".join(clean_lines(t)[0]).decode("utf-8", "surrogatepass") for t in texts]
            yield out

    return picked.mapInPandas(run, schema(
        ("doc_id", picked.schema["doc_id"].dataType), ("n_words", "bigint"), ("word_chars", "bigint"),
        ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"),
        ("base_failed", "boolean"), ("kept", "boolean"), ("kept_share", "double"),
        ("n_lines_removed", "bigint"), *([("clean_text", "string")] if with_text else [])))


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of every whole text of ``documents``."""
    return line_quality(read_table(spark, sf_dir, "documents"))
