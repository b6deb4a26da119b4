"""Secret scans by corpus-wide ownership frequency.

Every text gives candidates: matches of three fixed patterns and, besides
these, bare tokens that look random. A candidate's value is hashed, and the
hash is counted over the whole corpus by distinct repositories and distinct
owners (by default ``source``; a document is a repository). A value that many
owners hold, or some owners in many repositories, is a published example; one
that few owners hold and that looks random is a live credential, in however many
repositories of one owner it stands. Pattern matches are always reported; a bare
token that looks random is reported (kind ``owned``) only where its value is
live, or is the value of a pattern match elsewhere. A live value is masked
without the key word before it.

Defined cases: a null text is empty and has no candidate; a null owner or
repository counts as one unknown owner or repository; repeated rows are
separate rows that count one repository; an empty table gives no rows; further
columns are ignored by ``scan_secrets`` and kept by ``redact_secrets``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airops.llm.common import bound_batches, fresh_names, keep_rows, read_table, schema, written

# The patterns of the three base kinds and their least lengths.
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex", "owned")
#: Words that mark a value as a placeholder.
PLACEHOLDERS = ("example", "sample", "dummy", "changeme", "placeholder", "your", "xxxx", "0000")

#: A bare token: this many characters, with letters and this many digits.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=-]{20,}")
TOKEN_DIGITS = 3
#: Values that at least this many owners hold are published examples.
EXAMPLE_OWNERS = 4
#: So are values of fewer owners, but more than one, in at least this many repositories.
EXAMPLE_REPOS = 50
#: Bits a character that a random-looking value has at least.
LIVE_BITS = 2.5

_DIGIT = re.compile(r"[0-9]")
_SPAN = "array<struct<kind:int,start:int,end:int,value:string,live:boolean>>"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of the three patterns, leftmost non-overlapping per kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)
                if m.end() - m.start() >= ACCESS_LEAST]
    out += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], x[0]))


def looks_live(value: str) -> bool:
    """Random-looking: letters and digits, many different characters, no placeholder word."""
    low = value.lower()
    if not _DIGIT.search(value) or not any(c.isalpha() for c in value):
        return False
    if any(p in low for p in PLACEHOLDERS):
        return False
    n = len(value)
    return -sum((k := value.count(c)) / n * log2(k / n) for c in set(value)) >= LIVE_BITS


def candidates(text: str) -> list[tuple[int, int, int, str, bool]]:
    """The pattern matches and, outside of them, the bare tokens, by start."""
    base = base_spans(text)
    found = [(*s, looks_live(s[3])) for s in base]
    if _DIGIT.search(text):
        for m in TOKEN.finditer(text):
            if sum(c.isdigit() for c in m[0]) >= TOKEN_DIGITS and looks_live(m[0]) and not any(
                    s[1] < m.end() and m.start() < s[2] for s in base):
                found.append((3, m.start(), m.end(), m[0], True))
    return sorted(found, key=lambda x: (x[1], x[0]))


def _find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = [t if isinstance(t, str) else "" for t in pdf.pop("text")]
        pdf["spans"] = [[dict(zip(("kind", "start", "end", "value", "live"), s)) for s in candidates(t)]
                        for t in texts]
        yield pdf


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """One row per document: its key (``doc_id``, ``text_key``), owner, repository, candidate spans."""
    bound_batches(docs.sparkSession)
    picked = docs.select(
        docs[id_col].alias("doc_id"), text_key(docs[text_col]).alias("text_key"),
        F.coalesce(docs[owner_col].cast("string"), F.lit("")).alias("owner"),
        F.coalesce(docs[repo_col].cast("string"), F.lit("")).alias("repo"), docs[text_col].alias("text"))
    out = schema(("doc_id", picked.schema["doc_id"].dataType), ("text_key", "bigint"), ("owner", "string"),
                 ("repo", "string"), ("spans", _SPAN))
    return picked.mapInPandas(_find, out)


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def ownership(found: DataFrame, example_owners: int = EXAMPLE_OWNERS,
              example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """Per value hash: in how many repositories and with how many owners it
    occurs, whether a pattern matched it anywhere, and its verdict."""
    each = found.select("owner", "repo", F.explode("spans").alias("s")).select(
        "owner", "repo", F.sha2(F.col("s.value"), 256).alias("value_sha256"),
        (F.col("s.kind") < 3).alias("based"), F.col("s.live").alias("live"))
    # one row per value and owner first, so that a widely copied value meets in
    # one group as its owners, not as its copies
    by_repo = each.groupBy("value_sha256", "owner", "repo").agg(F.max("based").alias("based"),
                                                                F.max("live").alias("live"))
    by_owner = by_repo.groupBy("value_sha256", "owner").agg(
        F.max("based").alias("based"), F.max("live").alias("live"), F.count("*").alias("repos"))
    return by_owner.groupBy("value_sha256").agg(
        F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.max("based").alias("based"),
        F.max("live").alias("live")).withColumn(
        "verdict", F.when((F.col("n_owners") >= example_owners) | (
            (F.col("n_owners") > 1) & (F.col("n_repos") >= example_repos)), "example")
        .when(F.col("live"), "live").otherwise("weak"))


def findings(found: DataFrame, owned: DataFrame) -> DataFrame:
    """One row per reported span: key, kind, start, end, value hash, ownership and verdict."""
    each = found.select("doc_id", "text_key", F.explode("spans").alias("s")).select(
        "doc_id", "text_key", "s.kind", "s.start", "s.end", F.length("s.value").alias("size"),
        F.sha2(F.col("s.value"), 256).alias("value_sha256"))
    judged = each.join(owned, "value_sha256")
    return judged.where((F.col("kind") < 3) | (F.col("verdict") == "live") | F.col("based"))


def scan_secrets(docs: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(one row per document with its candidates, one row per reported span)."""
    found = written(find_candidates(docs, **columns), "secrets")
    return found, findings(found, ownership(found))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, **columns: str) -> DataFrame:
    """Per document: base counts, the digest of the base spans, and all spans."""
    found, spans = scan_secrets(docs, **columns)
    per_doc = spans.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("all"),
        F.count_if(F.col("verdict") == "live").alias("n_live"),
        F.count_if(F.col("verdict") == "example").alias("n_example"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    base = found.select(
        "doc_id", "text_key", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"))
    right = per_doc.withColumnsRenamed({"doc_id": "r_doc_id", "text_key": "r_text_key"})
    return base.join(right, base["text_key"].eqNullSafe(F.col("r_text_key"))
                     & base["doc_id"].eqNullSafe(F.col("r_doc_id")), "left").select(
        base["doc_id"], "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce(_joined(F.col("all")), F.lit("")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))


def _masked(text: str, spans) -> str:
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["end"] <= at:
            continue
        out += [text[at:max(at, s["start"])], f"<{KINDS[s['kind']]}:{s['sha'][:8]}>"]
        at = s["end"]
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   length_col: str = "n_chars", **columns: str) -> DataFrame:
    """The documents with each live credential replaced by a tag of its kind and
    hash; published examples stay. All rows and columns stay; where the table
    has ``length_col``, it follows the text."""
    names, kinds = docs.columns, docs.schema
    key, hit_id, hit_key, masks, masked = fresh_names(docs, "text_key", "hit_id", "hit_key", "masks", "masked")
    found, spans = scan_secrets(docs, id_col=id_col, text_col=text_col, **columns)
    # the value only: the key word before it stays
    live = spans.where(F.col("verdict") == "live").groupBy(
        F.col("doc_id").alias(hit_id), F.col("text_key").alias(hit_key)).agg(F.collect_set(F.struct(
            "kind", (F.col("end") - F.col("size")).alias("start"), "end", F.col("value_sha256").alias("sha"))).alias(masks))
    # a text without any candidate stays as it is and needs no shuffle
    has = lambda texts: [bool(candidates(t)) if t else False for t in texts]
    clean = keep_rows(docs, text_col, lambda texts: [not x for x in has(texts)])
    some = keep_rows(docs, text_col, has)
    left = some.withColumn(key, text_key(some[text_col]))
    joined = left.join(live, F.col(key).eqNullSafe(F.col(hit_key)) & F.col(f"`{id_col}`").eqNullSafe(F.col(hit_id)),
                       "left")
    at = names.index(text_col)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(len(names)).to_pylist()
            texts = [t if s is None else _masked(t, s) for t, s in zip(batch.column(at).to_pylist(), spans)]
            columns = batch.columns[:len(names)]
            columns[at] = pa.array(texts, type=columns[at].type)
            hit = pa.array([s is not None for s in spans], type=pa.bool_())
            yield pa.RecordBatch.from_arrays([*columns, hit], names=[*names, masked])

    out = joined.select(*[F.col(f"`{n}`") for n in names], masks).mapInArrow(
        mask, T.StructType([*kinds.fields, T.StructField(masked, T.BooleanType())]))
    if length_col in names:
        out = out.withColumn(length_col, F.when(F.col(masked), F.length(F.col(f"`{text_col}`")).cast(
            kinds[length_col].dataType)).otherwise(F.col(length_col)))
    return clean.union(out.select(*[F.col(f"`{n}`") for n in names]))


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text of ``documents``: the base spans and the owned ones."""
    return secret_report(read_table(spark, sf_dir, "documents"))
