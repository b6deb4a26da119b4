"""What the operators of this subpackage share on the Spark side."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airops.session import opened_together, scratch_table, temporary

#: Bytes of text in one Arrow batch that a Python worker gets, and rows in it.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 500


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, where the session doesn't set it lower."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
                       ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        try:
            now = spark.conf.get(key)
        except Exception:  # noqa: BLE001 - a release without this setting
            continue
        digits = "".join(c for c in now if c.isdigit())
        if not digits or int(digits) <= 0 or int(digits) > value:
            spark.conf.set(key, str(value))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared checkpoint folder and reread:
    its lineage ends there, so a lost executor costs no earlier step, and its
    shuffle files are removed."""
    return scratch_table(df, f"llm-{name}")


def written_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``make()`` written; the tables that it has written itself are dropped then."""
    with temporary() as keep:
        return keep(written(make(), name))


def in_passes(make: Callable[[Callable[[Column], Column]], DataFrame], passes: int, name: str) -> DataFrame:
    """All rows of ``make(mine)``, written pass by pass: ``mine`` of a column of hashes
    is true in one of them. Only the shuffle files of one pass are there at a time."""
    return opened_together([written_alone(lambda k=k: make(lambda c: F.pmod(c, F.lit(passes)) == k), name)
                            for k in range(passes)])


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; a null id counts as empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds


def schema(*fields: tuple[str, str | T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(t) if isinstance(t, str) else t)
                         for n, t in fields])


def smallest_hashes(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The ``n`` rows (at most) with the smallest hashes of ``keys``: a sample
    that does not depend on the layout of the table. Rows far above the expected
    cut are left out before the sort, so that a large table sends few rows to it."""
    rows = df.count()
    share = min(1.0, (4.0 * n + 100) / max(1, rows))
    h = F.xxhash64(*keys)
    return df.where(F.pmod(h, F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy(
        F.pmod(h, F.lit(1 << 30)), *keys).limit(n)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until the table has no such column in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def keep_rows(df: DataFrame, text_col: str, keep: Callable[[list], list[bool]]) -> DataFrame:
    """The rows of ``df`` for whose texts ``keep`` (of a list of texts, null as
    None) is true; all columns stay as they are."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(at).to_pylist()), type=pa.bool_()))

    return df.mapInArrow(run, df.schema)
