"""Binding of the twelve airline tables: ``airline_tables`` and ``write_snapshot``.

A directory either holds the tables themselves (``<dir>/<table>.parquet`` or
``<dir>/<table>/``, read with the fixed schema of ``airops.schema``) or the
TPC-H-like test tables, from which they are derived (``fixtures.py``).
"""

from __future__ import annotations

import hashlib
import inspect
import uuid
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from airops.schema import TABLE_SCHEMAS, TABLES
from airops.session import scratch_path, shuffles_removed
from airops.sources import fixtures, requests


class Tables(Mapping):
    """The airline tables of one snapshot, by name. A frame may be given as a function
    without arguments, which is called when the table is first asked for."""

    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame | Callable[[], DataFrame]],
                 extras: dict[str, Callable[[], DataFrame]] | None = None,
                 source: str | None = None):
        self.spark = spark
        self._frames = dict(frames)
        self._extra_builders = dict(extras or {})
        self._extras: dict[str, DataFrame] = {}
        self.source = source

    def __getitem__(self, name: str) -> DataFrame:
        if not isinstance(self._frames[name], DataFrame):
            self._frames[name] = self._frames[name]()
        return self._frames[name]

    def __contains__(self, name: object) -> bool:
        return name in self._frames  # without building it

    def __iter__(self) -> Iterator[str]:
        return iter(self._frames)

    def __len__(self) -> int:
        return len(self._frames)

    def extra(self, name: str) -> DataFrame:
        """Helper frames of the fixture mapping (request batches, wide bookings),
        built on first use."""
        if name not in self._extras:
            self._extras[name] = self._extra_builders[name]()
        return self._extras[name]

    def dim(self, name: str) -> DataFrame:
        """A dimension for joining. No hint: the planner broadcasts it when its
        bytes are below ``spark.sql.autoBroadcastJoinThreshold``."""
        return self[name]

    def replace(self, **changed: DataFrame) -> Tables:
        """A new bundle with some tables replaced (the result of a command batch)."""
        frames = dict(self._frames)
        for k, v in changed.items():
            if k not in frames:
                raise KeyError(k)
            frames[k] = v
        t = Tables(self.spark, frames, self._extra_builders, self.source)
        t._extras = dict(self._extras)
        return t


def _opened(spark: SparkSession, path: str, table: str) -> DataFrame | None:
    """The stored table (a file or folder, on any file system Spark reads), or None."""
    for name in (f"{table}.parquet", table):
        try:
            return spark.read.schema(TABLE_SCHEMAS[table]).parquet(f"{path.rstrip('/')}/{name}")
        except AnalysisException:  # no such path
            continue
    return None


def _bound(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    frames = {}
    for t in TABLES:
        df = _opened(spark, path, t)
        if df is None:
            return None
        frames[t] = df
    return frames


# derived tables by session, path and the state of the raw files: changed files are seen
_CACHE: dict[tuple[int, str, str, bool], Tables] = {}
# version of the derived layout: part of the snapshot key, so a snapshot
# written by an older mapping is never read back
_LAYOUT = "tables12+bookings_wide/v4"


def airline_tables(spark: SparkSession, path: str, materialize: bool = True) -> Tables:
    """Bind the 12 tables found at (or derived from) ``path``, any URI that Spark reads."""
    try:
        key = (id(spark), path, _fingerprint(spark, path), materialize)
    except AnalysisException:  # not the raw tables: the 12 tables themselves
        frames = _bound(spark, path)
        if frames is None:
            raise
        return Tables(spark, frames, source=path)
    hit = _CACHE.get(key)
    if hit is not None and hit.spark is spark:
        return hit
    frames = _bound(spark, path)
    if frames is not None:
        return Tables(spark, frames, source=path)
    frames, extras = (_materialized if materialize else _derived)(spark, path)
    tables = _CACHE[key] = Tables(spark, frames, extras, source=path)
    return tables


def _derived(spark, path):
    raw = fixtures.read_raw(spark, path)
    built: dict[str, DataFrame] = {}

    def get(name: str) -> DataFrame:
        if name not in built:
            df = builders[name]()
            built[name] = _conform(df, name) if name in TABLE_SCHEMAS else df
        return built[name]

    builders = fixtures.table_builders(raw, get)
    return {t: (lambda t=t: get(t)) for t in TABLES}, _extra_builders(raw, lambda: get("_bookings_wide"))


def _extra_builders(raw, bw: Callable[[], DataFrame]) -> dict[str, Callable[[], DataFrame]]:
    """Request batches: short projections of a raw table or of the wide
    bookings, so they are built when asked for, not materialised."""
    out: dict[str, Callable[[], DataFrame]] = {
        "bookings_wide": bw,
        "booking_requests": lambda: fixtures.booking_requests(raw),
        "cancel_requests": lambda: fixtures.cancel_requests(bw()),
        "payment_requests": lambda: fixtures.payment_requests(bw()),
        "boarding_events": lambda: fixtures.boarding_events(bw()),
        "command_log": lambda: fixtures.command_log(raw, bw()),
        "passenger_requests": lambda: fixtures.passenger_requests(raw),
        "passenger_update_requests": lambda: fixtures.passenger_update_requests(raw),
    }
    out.update({n: (lambda b=b: b(raw)) for n, b in requests.BUILDERS.items()})
    return out


def _fingerprint(spark: SparkSession, path: str) -> str:
    """The mapping's code and the names, sizes and times of the raw files, as
    the file system of ``path`` tells them (metadata only)."""
    h = hashlib.sha1(f"{path}\n{_LAYOUT}\n{inspect.getsource(fixtures)}".encode())
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for t in fixtures.RAW_TABLES:
        at = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{t}.parquet")
        fs = at.getFileSystem(conf)
        if not fs.exists(at):
            raise AnalysisException(f"no raw table {t} in {path}")
        for f in sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at)):
            h.update(f"{t}:{f}".encode())
    return h.hexdigest()[:16]


def _materialized(spark, path):
    """Write each derived table once to the checkpoint folder and read it back.

    The fixture mapping is a DAG (seats depend on bookings and boarding
    records, tickets on seats, ...). A table is written when it is first asked
    for, after those that it is derived from, and read back as it would be in
    production: a lost executor re-reads files instead of recomputing the
    mapping, and a query pays for the tables that it reads."""
    base = scratch_path(spark, f"airops-fixture-{_fingerprint(spark, path)}")
    raw = fixtures.read_raw(spark, path)
    opened: dict[str, DataFrame] = {}

    def get(name: str) -> DataFrame:
        if name == "bookings":  # columns of the wide bookings: not written again
            return _conform(builders[name](), name)
        if name not in opened:
            done = f"{base}/{name}/_COMPLETE"
            schema = TABLE_SCHEMAS.get(name, fixtures.BOOKINGS_WIDE_SCHEMA)
            if read_marker(spark, done) is None:
                run = f"{base}/{name}/attempt-{uuid.uuid4().hex[:8]}"
                df = builders[name]()
                with shuffles_removed(spark):
                    (_conform(df, name) if name in TABLE_SCHEMAS else df).write.mode("errorifexists").option(
                        "compression", "zstd").parquet(run)
                write_marker(spark, done, run)
            # fixed schemas: no inference, no re-cast
            opened[name] = spark.read.schema(schema).parquet(read_marker(spark, done))
        return opened[name]

    builders = fixtures.table_builders(raw, get)
    return {t: (lambda t=t: get(t)) for t in TABLES}, _extra_builders(raw, lambda: get("_bookings_wide"))


def read_marker(spark, p: str) -> str | None:
    try:
        row = spark.read.text(p).first()
    except AnalysisException:  # not written yet
        return None
    return row[0] if row else None


def write_marker(spark, p: str, content: str) -> None:
    try:
        spark.range(1).select(F.lit(content).alias("run")).write.mode("errorifexists").text(p)
    except AnalysisException:  # another job finished first; its run is used
        pass


def _conform(df: DataFrame, table: str) -> DataFrame:
    """Select the target columns in order, cast to the target types."""
    schema = TABLE_SCHEMAS[table]
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def write_snapshot(tables: Mapping[str, DataFrame], path: str, version: int | str,
                   only: list[str] | None = None, mode: str = "errorifexists") -> str:
    """Persist tables after a command batch to ``<path>/v<version>/<table>``.

    A new version directory each time: the snapshot being read is never
    overwritten."""
    out = f"{path.rstrip('/')}/v{version}"
    for name in (only or list(tables)):
        tables[name].write.mode(mode).parquet(f"{out}/{name}")
    return out
