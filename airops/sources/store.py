"""Snapshots in buckets: a command batch writes only the buckets that it changed.

A store holds the tables cut into buckets by the hash of their primary key:

    <path>/<table>/<commit>/bucket=<k>/   the rows that a commit wrote of one bucket
    <path>/manifests/<commit>             per table and bucket: commit, rows, digest
    <path>/versions/<n>                   the commit that is version n

A version is a manifest, so that a reader of an older one is never disturbed, and
a commit is published by creating one small file that must not exist: of two
batches on the same base one wins, the other gets ``StaleSnapshot`` and can be
applied anew. Files of a commit that was not published are never read.

Which buckets a batch changed is told by the digests (row count and two sums of
64-bit row hashes) of the changed tables, one aggregate with a row per bucket,
against those in the manifest: the old rows are not read for it. Keys are spread by
hash, so buckets are alike in size; a bucket is dealt to several tasks by another
hash of the key, so that few buckets hold back neither cores nor memory. The manifest, ``tables x buckets`` entries, is
what passes through the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airops.schema import PRIMARY_KEYS, TABLE_SCHEMAS
from airops.sources.tables import Tables, _conform

BUCKETS = 64
#: A bucket is written by this many tasks and files, at most.
SLICES = 16


class StaleSnapshot(RuntimeError):
    """Another batch was published on the same base first."""


@dataclass(frozen=True)
class Stored:
    """One version of a store; ``entries[table][bucket]`` is (commit, rows, digest)."""

    path: str
    version: int
    tag: str | None
    buckets: int
    entries: dict[str, dict[int, tuple[str, int, str]]]
    tables: Tables


def _bucket(table: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(PRIMARY_KEYS[table]), F.lit(buckets)).cast("int")


def _digests(frames: Mapping[str, DataFrame], buckets: int) -> dict[str, dict[int, tuple[int, str]]]:
    """(rows, digest) of each bucket of each table that has rows."""
    parts = None
    for name, df in frames.items():
        # nulls leave a hash as it is, so they are hashed as flags besides
        row = [*df.columns, *[F.isnull(c) for c in df.columns]]
        sums = [F.sum(F.xxhash64(F.lit(k), *row).cast("decimal(20,0)")).cast("string") for k in (1, 2)]
        part = df.groupBy(_bucket(name, buckets).alias("bucket")).agg(
            F.count(F.lit(1)).alias("n"), F.concat_ws(":", *sums).alias("digest")).select(
            F.lit(name).alias("table"), "bucket", "n", "digest")
        parts = part if parts is None else parts.unionByName(part)
    out: dict[str, dict[int, tuple[int, str]]] = {name: {} for name in frames}
    for r in parts.collect() if parts is not None else []:
        out[r["table"]][r["bucket"]] = (r["n"], r["digest"])
    return out


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _create(spark: SparkSession, path: str, content: str) -> bool:
    """Write a file that must not exist yet; False if it does."""
    fs, at = _file(spark, path)
    if fs.exists(at):
        return False
    try:
        out = fs.create(at, False)  # atomic: of two creators one fails
    except Exception as e:  # noqa: BLE001 - the file system's own "exists" error
        if fs.exists(at):
            return False
        raise e
    out.write(content.encode("utf-8"))
    out.close()
    return True


def _text(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path, wholetext=True).first()
    return row[0] if row else ""


def latest_version(spark: SparkSession, path: str) -> int:
    """The number of the newest version, -1 where there is no store."""
    fs, at = _file(spark, f"{path}/versions")
    return max((int(f.getPath().getName()) for f in fs.listStatus(at)), default=-1) if fs.exists(at) else -1


def _publish(spark: SparkSession, path: str, version: int, commit: str, tag: str | None, buckets: int,
             entries: dict) -> None:
    manifest = {"tag": tag, "buckets": buckets, "entries": {
        t: {str(k): list(e) for k, e in sorted(of.items())} for t, of in entries.items()}}
    _create(spark, f"{path}/manifests/{commit}", json.dumps(manifest))
    if not _create(spark, f"{path}/versions/{version}", commit):
        raise StaleSnapshot(f"version {version} of {path} exists already")


def _write(frames: Mapping[str, DataFrame], path: str, commit: str, buckets: int, touched: Mapping[str, list[int]]) -> None:
    for name, df in frames.items():
        if touched[name]:
            at, part = _bucket(name, buckets), F.pmod(F.hash(PRIMARY_KEYS[name]), F.lit(SLICES))
            # small parts meet in one task again (AQE); a large bucket is not sorted by one
            (df.withColumn("bucket", at).where(F.col("bucket").isin(touched[name])).repartition("bucket", part)
             .sortWithinPartitions("bucket", PRIMARY_KEYS[name])
             .write.partitionBy("bucket").parquet(f"{path}/{name}/{commit}"))


def create_store(tables: Mapping[str, DataFrame], path: str, buckets: int = BUCKETS) -> Stored:
    """Version 0 of a new store, with all rows of the tables."""
    return _committed(tables, path.rstrip("/"), -1, buckets, {}, None)


def open_store(spark: SparkSession, path: str, version: int | None = None) -> Stored:
    """A version of the store, the newest by default."""
    path = path.rstrip("/")
    version = latest_version(spark, path) if version is None else version
    if version < 0:
        raise AnalysisException(f"no store in {path}")
    commit = _text(spark, f"{path}/versions/{version}")
    if not commit:
        raise StaleSnapshot(f"version {version} of {path} is being published")
    manifest = json.loads(_text(spark, f"{path}/manifests/{commit}"))
    entries = {t: {int(k): tuple(e) for k, e in of.items()} for t, of in manifest["entries"].items()}
    frames = {}
    for name, of in entries.items():
        files = [f"{path}/{name}/{c}/bucket={k}" for k, (c, _, _) in sorted(of.items())]
        frames[name] = (spark.read.schema(TABLE_SCHEMAS[name]).parquet(*files) if files
                        else spark.createDataFrame([], TABLE_SCHEMAS[name]))
    return Stored(path, version, manifest["tag"], manifest["buckets"], entries, Tables(spark, frames, source=path))


def commit_batch(base: Stored, changed: Mapping[str, DataFrame], tag: str | None = None) -> Stored:
    """Publish the tables that a command batch changed as the version after ``base``.

    Raises ``StaleSnapshot``, before anything is written where it can, if ``base``
    is not the newest version. ``tag`` is kept with the version."""
    spark = base.tables.spark
    if latest_version(spark, base.path) != base.version:
        raise StaleSnapshot(f"version {base.version} of {base.path} is not the newest")
    return _committed(changed, base.path, base.version, base.buckets, base.entries, tag)


def _committed(changed: Mapping[str, DataFrame], path: str, version: int, buckets: int, before: dict,
               tag: str | None) -> Stored:
    frames = {name: _conform(df, name) for name, df in changed.items()}
    now, commit = _digests(frames, buckets), uuid.uuid4().hex
    touched = {name: sorted(k for k, figures in of.items() if before.get(name, {}).get(k, (None,))[1:] != figures)
               for name, of in now.items()}
    _write(frames, path, commit, buckets, touched)
    # a bucket that lost its last row leaves the manifest
    entries = {**before, **{name: {k: (commit, *figures) if k in touched[name] else before[name][k]
                                   for k, figures in of.items()} for name, of in now.items()}}
    spark = next(iter(frames.values())).sparkSession if frames else SparkSession.active()
    _publish(spark, path, version + 1, commit, tag, buckets, entries)
    return open_store(spark, path, version + 1)
