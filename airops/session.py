"""Spark session helpers.

The library never creates a session behind the caller's back: every operator
takes DataFrames. ``local_session`` is for tests, the bench and notebooks.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "airops") -> SparkSession:
    """A local session with the settings the package is tested under."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # fixpoint rounds checkpoint every round: drop them once unreferenced
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory of the session.

    On a cluster ``spark.checkpoint.dir`` must name a shared folder; it is
    used as is; where it is unset, the warehouse holds the folder. Only a
    local-mode session without one gets a fresh folder under the system temp
    dir (as in tests)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            configured = None
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):  # a cluster: the warehouse is shared as well
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/airops-checkpoints"
        sc.setCheckpointDir(path)
        return sc.getCheckpointDir() or path
    path = tempfile.mkdtemp(prefix="airops-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the checkpoint folder for written intermediate tables.

    Uses the configured ``spark.checkpoint.dir`` itself (shared by every
    session of the cluster, so a later job can reuse what an earlier one
    wrote); without one, the session's own checkpoint folder."""
    base = (spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
            or spark.conf.get("spark.checkpoint.dir", None)
            or ensure_checkpoint_dir(spark))
    return os.path.join(base, name) if "://" not in base else f"{base.rstrip('/')}/{name}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it has ended. Otherwise they stay
    until the driver happens to collect its garbage; nobody reads them again where
    the result is written to a table. (Releases without the setting ignore it.)"""
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, was)


#: The tables that the innermost ``temporary`` block has written.
_MADE: ContextVar[list[DataFrame] | None] = ContextVar("_MADE", default=None)


def scratch_table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet to the scratch folder and opened again, its shuffle
    files removed. ``drop_tables`` or the end of a ``temporary`` block removes it."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    with shuffles_removed(spark):
        df.write.options(**options).parquet(path)
    return _opened([path], df)


def opened_together(tables: list[DataFrame]) -> DataFrame:
    """Several tables of ``scratch_table`` with the same columns as one."""
    return _opened([path for df in tables for path in df._scratch], tables[0])


def _opened(paths: list[str], like: DataFrame) -> DataFrame:
    out = like.sparkSession.read.schema(like.schema).parquet(*paths)
    out._scratch = tuple(paths)
    made = _MADE.get()
    if made is not None:
        made.append(out)
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Removes tables of ``scratch_table`` that no plan reads any more, on any file
    system; what was removed before is passed over."""
    for df in tables:
        spark = df.sparkSession
        for path in df._scratch:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@contextmanager
def temporary() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are written inside are dropped at its end, but for those given to
    ``keep``, which belong to the block around, if there is one. Frames that are
    returned from it must read kept tables only."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    token = _MADE.set(made)
    try:
        yield keep
    finally:
        _MADE.reset(token)
        paths = {path for df in kept for path in df._scratch}
        drop_tables(*[df for df in made if paths.isdisjoint(df._scratch)])
        around = _MADE.get()
        if around is not None:
            around.extend(kept)


def ship_code(spark: SparkSession) -> None:
    """Let the Python workers import this package: a zip of it is added to the
    session's Python files once. Workers that have it on their path lose nothing."""
    sc = spark.sparkContext
    if any(f.startswith("airops-code-") for f in sc._python_includes):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    top = os.path.dirname(here)
    # the driver serves the file to the executors as long as it runs
    folder = tempfile.mkdtemp(prefix="airops-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"{os.path.basename(folder)}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for where, _, names in os.walk(here):
            for name in sorted(n for n in names if n.endswith(".py")):
                out.write(os.path.join(where, name), os.path.relpath(os.path.join(where, name), top))
    sc.addPyFile(path)
