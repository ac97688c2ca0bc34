"""Session settings and the shared folder that jobs may write to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

# Set only where the user has not chosen a value.
#   forceOptimizeSkewedJoin: a join on a hot key is split at run time even when
#     the next operator wanted to reuse the join's partitioning (one more
#     exchange is far cheaper than one task holding a third of the rows).
#   fileCompressionFactor: Parquet columns grow several times when decoded, so a
#     table counts as small enough to broadcast by its decoded size.
#   optimizeSkewsInRebalancePartitions: writes go through REBALANCE, which splits hot partitions.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.fileCompressionFactor": "4.0",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}

# While layers are built, set only where the user has not chosen a value.
#   fileCleanup: a job's shuffle files go when it ends, not when the driver happens to collect its garbage.
#   codec: the tables of a build lie beside its shuffles; zstd takes less room than the default.
BUILDING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def build_session(app: str = "strata", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this library's defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the defaults to a session somebody else built, keeping its own choices."""
    for key, value in DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster a machine-local folder would lose data with its machine.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="strata-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run's tables, below the shared folder."""
    return f"{shared_dir(spark)}/strata/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def building(spark: SparkSession) -> Iterator[None]:
    """The settings of :data:`BUILDING` hold inside, for all threads of the session."""
    mine = {k: v for k, v in BUILDING.items() if spark.conf.get(k, None) is None}
    for key, value in mine.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in mine:
            spark.conf.unset(key)


_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What :func:`intermediate_dir` names inside is removed at the end; frames built on it must be stored by then."""
    folder = run_dir(spark, "scratch")
    token = _SCRATCH.set(folder)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def intermediate_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for an intermediate table: of the run in progress, else it stays in the shared folder."""
    own = _SCRATCH.get()
    return f"{own}/{name}-{uuid.uuid4().hex[:12]}" if own else run_dir(spark, name)
