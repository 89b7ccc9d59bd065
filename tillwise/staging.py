"""Session settings and staged tables.

A staged table is written once to the shared checkpoint folder and read back. That cuts
the lineage (a lost executor re-reads files instead of recomputing the whole cascade), lets
every consumer prune columns, and gives Catalyst file sizes, so that it broadcasts a join
side only when that side is known to be small.
"""

from __future__ import annotations

import itertools
import re
import tempfile
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.errors import ConfigError

CLUSTER_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # The JVM never compiles a method above this size: a longer one is run as separate steps.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Staged tables and shuffles are packed to a tenth of their rows' size or less. Tasks of the
    # usual 64 and 128 MB would be too few for the cores, and their sorts too large for memory.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.files.maxPartitionBytes": "16m",
    # Rows dealt by the first of several join keys need not be dealt again by all of them.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Rows of a packed file may take fifty times its size, on the driver too, which builds what is
    # broadcast. So only tiny files are broadcast unread; others once a shuffle knows their rows.
    "spark.sql.autoBroadcastJoinThreshold": "256k",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
}
# Of those, the settings that a session made elsewhere is given as well.
SESSION_SETTINGS = (
    "spark.sql.codegen.hugeMethodLimit",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes",
    "spark.sql.files.maxPartitionBytes",
    "spark.sql.requireAllClusterKeysForCoPartition",
)
_UNREAD, _READ = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
_UNITS = {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30}
# Steps of which the jobs may overlap: the last tasks of one leave cores to the next.
OVERLAP = 4
# Packed input for which a shuffle gets one part before small parts are put together.
PART_BYTES = 4 << 20
_PARTS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply the runtime settings the operators are designed for."""
    for key, value in CLUSTER_SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]*)\s*", size.lower()).groups()
    return int(number) << _UNITS[unit]


def broadcast_by_rows(spark: SparkSession) -> None:
    """Let a session broadcast by the size of rows, up to its limit, instead of by that of packed files."""
    limit = spark.conf.get(_UNREAD)
    if _bytes(limit) > _bytes(CLUSTER_SETTINGS[_UNREAD]):
        if spark.conf.get(_READ, None) is None:
            spark.conf.set(_READ, limit)
        spark.conf.set(_UNREAD, CLUSTER_SETTINGS[_UNREAD])


def deal_by_size(spark: SparkSession, paths: list[str]) -> int:
    """Let shuffles start with as many parts as files of this size need; never with fewer than now.

    Spark puts small parts together but does not cut large ones, so that a fixed number of parts
    grows out of memory with the tables, and sorts spill.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    size = files.agg(F.sum("length")).first()[0] or 0
    parts = int(spark.conf.get(_PARTS, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    if size > parts * PART_BYTES:
        parts = -(-size // PART_BYTES)
        spark.conf.set(_PARTS, str(parts))
    return parts


def checkpoint_root(spark: SparkSession) -> str:
    """Return the shared folder for staged tables, setting one only for local sessions."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    active = context.getCheckpointDir()
    if active:
        return active.rstrip("/")
    if not context.master.startswith("local"):
        raise ConfigError("Set spark.checkpoint.dir to a folder shared by all executors.")
    folder = tempfile.mkdtemp(prefix="tillwise-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


def at_once[T](spark: SparkSession, steps: Mapping[str, Callable[[], T]]) -> dict[str, T]:
    """Run steps that do not need each other, some at a time; the first that fails ends it."""
    with ThreadPoolExecutor(OVERLAP) as pool:
        jobs = {name: pool.submit(inheritable_thread_target(spark)(step)) for name, step in steps.items()}
        try:
            return {name: job.result() for name, job in jobs.items()}
        finally:
            pool.shutdown(cancel_futures=True)


class Stage:
    """Writes named tables below one fresh folder and reads them back."""

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark = spark
        base = (root or checkpoint_root(spark)).rstrip("/")
        self.path = f"{base}/stage-{uuid.uuid4().hex}"
        self._number = itertools.count(1)

    def write(self, frame: DataFrame, name: str) -> DataFrame:
        """Write a table under a fresh name that starts with ``name`` and read it back."""
        target = f"{self.path}/{name}-{next(self._number)}"
        frame.write.mode("errorifexists").option("compression", "zstd").parquet(target)
        return self.spark.read.schema(frame.schema).parquet(target)
