"""Session set-up and the one way this library cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


def local_session(app: str = "quadrat", cores: str | int = "*", **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "16g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read, as named by the session.

    A local session may make its own; a cluster without the setting is refused,
    because a machine-local folder would not outlive the machine.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get(CHECKPOINT_DIR)
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder shared by the executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="quadrat-"))
    return context.getCheckpointDir()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle an input that has fewer splits than there are cores; leave others alone.

    A small file may hold one row group, which would keep all row-level work on
    one core.  A large input has more splits than cores and is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def own_path(spark: SparkSession, name: str) -> str:
    """Where an intermediate table goes; ``noting`` tells its caller."""
    path = f"{shared_folder(spark)}/{name}"
    if (held := _noted.get()) is not None:
        held.append(path)
    return path


@contextmanager
def noting() -> Iterator[list[str]]:
    """The paths of the intermediate tables that are written inside."""
    paths: list[str] = []
    before = _noted.set(paths)
    try:
        yield paths
    finally:
        _noted.reset(before)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete intermediate tables, once nothing reads them any more, and forget their paths."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The copy survives the loss of executors, later scans prune its columns, and
    Spark knows its size, so join strategies below it rest on real statistics.
    """
    spark = df.sparkSession
    path = own_path(spark, f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
