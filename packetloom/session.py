"""Session defaults and the written-table helper used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app_name: str = "packetloom", **conf: str) -> SparkSession:
    """A session with the settings the library assumes (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  A local session without that
    setting gets a folder of its own; a cluster session without it is an error, since
    a machine-local folder would be lost together with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="packetloom-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables and models."""
    return f"{checkpoint_root(spark)}/packetloom-{spark.sparkContext.applicationId}"


def release_scratch(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this application once its results are written."""
    drop_tables(spark, [scratch_path(spark)])


def drop_tables(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes written tables that no DataFrame reads any more."""
    configuration = spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(configuration).delete(folder, True)


_watching: ContextVar[tuple[list[str], ...]] = ContextVar("watching", default=())


@contextmanager
def written_tables() -> Iterator[list[str]]:
    """The folders of the tables that :func:`materialize` writes inside."""
    paths: list[str] = []
    outer = _watching.set((*_watching.get(), paths))
    try:
        yield paths
    finally:
        _watching.reset(outer)


def materialize(df: DataFrame, tag: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For results that several later jobs scan: they then read pruned Parquet columns
    instead of recomputing, and losing an executor costs no upstream work.
    """
    spark = df.sparkSession
    path = f"{scratch_path(spark)}/tables/{tag}-{uuid.uuid4().hex}"
    for paths in _watching.get():
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint that keeps the partitioning of ``df``."""
    spark = df.sparkSession
    root = checkpoint_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)
