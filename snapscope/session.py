"""Session helpers: a local session for tests and scripts, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(
    cpus: str | int = "*", name: str = "snapscope", partitions: int | None = None, conf: dict[str, str] | None = None
) -> SparkSession:
    partitions = partitions or (os.cpu_count() if cpus == "*" else int(cpus))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SNAPSCOPE_DRIVER_MEMORY", "8g"))
    )
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`; only a local session without one gets a folder of its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and context.master.startswith("local"):
        folder = context._snapscope_checkpoints = getattr(
            context, "_snapscope_checkpoints", None
        ) or tempfile.mkdtemp(prefix="snapscope-checkpoints-")
    if folder is None:
        raise ValueError("name a shared folder in spark.checkpoint.dir")
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """Results formed inside leave no shuffle files behind; for those that are stored and whose plan is not run again."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


# Bytes of sources whose rows one part of a shuffle takes, and the most that a source of unknown size is not said to have.
PART_BYTES, KNOWN_BYTES, PARTS_MOST = 16 << 20, 1 << 50, 10_000


def parts_by_size(spark: SparkSession, sources: Iterable[DataFrame], part_bytes: int = PART_BYTES) -> int:
    """Parts for a shuffle of the sources' rows: more where they are large, by the bytes their plans tell; no job is run for it."""
    told = [df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() for df in sources]
    wanted = min(PARTS_MOST, sum(n for n in told if n < KNOWN_BYTES) // part_bytes)
    return max(wanted, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shuffled_by_size(spark: SparkSession, sources: Iterable[DataFrame]) -> AbstractContextManager[None]:
    """Results formed inside are shuffled into `parts_by_size`."""
    return _setting(spark, "spark.sql.shuffle.partitions", str(parts_by_size(spark, sources)))


def files_open(spark: SparkSession, n: int) -> AbstractContextManager[None]:
    """A task that writes inside holds the files of up to `n` partitions open together; only rows of further ones are sorted first."""
    # A task that reaches the number set sorts what is left.
    return _setting(spark, "spark.sql.maxConcurrentOutputFileWriters", str(n + 1))


def settled(df: DataFrame) -> DataFrame:
    """Cut the lineage of an intermediate result that several later plans read, by a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint()
