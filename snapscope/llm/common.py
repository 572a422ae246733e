"""What the operators of this subpackage share: shared storage, joins that survive hot keys, byte-level words."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# At most so many keys, those with the most rows from HOT_ROWS on, are dealt out over SALTS parts.
HOT_KEYS, HOT_ROWS = 2000, 1000
SALTS = 64
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a folder of its own only where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="snapscope-shared-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame, written to shared storage and read back: later plans start from the files."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few_files(df: DataFrame) -> DataFrame:
    """What a shuffle has made, in as many tasks as twice the cores: narrow tables aren't stored in countless files."""
    return df.coalesce(max(8, 2 * df.sparkSession.sparkContext.defaultParallelism))


def bounded_batches(df: DataFrame) -> None:
    """Bounds what a Python worker is handed at a time by bytes, whatever the length of the texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def join_small_groups(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, salt: Column) -> DataFrame:
    """Left join of rows with facts on keys, where facts has one line per key with the number of rows it meets.

    A hot key gets several copies of its line, one for each of its parts, and its rows are dealt out over the
    parts by `salt` (any integer that differs between rows). Rows can't know whether their key is hot, so the hot
    keys are sent to them: HOT_KEYS at most. No other key can then hold more than 1/HOT_KEYS of the rows.
    """
    hot = facts.where(F.col(count) >= HOT_ROWS).orderBy(F.col(count).desc(), *keys).limit(HOT_KEYS)
    hot = F.broadcast(hot.select(*(F.col(k).alias(f"_hot_{k}") for k in keys), F.lit(True).alias("_is_hot")))
    condition = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys))

    def marked(df: DataFrame, parts: Column) -> DataFrame:
        return df.join(hot, condition, "left").withColumn("_part", parts).drop("_is_hot", *(f"_hot_{k}" for k in keys))

    dealt = marked(rows, F.when(F.col("_is_hot"), F.pmod(salt, F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    copies = marked(facts, F.explode(F.when(F.col("_is_hot"), every).otherwise(F.array(F.lit(0))))).drop(count)
    return dealt.join(copies, [*keys, "_part"], "left").drop("_part")
