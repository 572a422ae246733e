"""Keeping the row index up to date from a folder that receives new files.

The checkpoint of the stream remembers which files were read. Each batch overwrites its own part of
the index, so a batch repeated after a failure replaces what the broken attempt left. A batch stores
its rows with their copies; a row that comes again in a later batch adds copies there, and
`stream_index` sums them, so that the counts are those of the source.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from snapscope.operators.text_index import INDEX_SCHEMA, folded, index_rows

BATCH_SCHEMA = INDEX_SCHEMA + ", batch BIGINT"


def _path_value(name: str) -> str:
    """A partition value as it may appear in a path."""
    return re.sub(r"[\x00-\x1f\"#%'*/:=?\\\x7f{\[\]^]", lambda m: f"%{ord(m.group()):02X}", name)


def _index_batch(table: str, index_path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        part = f"{index_path}/table_name={_path_value(table)}/batch={batch_id}"
        folded(index_rows(table, batch)).drop("table_name").write.mode("overwrite").parquet(part)

    return write


def stream_index(spark: SparkSession, index_path: str) -> DataFrame:
    """The index over all batches, each row once with the copies of all batches together."""
    return folded(spark.read.schema(BATCH_SCHEMA).parquet(index_path).drop("batch"))


def follow_folder(
    spark: SparkSession, folder: str, table: str, schema: str, index_path: str, checkpoint: str, kind: str = "parquet",
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Index every new file of a table's folder and stop when none is left; run again to continue."""
    rows = (
        spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true").load(folder)
    )
    return (
        rows.writeStream.foreachBatch(_index_batch(table, index_path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
