"""Connected components of an edge list: each node hooks its neighbours to the least of them, tasks contract what they hold."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from snapscope.llm.common import few_files, join_small_groups, stored

_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task as (node, least node that they connect it with); duplicates and detours go."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            u, v = find(u), find(v)
            root[max(u, v)] = min(u, v)
    nodes = [x for x in root if find(x) != x]
    for at in range(0, len(nodes), 100_000):
        some = nodes[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([find(x) for x in some], pa.int64())], schema=_EDGES)


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Contracted edges (u, v), stored, and a mark that tells two edge sets apart, taken while they are written."""
    seen = Observation()
    made = few_files(edges).mapInArrow(_contracted, "u long, v long")
    made = made.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    now = stored(made, "edges")
    return now, (seen.get["n"], seen.get["h"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the least node that can be reached.

    In a round each node names the least of itself and its neighbours to all of them, met by join_small_groups, as it may
    have very many. Once nothing changes, every node has its root for its only neighbour. Each round is stored, so a lost executor
    costs that round only. An error, never a partial result, if max_rounds don't suffice.
    """
    now, mark = _stored(edges.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")))
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"), F.count("*").alias("_degree"))
        hooked = join_small_groups(both, least, ["u"], "_degree", F.col("v")).select(F.col("v").alias("u"), F.col("least").alias("v"))
        before, (now, mark) = mark, _stored(hooked.where("u <> v").distinct())
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    raise RuntimeError("the components haven't settled")
