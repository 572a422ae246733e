"""Positions in a total order without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapscope.functions.names import col
from snapscope.session import settled


def with_prefix_sums(df: DataFrame, order: Sequence[str], group: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """For each row, sums over the rows of its group that come before it; `sums` maps new names to columns of whole numbers.

    Rows are range-partitioned by (group, order), summed inside each part and shifted by the sums of the group's
    earlier parts, which is one small row per group and part. Rows that agree in all order columns land in one part.
    """
    groups, keys = [col(g) for g in group], [col(c) for c in [*group, *order]]
    spread = df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())
    # Settled, because the part numbers are read by two branches and must be the same in both.
    placed = settled(spread)
    sizes = placed.groupBy(*groups, "_part").agg(*[F.sum(c).alias(f"_n{i}") for i, c in enumerate(sums.values())])
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*groups, "_part", *[F.coalesce(F.sum(f"_n{i}").over(earlier), F.lit(0)).alias(f"_start{i}") for i in range(len(sums))])
    before = Window.partitionBy(*groups, "_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumns({f"_inside{i}": F.coalesce(F.sum(c).over(before), F.lit(0)) for i, c in enumerate(sums.values())})
    return inside.join(starts, [*group, "_part"]).select(
        *[col(c) for c in df.columns],
        *[(F.col(f"_start{i}") + F.col(f"_inside{i}")).cast("bigint").alias(n) for i, n in enumerate(sums)],
    )


def with_positions(
    df: DataFrame, order: Sequence[str], group: Sequence[str] = (), weight: str | None = None, name: str = "position"
) -> DataFrame:
    """Add the position of each row within its group, counted from 0; `weight` names how many places a row takes.

    Fold equal rows into a weight first: rows that agree in all order columns aren't spread.
    """
    placed = df if weight is not None else df.withColumn("_one", F.lit(1))
    return with_prefix_sums(placed, order, group, {name: weight or "_one"}).drop("_one")
