"""Places and sums along an order of a whole table, without one task that sees all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.sources.checkpoints import materialize


def running_sums(df: DataFrame, order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Add for each name the sum of its column (a whole number, not null) over all rows before, in the order of `order`, whose values are unique.

    Rows are dealt by range and summed up in each partition, and run on there from the sums of the partitions
    before, so no task sees more than its range. The written ranges keep their sums if a task runs again.
    """
    own = {f"__{name}": value.cast("long") for name, value in sums.items()}
    ranged = df.select("*", *(value.alias(name) for name, value in own.items())).repartitionByRange(*order)
    ranged = materialize(ranged.withColumn("__part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("__part").agg(*(F.sum(name).alias(name) for name in own))  # as many rows as partitions
    bases = parts.select("__part", *(F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"{name}_base") for name in own))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = {name: F.col(f"__{name}_base") + F.coalesce(F.sum(f"__{name}").over(inside), F.lit(0)) for name in sums}
    placed = ranged.join(F.broadcast(bases), "__part").withColumns(run)
    return placed.select(*df.columns, *sums)
