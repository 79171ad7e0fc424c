"""Positions in an order over all rows, without gathering the rows in one task."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastra.session import checkpointed, salted_join


def with_position(rows: DataFrame, order: list, name: str = "position") -> DataFrame:
    """`rows` with their number from 1 in `order` (columns that should be unique together; ties fall in any order).

    Rows are sorted by ranges over all tasks, numbered in each, and each range starts after the rows of those before it.
    Only a count per partition is put on one task. The sorted rows are kept in the checkpoint folder, so a retried task
    cannot number other rows than before.
    """
    sort = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    placed = checkpointed(placed)
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as there are partitions
    starts = counts.select("__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    joined = placed.join(F.broadcast(starts), "__part")
    return joined.withColumn(name, F.col("__at") - F.col("__first") + F.col("__before") + 1).drop("__part", "__at", "__first", "__before")


def with_group_position(rows: DataFrame, groups: list[str], order: list, name: str = "position") -> DataFrame:
    """`rows` with their number from 1 within their group; a group with a third of all rows is spread over many tasks.

    As with_position, sorted by group and order; a group's rows in one range continue after its rows in the ranges before.
    """
    sort = [F.col(c) for c in groups] + [F.col(c) if isinstance(c, str) else c for c in order]
    placed = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    placed = checkpointed(placed.withColumn("__group", F.xxhash64(*groups)))
    counts = placed.groupBy("__group", *groups, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy("__group", *groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).select(*[F.col(g).alias(f"__k_{g}") for g in groups], "__group", "__part", "__first", "__before")
    joined = salted_join(placed, starts, ["__group", "__part"], [F.col("__at")])
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__k_{g}"))
    return joined.where(same).withColumn(name, F.col("__at") - F.col("__first") + F.col("__before") + 1).select(*rows.columns, name)
