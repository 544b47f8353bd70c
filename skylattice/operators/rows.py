"""Columns computed once, and row numbers without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns by a generator of one row, so that later filters and projections don't copy their expressions."""
    one = F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*[c for c in df.columns if c not in columns], one)


def numbered(df: DataFrame, *order: Column, name: str = "number") -> DataFrame:
    """Adds the place of each row (from 0) in a total order.

    Rows are range-partitioned and written once; numbers come from the partitions' sizes (one row for
    each shuffle partition), so no task holds more than its range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    ranked = rows.withColumn("_w", within).join(F.broadcast(before), "_part")
    return ranked.withColumn(name, F.col("_before") + F.col("_w") - 1).drop("_part", "_w", "_before")


def numbered_within(df: DataFrame, group: str, *order: Column, name: str = "number", size: str = "size") -> DataFrame:
    """Adds each row's place (from 0) within its group, and the group's number of rows."""
    rows = written(numbered(df, F.col(group), *order, name="_all"), "numbered-groups")
    facts = rows.groupBy(group).agg(F.min("_all").alias("_first"), F.count("*").alias(size))
    return rows.join(facts, group).withColumn(name, F.col("_all") - F.col("_first")).drop("_all", "_first")
