"""Ranks over a whole table, without a window that brings it together in one task."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import shared_folder


def global_row_number(df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """df with the number of each row in the order, from 1; ties fall as they come, so order by a key at last.

    Rows are dealt into ranges of the order, written once, since sampled ranges need not be the same twice, counted by range, and numbered within it.
    """
    folder = f"{shared_folder(df.sparkSession)}/ranks-{uuid.uuid4().hex}"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}).write.parquet(folder)
    rows = df.sparkSession.read.parquet(folder)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ahead = rows.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_ahead"))
    return rows.join(F.broadcast(ahead), "_range").withColumn(name, F.col("_ahead") + F.col("_place") + 1).drop("_range", "_place", "_ahead")


def top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows in the order, and their numbers: Spark keeps k rows of each task, so the window over them is small."""
    return df.orderBy(*order).limit(k).withColumn("row_number", F.row_number().over(Window.orderBy(*order)))
