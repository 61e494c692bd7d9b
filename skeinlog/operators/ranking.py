"""Ranks over a whole table, without bringing its rows together in one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlog.sources.scratch import written


def numbered(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds each row's place in the order of the whole table, from 1.

    Rows are range-sorted over all tasks and written once; the driver sums one number per task, and a row's place is its place
    in its task plus the rows of the tasks before it.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    placed = written(ordered.withColumns({"__task": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "ranked")
    heads = sorted(placed.groupBy("__task").agg(F.min("__at").alias("first"), F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["__task"])
    before = [0, *accumulate(r["n"] for r in heads)]
    shifts = spark.createDataFrame([(r["__task"], b - r["first"] + 1) for r, b in zip(heads, before, strict=False)], "__task int, __shift long")
    return placed.join(F.broadcast(shifts), "__task").withColumn(name, F.col("__at") + F.col("__shift")).drop("__task", "__at", "__shift")
