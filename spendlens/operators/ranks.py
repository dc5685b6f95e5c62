"""Row numbers over a whole table without one task for all rows."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, functions as F

from spendlens import shared


def ranked(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """`rows` with a column of row numbers from 1 in `order`, which must tell all rows apart for the result to be fixed.

    Rows are dealt to ranges of the order and sorted within; a row's number is its
    place in its range, after the rows of the ranges before. Only the ranges' sizes,
    one row for each, are summed in order. Ranges come from a sample, so they are
    written before they are counted.
    """
    if "__range" in rows.columns or "__place" in rows.columns:
        raise ValueError("columns __range and __place are taken")
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # The high bits of this id are the range's number, the low 33 the place in it.
    placed = sorted_rows.withColumn("__place", F.monotonically_increasing_id())
    placed = placed.withColumn("__range", F.shiftright("__place", 33)).withColumn("__place", F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)))
    placed = shared.written(placed, "ranked")
    sizes = {r["__range"]: r["n"] for r in placed.groupBy("__range").agg(F.count("*").alias("n")).collect()}  # one row for each of the n ranges
    offsets = [0, *itertools.accumulate(sizes.get(k, 0) for k in range(n - 1))]
    at = F.get(F.array(*map(F.lit, offsets)), F.col("__range").cast("int"))
    return placed.withColumn(name, (at + F.col("__place") + 1).cast("int")).drop("__range", "__place")
